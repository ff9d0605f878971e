"""Line dedup: repeated runs of lines, found by prefix doubling over line ids.

Every line gets an id. Prefix doubling names, for each place, the run of 2^k lines
that begins there: the name of a run of twice the length is made from the names of
its halves, and equal runs get equal names, the place where the run first stands.
Runs that stand only once drop out at once, so later rounds work on repeated
places alone, and rounds end with the longest repeated run.

The names then give, for each place, the longest run that begins there and stood
earlier (of any length), by a descent over the powers of two. Places that share
their first lines are a group; where several of a group go on with the same 2^k
lines, they become a group of their own, and the first of them alone stays to stand
for all in the old one. So every place is a later copy in one group, the deepest
with an earlier place, and groups never hold more than two rows per place.

A longest run with at least ``least_words`` words is deleted; overlapping ones are
one maximal stretch. The first copy (by doc_id, then row, then line) always stays.

Only DataFrame functions are used; every round is written to the shared folder.
Defined results: null and empty texts have no lines; repeated rows are copies of
the first of them; null doc_ids come first in the order; lines are compared whole,
by a 64-bit hash and their length. An empty table gives an empty result; other columns
are not looked at (or kept, where rows are returned). A text becomes rows of lines at
once, so a very long one is spread like any others; a single line is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, stage
from orderlens.operators.skew import attach

LEAST_WORDS = 25
WORD = r"[^\x20\x09-\x0D]+"


def lines(numbered: DataFrame) -> DataFrame:
    """doc_id, row, line, id, words: every line of every text."""
    exploded = numbered.where(F.length("text") > 0).select(
        "doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "content")
    )
    return exploded.select(
        "doc_id",
        "row",
        F.col("line").cast("bigint").alias("line"),
        F.xxhash64("content", F.length("content")).alias("id"),
        F.regexp_count("content", F.lit(WORD)).cast("bigint").alias("words"),
    )


def _named(places: DataFrame, *key: str) -> DataFrame:
    """doc_id, row, line, words, name: the places whose key occurs again.

    ``name`` is the first of the places with that key.
    """
    keyed = places.select("doc_id", "row", "line", "words", F.xxhash64(*key).alias("key"))
    groups = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "row", "line")).alias("name"))
        .where("rows > 1")
    )
    found = attach(keyed, groups, ["key"], "rows").where(F.col("name").isNotNull())
    return found.drop("key")


def _behind(names: DataFrame) -> DataFrame:
    return names.select(
        F.col("row").alias("_row"),
        F.col("line").alias("_line"),
        F.col("name").alias("_name"),
        F.col("words").alias("_words"),
    )


def _doubled(names: DataFrame, length: int) -> DataFrame:
    """The runs made of a named run of ``length`` lines and another one right behind it."""
    same = (F.col("row") == F.col("_row")) & (F.col("line") + length == F.col("_line"))
    runs = names.join(_behind(names), same).withColumn("words", F.col("words") + F.col("_words"))
    return stage(_named(runs, "name", "_name"))


def _is(place: str) -> Column:
    return (F.col(f"{place}.row") == F.col("row")) & (F.col(f"{place}.line") == F.col("line"))


def _entering(named: list[DataFrame], k: int) -> DataFrame:
    """doc_id, row, line, words, first, length: places whose longest run has 2^k lines or
    more but under 2^(k + 1), and the first places of their groups."""
    names = named[k].withColumnRenamed("name", "first").withColumn("length", F.lit(1 << k).cast("bigint"))
    if k + 1 == len(named):
        return names
    longer = named[k + 1].where(~_is("name")).select("row", "line")
    return names.join(longer, ["row", "line"], "left_anti").select(*names.columns)


def _extended(places: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """Groups cut by the ``length`` lines that follow: all who share them go on together."""
    same = (F.col("row") == F.col("_row")) & (F.col("line") + F.col("length") == F.col("_line"))
    keyed = places.join(_behind(names), same, "left").withColumn(
        "key", F.when(F.col("_name").isNotNull(), F.xxhash64("first", "length", "_name"))
    )
    groups = (
        keyed.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "row", "line")).alias("start"))
        .where("rows > 1")
    )
    found = attach(keyed, groups, ["key"], "rows")
    stays = F.struct("words", "first", "length")
    goes = F.struct(
        (F.col("words") + F.col("_words")).alias("words"),
        F.col("start").alias("first"),
        (F.col("length") + length).alias("length"),
    )
    into = (
        F.when(F.col("start").isNull(), F.array(stays))
        .when(_is("start"), F.array(stays, goes))
        .otherwise(F.array(goes))
    )
    return found.select("doc_id", "row", "line", F.explode(into).alias("_")).select("doc_id", "row", "line", "_.*")


def longest_copies(numbered: DataFrame) -> DataFrame:
    """doc_id, row, line, words, first, length: per place the longest run that stood earlier.

    ``first`` is the place where that run first stands. Places without one are left out.
    """
    named = [stage(_named(lines(numbered), "id"))]
    while not named[-1].isEmpty():
        named.append(_doubled(named[-1], 1 << len(named) - 1))
    places = None
    for k in reversed(range(len(named))):
        entering = _entering(named, k)
        places = stage(entering if places is None else _extended(places, named[k], 1 << k).unionByName(entering))
    return places.where(~_is("first"))


def repeated_runs(numbered: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row, doc_id, first_line, n_lines, first_doc_id: the stretches to delete.

    ``numbered`` has doc_id, row (unique) and text.
    """
    found = longest_copies(numbered).where(F.col("words") >= least_words)
    return _merged(
        found.select(
            "doc_id", "row", "line", (F.col("line") + F.col("length")).alias("stop"),
            F.col("first.doc_id").alias("first_doc_id"),
        )
    )


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping runs of a document (one per line at most) as one stretch."""
    along = Window.partitionBy("row").orderBy("line")
    reached = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("line") >= reached, F.lit(True)).cast("int")
    stretch = found.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(along))
    return (
        stretch.groupBy("row", "stretch")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.min("line").alias("first_line"),
            (F.max("stop") - F.min("line")).alias("n_lines"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .drop("stretch")
    )


def _numbered(documents: DataFrame) -> DataFrame:
    return pick(documents, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )


def deletions(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, first_line, n_lines, first_doc_id: one row per deleted stretch."""
    return repeated_runs(_numbered(documents), least_words).drop("row")


def deduplicated(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows with later copies deleted from their texts, all columns kept.

    A text of which nothing is left is empty.
    """
    names = documents.columns
    plain = documents.toDF(*[f"_{i}" for i in range(len(names))])
    kept = stage(plain.withColumn("row", F.monotonically_increasing_id()))
    place = f"_{names.index('text')}"
    numbered = kept.select(
        F.col(f"_{names.index('doc_id')}").cast("bigint").alias("doc_id"), "row", F.col(place).alias("text")
    )
    cuts = (
        repeated_runs(numbered, least_words)
        .groupBy("row")
        .agg(F.collect_list(F.struct("first_line", "n_lines")).alias("cuts"))
    )
    inside = lambda i: F.exists(
        "cuts", lambda c: (i >= c["first_line"]) & (i < c["first_line"] + c["n_lines"])
    )
    shorter = F.array_join(F.filter(F.split(place, "\n"), lambda _, i: ~inside(i)), "\n")
    text = F.when(F.col("cuts").isNull(), F.col(place)).otherwise(shorter)
    joined = kept.join(cuts, "row", "left").withColumn(place, text)
    return joined.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(names)])
