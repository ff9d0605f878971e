"""Mixing sources to target weights with nested hash-threshold histograms.

Every document has a ticket, a hash of its id and text. What a source still needs after
its whole repeats is a budget of words, taken from the documents with the lowest
tickets. The ticket at which the budget is used up is found by histograms: words
per source and leading ticket bits, then only the bucket holding the boundary is
refined, by its next bits. Nothing is sorted, and the choice is one comparison
per row.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a null id is an id; rows that repeat id and text share a ticket, and where
that is the boundary as many of them are taken as bring the source nearest to its
target (which ones is decided by their numbers in a written copy). An empty table gives
an empty result. Documents are taken whole: the boundary document is taken when that
brings the source nearer to its target. Texts of any length are only counted and hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, stage, ticket
from orderlens.operators.skew import attach

BITS = 60
STEP = 12
WORD = r"[^\x20\x09-\x0D]+"


def document_ticket(doc_id: Column, text: Column) -> Column:
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return ticket(F.concat(own, F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))


def _sizes(df: DataFrame) -> DataFrame:
    return pick(df, "doc_id", "text", "source").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        document_ticket(F.col("doc_id").cast("bigint"), F.col("text")).alias("ticket"),
    )


def _targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, rows, source_size, target.

    The place of a source in code point order comes from a distributed sort and
    the row counts of its parts. Resharing repeats three sums until no source is
    above its cap.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")
    )
    ordered = stage(
        totals.orderBy(F.asc_nulls_last("source")).withColumn(
            "mark", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright("mark", 33)
    counts = sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, []
    for number, rows in counts:
        offsets.append((number, before))
        before += rows
    places = spark.createDataFrame(offsets, "p long, before long")
    inside = F.col("mark") - F.shiftleft(F.col("p"), 33)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.col("before") + inside) % len(weights) + 1).cast("int"),
    )
    ranked = stage(
        ordered.withColumn("p", part)
        .join(F.broadcast(places), "p")
        .select("source", "rows", "source_size", weight.alias("weight"))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
    )
    budget = float(share) * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        free, held = ranked.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most")))
        ).first()
        if free is None:
            break
        following = (budget - (held or 0.0)) / free
        if following <= level:
            break
        level = following
    return ranked.select(
        "source",
        "rows",
        "source_size",
        F.least("most", F.col("weight") * F.lit(max(level, 0.0))).alias("target"),
    )


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: whole repeats and the ticket below which one more copy is taken.

    Where only some of the rows of one ticket are taken, ``partial`` is that ticket and
    ``some`` their number.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    state = stage(
        sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("bigint"))
        .withColumn("used", F.lit(0).cast("bigint"))
        .withColumn("cut", F.when(F.col("budget") <= 0, F.lit(0).cast("bigint")))
        .withColumns({"partial": F.lit(None).cast("bigint"), "some": F.lit(0).cast("bigint")})
    )
    for shift in range(BITS - STEP, -1, -STEP):
        open_ = state.where(F.col("cut").isNull())
        if open_.isEmpty():
            break
        wanted = open_.select("source", "rows", F.col("prefix").alias("_prefix"))
        rows = attach(sized, wanted, ["source"], "rows", null_safe=True).where(
            F.shiftright("ticket", shift + STEP) == F.col("_prefix")
        )
        buckets = rows.groupBy("source", F.shiftright("ticket", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("ticket").alias("low"), F.max("ticket").alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
        running = Window.partitionBy("source").orderBy("bucket")
        reached = buckets.withColumn("upto", F.sum("words").over(running))
        same = F.col("r.source").eqNullSafe(F.col("s.source"))
        past = F.col("s.used") + F.col("r.upto") > F.col("s.budget")
        boundary = (
            open_.alias("s")
            .join(reached.alias("r"), same & past)
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.min(F.struct("r.bucket", "r.words", "r.upto", "r.low", "r.high", "r.n")).alias("b"))
        )
        # Of one ticket's rows as many are taken as come nearest to what is left of the budget.
        room, each = F.col("budget") - F.col("before"), F.col("b.words") / F.col("b.n")
        fitting = F.floor(room / each)
        nearer = room - fitting * each > (fitting + 1) * each - room
        number = F.least(fitting + F.when(nearer, 1).otherwise(0), F.col("b.n"))
        single = F.col("b.low") == F.col("b.high")
        cut = F.when(F.col("b").isNull(), F.lit(1 << BITS)).when(
            single, F.col("b.low") + F.when(number == F.col("b.n"), 1).otherwise(0)
        )
        parted = single & (number > 0) & (number < F.col("b.n"))
        refined = (
            state.alias("s")
            .join(boundary.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
            .select("s.*", "t.b")
            .withColumn("before", F.col("used") + F.col("b.upto") - F.col("b.words"))
        )
        known = F.col("cut").isNotNull()
        state = stage(
            refined.select(
                *[c for c in sources.columns],
                "whole",
                "budget",
                F.when(known, F.col("prefix")).otherwise(F.col("b.bucket")).alias("prefix"),
                F.when(known, F.col("used")).otherwise(F.col("before")).alias("used"),
                F.coalesce("cut", cut).cast("bigint").alias("cut"),
                F.when(known, F.col("partial")).when(parted, F.col("b.low")).alias("partial"),
                F.when(known, F.col("some")).when(parted, number).otherwise(0).cast("bigint").alias("some"),
            )
        )
    return state


def with_copies(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` (source, ticket and others) with ``copies``: how often the mix takes each.

    Rows of a ticket of which only some are taken are written and numbered: by part, and
    within a part by place, so that no task holds more of them than a part.
    """
    wanted = ["source", "rows", "source_size", "target", "whole", "cut", "partial", "some"]
    placed = attach(rows, state.select(*wanted), ["source"], "rows", null_safe=True)
    plain = F.col("whole") + F.when(F.col("ticket") < F.col("cut"), 1).otherwise(0)
    if state.where("partial IS NOT NULL").isEmpty():
        return placed.withColumn("copies", plain)
    parted = F.coalesce(F.col("ticket") == F.col("partial"), F.lit(False))
    own = stage(placed.where(parted).withColumn("_id", F.monotonically_increasing_id()))
    own = own.withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select(
        F.col("source").alias("_source"), F.col("_part").alias("_own"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    # A source has one such ticket at most, and its rows a row in ``parts`` per part.
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_own"))
    place = F.row_number().over(Window.partitionBy("source", "_part").orderBy("_id"))
    numbered = own.withColumn("_place", place).join(parts, same)
    taken = F.col("whole") + (F.col("_before") + F.col("_place") <= F.col("some")).cast("int")
    numbered = numbered.withColumn("copies", taken).select(*placed.columns, "copies")
    return placed.where(~parted).withColumn("copies", plain).unionAll(numbered)


def mixture(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Per row of ``documents``: doc_id, size, source_size, target, copies, taken.

    Sources in code point order (null last) weigh ``weights``, repeating, and share
    ``share`` times all words; no target exceeds ``cap`` times its source's words.
    """
    sized = stage(_sizes(documents))
    rows = with_copies(sized, thresholds(sized, _targets(sized, weights, share, cap)))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The rows of the mix, all columns kept, each as often as it is taken.

    ``options`` are those of ``mixture``.
    """
    weights = options.get("weights", (5, 2, 1))
    sized = stage(_sizes(documents))
    state = thresholds(
        sized, _targets(sized, weights, options.get("share", 1.5), options.get("cap", 2.0))
    )
    names = documents.columns
    plain = documents.toDF(*[f"_{i}" for i in range(len(names))])
    keyed = plain.withColumns(
        {
            "source": F.col(f"_{names.index('source')}"),
            "ticket": document_ticket(
                F.col(f"_{names.index('doc_id')}").cast("bigint"), F.col(f"_{names.index('text')}")
            ),
        }
    )
    repeated = with_copies(keyed, state).withColumn(
        "copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    )
    return repeated.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(names)])
