"""Importance resampling of documents towards a target text collection.

1. Texts are lower-cased (A-Z only) and cut by an untrained pre-tokeniser (a ``Split``
   on a regular expression) into words with their offsets. Every window of 1 to
   ``longest`` neighbouring offset pairs is a feature: the words it spans, joined by
   one space. Its bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. Texts are
   cut once; buckets are kept as packed numbers in the shared folder.
2. Histograms of the documents and of the target give every bucket a gain, the floored
   1000-fold logarithm of the smoothed ratio of its shares. Both histograms and the
   gains have ``buckets`` rows, whatever the data.
3. A document's weight is the floored mean gain of its features. Its score adds a
   Gumbel variate, made from its id, so that the highest scores are a draw
   without replacement in proportion to the weights' exponentials.
4. The rank of the highest scores: scores are whole numbers of a range that the
   histogram bounds, so counts per score give the least score that can be drawn.
   Only rows from there on are sorted, by ranges of (score, doc_id, text hash),
   and numbered by their part's offset; no window holds more than a part.

Defined results: null and empty texts have no features, weight 0 and are never drawn; a
null doc_id has the variate of an empty id and comes last among equal scores;
rows with equal ids and texts are ranked one after the other; a null or empty
target gives every feature the gain of an unseen bucket; an empty table gives
an empty result; other columns, whatever their names, are not looked at. A text
is cut as a whole, in one task: about 100 bytes of memory per word.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, row_slices, stage
from orderlens.operators.settle import release

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 1
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
SLICE = 500_000
# Words whose buckets a task remembers, in two generations.
CACHE = 200_000
# Scores counted together in the first step of locating a rank.
STEP = 512


def splitter():
    """The pre-tokeniser: what matches is a word, with its offsets, the rest is removed."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), behavior="removed", invert=True)


class Buckets:
    """Buckets of the features of a text."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS):
        self.split, self.longest, self.buckets = splitter(), longest, buckets
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _of_word(self, word: str) -> int:
        found = self.old.get(word)
        if found is None:
            found = zlib.crc32(word.encode()) % self.buckets
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def __call__(self, text: bytes) -> tuple[int, list[int]]:
        """Number of words, and the bucket of every feature (single words first)."""
        lower = text.lower().decode()  # of bytes: A-Z only
        words = [word for word, _ in self.split.pre_tokenize_str(lower)]
        known = self.young.get
        found = [known(word) for word in words]
        if None in found:
            found = [self._of_word(w) if b is None else b for w, b in zip(words, found, strict=True)]
        for size in range(2, self.longest + 1):
            # The window's offsets run from its first word's start to its last word's end.
            windows = zip(*(words[i:] for i in range(size)), strict=False)
            found += [zlib.crc32(" ".join(w).encode()) % self.buckets for w in windows]
        return len(words), found


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(documents: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, print (hash of the text), n_words, features (packed buckets), as a staged table."""
    kind = _kind(buckets)

    def run(batches):
        cut = Buckets(longest, buckets)
        for batch in batches:
            for piece in row_slices(batch, 2, SLICE):
                texts = piece.column(2).cast(pa.binary()).to_pylist()
                found = [cut(x) if x else (0, []) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns[:2],
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([np.array(b, dtype=kind).tobytes() for _, b in found], pa.binary()),
                    ],
                    ["doc_id", "print", "n_words", "features"],
                )

    source = pick(documents, "doc_id", "text").select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("print"), "text"
    )
    schema = "doc_id long, print long, n_words long, features binary"
    return stage(source.mapInArrow(run, schema))


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features every bucket holds (one number per bucket, collected)."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in row_slices(batch, 0, SLICE):
                data = b"".join(piece.column(0).to_pylist())
                total += np.bincount(np.frombuffer(data, dtype=kind), minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    counted = features.select("features").mapInArrow(run, "bucket long, n long")
    total = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored 1000-fold log ratio of its smoothed shares."""
    n = len(source)
    all_source, all_target = float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n))))
            for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, print, n_words, n_features, weight: the floored mean gain of the features."""
    sent, kind = features.sparkSession.sparkContext.broadcast(gain), _kind(len(gain))

    def run(batches):
        for batch in batches:
            for piece in row_slices(batch, 3, SLICE):
                packed = piece.column(3).to_pylist()
                sizes = np.array([len(x) for x in packed], dtype=np.int64) // np.dtype(kind).itemsize
                sums = np.r_[0, np.cumsum(sent.value[np.frombuffer(b"".join(packed), dtype=kind)])]
                ends = np.cumsum(sizes)
                total = sums[ends] - sums[ends - sizes]
                mean = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:3], pa.array(sizes), pa.array(mean)],
                    ["doc_id", "print", "n_words", "n_features", "weight"],
                )

    schema = "doc_id long, print long, n_words long, n_features long, weight long"
    return features.mapInArrow(run, schema)


def scored(weights: DataFrame, seed: str = SEED) -> DataFrame:
    """The score: weight plus a Gumbel variate made of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    share = (h + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")
    return weights.withColumn("score", F.col("weight") + noise)


def least_score(scores: DataFrame, number: int) -> int | None:
    """The greatest score such that at least ``number`` rows have it or a higher one.

    Counts per score are cut into steps; only the step that holds the wanted rank is
    looked at score by score.
    """
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.withColumn("step", F.floor(F.col("score") / STEP)))
    above = 0
    steps = counts.groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    for step in steps:
        if above + step.n >= number:
            for row in counts.where(F.col("step") == step.step).orderBy(F.desc("score")).collect():
                above += row.n
                if above >= number:
                    release(counts)
                    return row.score
        above += step.n
    release(counts)
    return None


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, staged, with their numbers from 1 in the order of partitions and within them."""
    # A row's id is its place in its part, with the part's number above it.
    placed = stage(
        rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    )
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, not per document.
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, number.alias(name))


def ranked(scores: DataFrame, number: int) -> DataFrame:
    """``scores`` with ``rank`` 1 .. ``number`` by score, then doc_id; the other ranks are null.

    Rows under ``LEAST_WORDS`` words take no part.
    """
    able = scores.where(F.col("n_words") >= LEAST_WORDS)
    least = least_score(able, number) if number > 0 else None
    none = F.lit(None).cast("bigint")
    if least is None:
        return scores.withColumn("rank", none)
    high = (F.col("n_words") >= LEAST_WORDS) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("print")]
    rows = scores.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    drawn = numbered(rows, "rank").withColumn("rank", F.when(F.col("rank") <= number, F.col("rank")))
    return scores.where(~high).withColumn("rank", none).unionByName(drawn)


def resampled(
    documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
    seed: str = SEED, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, print, n_words, n_features, weight, score and rank per row of ``documents``.

    ``target`` has a column ``text``. Of the N documents with at least ``LEAST_WORDS`` words,
    ``floor(percent * N / 100)`` are drawn.
    """
    aim = pick(target, "text").withColumn("doc_id", F.lit(None).cast("bigint"))
    features = featured(documents, longest, buckets)
    wanted = featured(aim, longest, buckets)
    gain = gains(histogram(features, buckets), histogram(wanted, buckets))
    release(wanted)
    scores = stage(scored(weighed(features, gain), seed))
    release(features)
    number = scores.where(F.col("n_words") >= LEAST_WORDS).count() * percent // 100
    return ranked(scores, number)


def drawn(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are drawn, all columns kept.

    Of rows with equal ids and texts as many stay as were drawn of them, one at least.
    """
    names = documents.columns
    ranks = resampled(documents, target, **options)
    groups = ranks.groupBy("doc_id", "print").agg(
        F.count("rank").alias("_taken"), F.count(F.lit(1)).alias("_all")
    )
    taken = stage(groups.where("_taken > 0")).toDF("_own", "_hash", "_taken", "_all")
    plain = documents.toDF(*[f"_{i}" for i in range(len(names))])
    id_, print_ = F.col(f"_{names.index('doc_id')}").cast("bigint"), F.xxhash64(f"_{names.index('text')}")
    found = plain.join(taken, id_.eqNullSafe(F.col("_own")) & (print_ == F.col("_hash")))
    whole = found.where("_taken = _all")
    # Rows of one id and text have one score, so the last rank cuts one such group at most.
    cut = numbered(found.where("_taken < _all"), "_place").where("_place <= _taken")
    columns = [f"_{i}" for i in range(len(names))]
    return whole.select(*columns).unionAll(cut.select(*columns)).toDF(*names)
