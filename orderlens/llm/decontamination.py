"""Benchmark decontamination by spaced-seed hashing.

A seed takes four words at fixed places of a mask, so a changed word between them
does not matter. Seeds of the documents are joined with seeds of the benchmark on
their hash; every hit names a diagonal (document place minus item place), along
which the overlap is verified: it counts if some window of 13 aligned words (all
words of an item with fewer) holds at least 80 % equal words. The four masks hit
every such window, so nothing that passes is missed (``tests/llm`` proves it by
trying all windows).

A document's seeds are computed on its bytes, and only those in a fixed-size bit
table of the benchmark's seeds leave the scan; they are kept, with the words around
them, in the shared folder. The seeds alone are joined and counted per diagonal: a
window that passes always holds some number of hits (``least_hits``, by enumeration),
so diagonals with fewer are dropped before any words are read for verification.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased (A-Z) text, so
punctuation does not count. Defined results: null and empty texts overlap with
nothing; items of fewer than five words are too short to be evidence and match
nothing; repeated rows are reported once per (doc_id, item_id) and place; rows
with a null doc_id or item_id are reported with the null; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import WordHasher, _mix, give_back, pick, row_slices, stage, without_rows

MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
SPAN = 5
WINDOW = 13
SHARE = 0.8
FEWEST = 5
BITS = 23
# Up to so many diagonals (three numbers each) are broadcast.
BROADCAST_ROWS = 500_000
SLICE = 500_000
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# Capital letters are made small first, so they are word characters.
SEPARATORS = bytes(b for b in SEPARATORS if not 65 <= b <= 90)


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the masked words from every place at which the mask fits."""
    places = MASKS[mask]
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, mask + 1, dtype=np.uint64)
        for place in places:
            total = total * np.uint64(0xD1342543DE82EF95) + words[place : place + n]
        return _mix(total)


def least_hits(width: int) -> int:
    """How many seeds a window of ``width`` words holds at least if 80 % of them are equal.

    Of the windows with the most wrong words allowed; fewer wrong words only add hits.
    """

    def hits(wrong: tuple[int, ...]) -> int:
        equal = [i not in wrong for i in range(width)]
        return sum(
            all(equal[at + place] for place in mask)
            for mask in MASKS
            for at in range(width - mask[-1])
        )

    return min(hits(wrong) for wrong in combinations(range(width), width // 5))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


ITEM_SCHEMA = (
    "item long, item_id long, item_words array<long>, mask int, place int, seed long"
)


def _item_seeds(batches):
    hasher = WordHasher(SEPARATORS)
    for batch in batches:
        words, bounds = hasher(batch.column(2))
        rows: list[tuple] = []
        for i, (number, item) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)):
            own = words[bounds[i] : bounds[i + 1]]
            if len(own) < FEWEST:
                continue
            listed = own.view(np.int64).tolist()
            for mask in range(len(MASKS)):
                for place, seed in enumerate(seeds(own, mask).view(np.int64).tolist()):
                    own_words = listed if mask == 0 and place == 0 else None
                    rows.append((number, item, own_words, mask, place, seed))
        if rows:
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                ["item", "item_id", "item_words", "mask", "place", "seed"],
            )


def _bit_table(item_seeds: DataFrame) -> np.ndarray:
    """Bits of the benchmark's seeds; a fixed size whatever the benchmark's.

    Each part sends one table, and the driver holds two of them at a time.
    """

    def bits(batches):
        table = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            hashes = np.asarray(batch.column(0), dtype=np.int64).view(np.uint64)
            table[_slots(hashes)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()])], ["bits"])

    total = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for row in item_seeds.select("seed").mapInArrow(bits, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, dtype=np.uint8)
    return np.unpackbits(total).astype(bool)


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_aligned, n_equal, similarity.

    One row per document, item and diagonal with a verified overlap; doc_word and
    item_word are where the aligned stretch begins (words from 0), similarity the
    best share of equal words over a window.
    """
    return _verified(documents, benchmark).drop("print").distinct()


def _verified(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``overlaps`` with the hash of the text, ``print``, as they are found."""
    spark = documents.sparkSession
    numbered = pick(benchmark, "item_id", "text").select(
        F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint"), "text"
    )
    items = stage(numbered.mapInArrow(_item_seeds, ITEM_SCHEMA))
    longest = items.agg(F.max(F.size("item_words"))).first()[0] or 1
    sent = spark.sparkContext.broadcast(_bit_table(items))

    def scan(batches):
        give_back()
        hasher = WordHasher(SEPARATORS)
        table = sent.value
        for batch in batches:
            for piece in row_slices(batch, 2, SLICE):
                words, bounds = hasher(piece.column(2))
                found = []
                for mask in range(len(MASKS)):
                    hashes = seeds(words, mask)
                    at = np.flatnonzero(table[_slots(hashes)])
                    # The mask must lie within one document.
                    owner = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + MASKS[mask][-1] < bounds[owner + 1]
                    at, owner = at[inside], owner[inside]
                    found.append((owner, at, np.full(len(at), mask), hashes[at].view(np.int64)))
                owner, at, mask, seed = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.lexsort((at, owner))
                owner, at, mask, seed = owner[order], at[order], mask[order], seed[order]
                # Neighbouring hits share one stretch of words, which holds the whole alignment
                # of each of them. Its length is bounded, so a document full of hits has many.
                block = (at - bounds[owner]) // (8 * longest)
                new = np.diff(owner) + np.abs(np.diff(block)) + (np.diff(at) > 2 * longest) > 0
                new = np.r_[True, new]
                begins = np.flatnonzero(new)
                ends = np.r_[begins[1:], len(at)]
                low = np.maximum(at[begins] - longest, bounds[owner[begins]])
                high = np.minimum(at[ends - 1] + longest + SPAN, bounds[owner[begins] + 1])
                stretches = [words[a:b].view(np.int64) for a, b in zip(low, high, strict=True)]
                lists = lambda parts, kind: pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()),
                    pa.array(np.concatenate(parts), kind),
                )
                cut = lambda values: [values[a:b] for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).cast(pa.int64()).take(pa.array(owner[begins])),
                        piece.column(1).take(pa.array(owner[begins])),
                        pa.array(low - bounds[owner[begins]], pa.int64()),
                        lists(stretches, pa.int64()),
                        lists(cut(at - bounds[owner]), pa.int64()),
                        lists(cut(mask), pa.int32()),
                        lists(cut(seed), pa.int64()),
                    ],
                    ["doc_id", "print", "low", "words", "places", "masks", "seeds"],
                )

    schema = (
        "doc_id long, print long, low long, words array<long>, places array<long>, masks array<int>, "
        "seeds array<long>"
    )
    stretches = stage(
        pick(documents, "doc_id", "text")
        .select("doc_id", F.xxhash64("text").alias("print"), "text")
        .mapInArrow(scan, schema)
        .withColumn("stretch", F.monotonically_increasing_id())
    )
    hits = stretches.select(
        "stretch", F.explode(F.arrays_zip("places", "masks", "seeds")).alias("hit")
    ).select("stretch", "hit.*")
    # One item's list of words stands in one of its rows; its length is wanted with every seed.
    texts = stage(items.where("mask = 0 and place = 0").select("item", "item_id", "item_words"))
    # A window's hits may fall in two neighbouring stretches, of which one has half of them.
    least = F.array(*[F.lit((least_hits(w) + 1) // 2) for w in range(FEWEST, WINDOW + 1)])
    width = F.least(F.size("item_words"), F.lit(WINDOW))
    wanted = texts.select("item", F.get(least, width - FEWEST).alias("least"))
    known = items.select(
        "item", F.col("mask").alias("masks"), "place", F.col("seed").alias("seeds")
    )
    counted = (
        hits.join(known, ["seeds", "masks"])
        .groupBy("stretch", "item", (F.col("places") - F.col("place")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    diagonals = stage(
        counted.join(wanted, "item").where("hits >= least").select("stretch", "item", "diagonal")
    )
    few = diagonals.count() <= BROADCAST_ROWS
    pairs = (
        stretches.select("stretch", "doc_id", "print", "low", "words")
        .join(F.broadcast(diagonals) if few else diagonals, "stretch")
        .join(texts, "item")
        .select("doc_id", "print", "item_id", "diagonal", "low", "words", "item_words")
    )

    def verify(batches):
        for batch in batches:
            rows = []
            for doc, text, item, diagonal, low, words, own in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                first = max(0, low - diagonal)
                stop = min(len(own), low + len(words) - diagonal)
                shift = diagonal - low
                equal = np.array([own[i] == words[i + shift] for i in range(first, stop)], dtype=int)
                width = min(len(own), WINDOW)
                if len(equal) < width:
                    continue
                sums = np.convolve(equal, np.ones(width, dtype=int), "valid")
                if 5 * sums.max() < 4 * width:
                    continue
                rows.append(
                    (doc, text, item, diagonal + first, first, len(equal), int(equal.sum()),
                     float(sums.max()) / width)
                )
            if rows:
                kinds = [pa.int64()] * 7 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "print", "item_id", "doc_word", "item_word", "n_aligned", "n_equal", "similarity"],
                )

    return pairs.mapInArrow(
        verify,
        "doc_id long, print long, item_id long, doc_word long, item_word long, n_aligned long, "
        "n_equal long, similarity double",
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a verified overlap, all columns kept.

    A row goes by its doc_id and text, so a clean row that has the id (or the null)
    of an overlapping one stays.
    """
    return without_rows(documents, _verified(documents, benchmark).select("doc_id", "print"))
