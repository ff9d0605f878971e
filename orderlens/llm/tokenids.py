"""Token ids in Re-Pair compressed binary blocks.

Texts are encoded in ascending doc_id order. Ids are collected into blocks of a
fixed size (whole documents, one at least) and each block is compressed by
Re-Pair: frequent pairs of neighbouring ids are replaced by new ids, in rounds,
until no pair occurs ``LEAST`` times. In a round a pair is replaced where it is more
frequent (by powers of two) than the pairs it overlaps; of a run of one id every
second pair is. A block stores

* ``rules``: the two ids behind each new id, uint32 little-endian, in order;
* ``spans``: how many ids each new id expands to, uint32;
* ``ids``: the remaining sequence, uint32;
* ``ends``: per document, where its ids end within the block, uint64.

New ids count from VOCABULARY up. Expansion lengths let a reader find any
document of a block without expanding what precedes it (``decode_range``). The
blocks are rows of a Parquet table (``part``, ``block``, ``first``: ids of the
part before the block), written by Spark to the shared folder, so that a lost
executor's blocks are written again and readers need no local files.

Defined results: null and empty texts have no ids but the end id; rows with a
null doc_id come first; rows that repeat an id follow each other, ordered by
their text's hash; an empty table gives an empty file and result. ``start``
counts the ids of all rows before. A text is encoded as a whole in one task (about
100 times its bytes in memory), however long. The tokenizer file is a parameter: texts
are cut into pieces only where it is byte-level BPE that splits as assumed, and encoded
whole otherwise; a vocabulary that reaches ``VOCABULARY`` is refused.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import (
    WordHasher,
    _mix,
    flat_bytes,
    give_back,
    pick,
    row_slices,
    stage,
    word_hasher,
)

END = 0
VOCABULARY = 1 << 17
BLOCK_IDS = 1 << 19
# How often a pair must occur to be replaced, and how often a rule must be used to be made.
LEAST = 16
USES = 4
# Bytes of text that are encoded together.
SLICE = 500_000
# New pieces given to the tokenizer's model in one call.
TOGETHER = 64
COUNT_BITS = 18
# Pieces (and ids behind them) of one generation of the encoder's memory; there are two.
CACHE = 400_000
CACHE_IDS = 8 * CACHE
TABLE_BITS = 20

# Classes of UTF-8 bytes: letters (ASCII, and two-byte letters from U+00C0 to U+00FF), marks and
# digits, blank, line end, and bytes that send a text to the tokenizer as a whole: other white
# space and controls, the apostrophe (it may begin a contraction), all further characters.
LETTER, SIGN, BLANK, LINE, WHOLE = range(5)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, WHOLE, dtype=np.uint8)
    classes[0x21:0x7F] = SIGN
    classes[0x27] = WHOLE
    for letters in (range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0xC0), (0xC3,)):
        classes[list(letters)] = LETTER
    classes[0x20], classes[0x0A] = BLANK, LINE
    return classes


CLASSES = _byte_classes()


def _byte_characters() -> np.ndarray:
    """How byte-level vocabularies write bytes: printable ones as themselves, others from U+0100 on."""
    codes = np.arange(256, dtype="<u2")
    others = np.ones(256, dtype=bool)
    for plain in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)):
        others[list(plain)] = False
    codes[others] = 0x100 + np.arange(others.sum())
    return codes


BYTE_CHARACTERS = _byte_characters()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size - 1`` of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The ids of pieces, found by a 64-bit hash: a table of recent slots, and an index behind it."""

    def __init__(self):
        self.count, self.used = 0, 0
        self.hashes = np.zeros(1 << 12, dtype=np.uint64)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.sizes = np.zeros(1 << 12, dtype=np.int64)
        self.flat = np.zeros(1 << 14, dtype=np.uint32)
        self.index: dict[int, int] = {}
        self.table = np.zeros(1 << TABLE_BITS, dtype=np.int32)

    def add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        first, last = self.count, self.count + len(hashes)
        for name in ("hashes", "starts", "sizes"):
            setattr(self, name, _room(getattr(self, name), last))
        self.flat = _room(self.flat, self.used + len(flat))
        self.hashes[first:last], self.sizes[first:last] = hashes, sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.count, self.used = last, self.used + len(flat)
        self.index.update(zip(hashes.tolist(), range(first, last), strict=True))
        self.table[hashes >> np.uint64(64 - TABLE_BITS)] = np.arange(first, last)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of every hash, -1 where there is none."""
        entries = self.table[hashes >> np.uint64(64 - TABLE_BITS)].astype(np.int64)
        missed = np.flatnonzero(self.hashes[entries] != hashes)
        found = map(self.index.get, hashes[missed].tolist())
        entries[missed] = [-1 if e is None else e for e in found]
        return entries

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[entries]
        return self.flat[_spread(self.starts[entries], sizes)], sizes


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with room for ``n``, doubled where it lacks."""
    if n <= len(values):
        return values
    larger = np.zeros(max(n, 2 * len(values)), dtype=values.dtype)
    larger[: len(values)] = values
    return larger


def _cuts_as_assumed(tokenizer) -> bool:
    """Is it byte-level BPE with the usual splitting, and nothing done to texts before or after?"""
    told = json.loads(tokenizer.to_str())
    cut = told.get("pre_tokenizer") or {}
    return (
        (told.get("model") or {}).get("type") == "BPE"
        and not told["model"].get("dropout")
        and told.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and (told.get("post_processor") or {}).get("type") in (None, "ByteLevel")
    )


def _parting(tokenizer) -> tuple[str, int] | None:
    """A character (and its id) that no piece holds and that merges with none, if there is one."""
    model = json.loads(tokenizer.to_str())["model"]
    if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merges = (m if isinstance(m, str) else "".join(m) for m in model["merges"])
    merged = set(chain.from_iterable(merges))
    for code in BYTE_CHARACTERS[CLASSES == WHOLE].tolist():
        number = model["vocab"].get(chr(code))
        if number is not None and chr(code) not in merged:
            return chr(code), number
    return None


class Encoder:
    """The tokenizer, with the ids of pieces remembered.

    A byte-level tokenizer never merges across blanks, line ends, or between a
    letter and a digit or mark (contractions aside), so such pieces can be encoded
    one by one. They are found and hashed (64 bits) on the flat bytes of many
    texts; only pieces not met lately are given to the tokenizer. Texts with runs
    of white space, marks of special tokens or rarer characters are encoded whole.

    The memory has two generations: pieces are looked up in both, and kept in the
    young one; when that is full it becomes the old one.
    """

    def __init__(self, path: str):
        # One thread per task; Spark spreads the work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > VOCABULARY:
            raise ValueError(f"a vocabulary of at most {VOCABULARY} ids is needed")
        self.cuts, self.model = _cuts_as_assumed(self.tokenizer), self.tokenizer.model
        self.between = _parting(self.tokenizer) if self.cuts else None
        self.hasher = WordHasher(b"")
        self.hasher.values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        line = self._hashes(np.array([10], dtype=np.uint8), np.array([0]), np.array([1]))
        self.first = np.array([0, line[0]], dtype=np.uint64)
        self.line_end = self.whole(["\n"])[0]
        self.old, self.young = Pieces(), self._fresh()

    def _fresh(self) -> Pieces:
        """Entry 0 is the end id, entry 1 the line end."""
        pieces = Pieces()
        sizes = np.array([1, len(self.line_end)])
        pieces.add(self.first, np.array([END, *self.line_end], dtype=np.uint32), sizes)
        return pieces

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _hashes(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.hasher.spans(raw, start, stop)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces (as byte-level characters) by the tokenizer's model, without cutting again.

        Many are encoded in one call, parted by a character that merges with none.
        """
        if self.between is None:
            own = [[token.id for token in self.model.tokenize(piece)] for piece in pieces]
            sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            ids = np.fromiter(chain.from_iterable(own), dtype=np.uint32)
        else:
            sign, number = self.between
            joined = (
                sign.join([*pieces[at : at + TOGETHER], ""]) for at in range(0, len(pieces), TOGETHER)
            )
            found = (token.id for text in joined for token in self.model.tokenize(text))
            ids = np.fromiter(found, dtype=np.uint32)
            ends = np.flatnonzero(ids == number)
            sizes = np.diff(np.r_[-1, ends]) - 1
            ids = ids[ids != number]
        self.young.add(hashes, ids, sizes)

    def _entries(self, hashes: np.ndarray, raw: np.ndarray, start, stop) -> np.ndarray:
        """The young entry of every piece, new ones being learnt."""
        if self.young.count > CACHE or self.young.used > CACHE_IDS:
            self.old, self.young = self.young, self._fresh()
        entries = self.young.find(hashes)
        missed = np.flatnonzero(entries < 0)
        if len(missed):
            fresh, first, inverse = np.unique(
                hashes[missed], return_index=True, return_inverse=True
            )
            before = self.old.find(fresh) if self.old.count else np.full(len(fresh), -1)
            again = before >= 0
            self.young.add(fresh[again], *self.old.ids(before[again]))
            at = missed[first[~again]]
            bounds = zip(start[at].tolist(), stop[at].tolist(), strict=True)
            data = BYTE_CHARACTERS[raw].tobytes().decode("utf-16-le")
            self._learn(fresh[~again], [data[a:b] for a, b in bounds])
            entries[missed] = self.young.find(fresh)[inverse]
        return entries

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id behind each, and how many every text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if not self.cuts:
            own = [np.array([*found, END], dtype=np.uint32) for found in self.whole(texts.to_pylist())]
            return np.concatenate(own), np.array([len(x) for x in own])
        raw, bounds = flat_bytes(texts)
        kinds = CLASSES[raw]
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[bounds] = True
        begins = begins[: len(raw)]
        before = np.r_[np.uint8(LINE), kinds[:-1]]
        space, space_before = kinds >= BLANK, before >= BLANK
        odd = kinds == WHOLE
        odd |= space & space_before & ~begins
        odd |= begins & (kinds == BLANK)
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        odd[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        filled = np.flatnonzero(np.diff(bounds) > 0)
        last = bounds[filled + 1] - 1
        odd[last] |= kinds[last] == BLANK
        apart = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1)
        first = begins | space | ((kinds != before) & (before != BLANK))
        start = np.flatnonzero(first)
        stop = np.r_[start[1:], len(raw)][: len(start)]
        owner = np.searchsorted(bounds, start, side="right") - 1
        if len(apart):
            plain = np.ones(n, dtype=bool)
            plain[apart] = False
            keep = plain[owner]
            start, stop, owner = start[keep], stop[keep], owner[keep]
        hashes = self._hashes(raw, start, stop)
        entries = self._entries(hashes, raw, start, stop)
        # The end of every text is an entry behind its pieces.
        counts = np.bincount(owner, minlength=n)
        places = np.insert(entries, np.cumsum(counts), 0)
        ids, sizes = self.young.ids(places)
        counts += 1
        lengths = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        if len(apart):
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            own = self.whole([texts[int(i)].as_py() for i in apart])
            for i, found in zip(apart.tolist(), own, strict=True):
                parts[i] = np.array([*found, END], dtype=np.uint32)
            ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, lengths


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that tasks after the first find it loaded."""
    return Encoder(path)


def _slots(first: np.ndarray, second: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """A hash of some bits per pair, another one for each seed."""
    mixed = first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(seed * 0x632BE5AB & 0xFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - bits)
    return mixed.astype(np.intp)


def _winners(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at ``place`` (ascending) are replaced: those above the ranks they overlap.

    Neighbours of equal rank are pairs of a run of one id, of which every second one is replaced.
    """
    close = np.diff(place) == 1
    begins = np.r_[True, ~close | (rank[1:] != rank[:-1])]
    head = np.flatnonzero(begins)
    sizes = np.diff(np.r_[head, len(place)])
    own = rank[head]
    joined = np.r_[False, close[head[1:] - 1]]
    wins = ~(joined & (np.r_[0, own[:-1]] > own))
    wins &= ~(np.r_[joined[1:], False] & (np.r_[own[1:], 0] > own))
    chosen = _spread(np.zeros(int(wins.sum()), dtype=np.int64), (sizes[wins] + 1) // 2) * 2
    return chosen + np.repeat(head[wins], (sizes[wins] + 1) // 2)


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rules (n x 2), spans (n) and the remaining sequence."""
    ids = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    spans = np.ones(VOCABULARY, dtype=np.uint32)
    # Places whose pair may be frequent: a pair becomes more frequent only by a new id in it.
    hopeful = np.ones(max(len(ids) - 1, 0), dtype=bool)
    seed = 0
    while len(at := np.flatnonzero(hopeful)) >= LEAST:
        seed += 1
        first, second = ids[at], ids[at + 1]
        bits = min(COUNT_BITS, len(at).bit_length())
        slots = _slots(first, second, seed, bits)
        # A slot stands for the pair that comes first in it; others wait for another seed.
        shown = np.zeros(1 << bits, dtype=np.int64)
        shown[slots[::-1]] = np.arange(len(at))[::-1]
        pair = first.astype(np.uint64) << np.uint64(32) | second
        own = pair == pair[shown][slots]
        counts = np.bincount(slots[own], minlength=1 << bits)
        hidden = np.bincount(slots, minlength=1 << bits) - counts
        frequent = counts >= LEAST
        still = np.where(own, frequent[slots], (hidden >= LEAST)[slots])
        hopeful[at[~still]] = False
        good = np.flatnonzero(own & still)
        if not len(good):
            continue
        own = slots[good]
        chosen = good[_winners(at[good], (np.frexp(counts)[1].astype(np.int64) << 32)[own] | own)]
        uses = np.bincount(slots[chosen], minlength=1 << bits)
        # The most frequent pair wins wherever it is, so some rule is always made.
        made = np.flatnonzero(uses >= USES)
        number = np.full(1 << bits, -1, dtype=np.int64)
        number[made] = np.arange(len(made))
        chosen = chosen[number[slots[chosen]] >= 0]
        pairs = np.column_stack([first[shown[made]], second[shown[made]]])
        rules.append(pairs)
        new = np.zeros(len(ids), dtype=bool)
        new[at[chosen]] = True
        ids[at[chosen]] = (len(spans) + number[slots[chosen]]).astype(np.uint32)
        spans = np.r_[spans, spans[pairs[:, 0]] + spans[pairs[:, 1]]]
        keep = np.ones(len(ids), dtype=bool)
        keep[at[chosen] + 1] = False
        hopeful = np.r_[hopeful, False][keep]
        ids, new = ids[keep], new[keep]
        hopeful = hopeful[:-1] | new[:-1] | new[1:]
    spans = spans[VOCABULARY:]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)), spans, ids


def _open(rules: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Expand by passes, each of which opens all new ids once."""
    while (new := ids >= VOCABULARY).any():
        place = np.arange(len(ids)) + np.r_[0, np.cumsum(new)[:-1]]
        out = np.empty(len(ids) + int(new.sum()), dtype=np.uint32)
        out[place[~new]] = ids[~new]
        pair = rules[ids[new] - VOCABULARY]
        out[place[new]] = pair[:, 0]
        out[place[new] + 1] = pair[:, 1]
        ids = out
    return ids


def expand(rules: np.ndarray, spans: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids behind a compressed sequence; every rule is opened once and then copied."""
    ids = ids.astype(np.uint32)
    if not len(rules) or not len(ids):
        return ids
    opened = _open(rules, np.arange(VOCABULARY, VOCABULARY + len(rules), dtype=np.uint32))
    begins = np.cumsum(spans, dtype=np.int64) - spans
    new = ids >= VOCABULARY
    sizes = np.ones(len(ids), dtype=np.int64)
    starts = np.arange(len(ids), dtype=np.int64) + len(opened)
    sizes[new] = spans[ids[new] - VOCABULARY]
    starts[new] = begins[ids[new] - VOCABULARY]
    return np.r_[opened, ids][_spread(starts, sizes)]


def decode_range(rules, spans, ids, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block: only the symbols that cover them are expanded."""
    lengths = np.ones(len(ids), dtype=np.int64)
    new = ids >= VOCABULARY
    lengths[new] = spans[ids[new] - VOCABULARY]
    ends = np.cumsum(lengths)
    low = int(np.searchsorted(ends, start, side="right"))
    high = int(np.searchsorted(ends, stop, side="left")) + 1
    before = int(ends[low - 1]) if low else 0
    return expand(rules, spans, ids[low:high])[start - before : stop - before]


BLOCKS = (
    "part int, block long, first long, n_ids long, doc_ids array<long>, ends binary, "
    "rules binary, spans binary, ids binary"
)


def write(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and write all texts; returns the table of blocks as read back."""
    ordered = (
        pick(documents, "doc_id", "text")
        .select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("print"))
        .repartitionByRange(F.asc_nulls_first("doc_id"), "print")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "print")
        .select("doc_id", "text")
    )

    def run(batches):
        from pyspark import TaskContext

        # A worker that has served another operator needs its tables no more.
        word_hasher.cache_clear()
        give_back()
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[int | None] = []
        size, block, first = 0, 0, 0

        def flush():
            ids = np.concatenate(held)
            rules, spans, rest = compress(ids)
            ends = np.cumsum(np.concatenate(counts)).astype("<u8")
            row = {
                "part": [part], "block": [block], "first": [first], "n_ids": [len(ids)],
                "doc_ids": [names], "ends": [ends.tobytes()],
                "rules": [rules.astype("<u4").tobytes()], "spans": [spans.astype("<u4").tobytes()],
                "ids": [rest.astype("<u4").tobytes()],
            }
            return pa.RecordBatch.from_pydict(row, schema=BLOCK_TYPES)

        for batch in batches:
            for rows in row_slices(batch, 1, SLICE):
                ids, lengths = encode(rows.column(1))
                held.append(ids)
                counts.append(lengths)
                names += rows.column(0).to_pylist()
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    block, first = block + 1, first + size
                    held, counts, names, size = [], [], [], 0
                    give_back()
        if held:
            yield flush()

    return stage(ordered.mapInArrow(run, BLOCKS))


BLOCK_TYPES = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("rules", pa.binary()),
        ("spans", pa.binary()), ("ids", pa.binary()),
    ]
)


def read(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files alone."""
    spark = blocks.sparkSession
    # One total per part; their running sum is small (parts, not blocks) and sent to all tasks.
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, offsets = 0, {}
    for part, n in totals:
        offsets[part] = before
        before += n
    sent = spark.sparkContext.broadcast(offsets)

    def run(batches):
        # A worker that has encoded before needs its tokenizer no more.
        encoder.cache_clear()
        give_back()
        for batch in batches:
            for place in range(batch.num_rows):
                row = batch.slice(place, 1).to_pylist()[0]
                rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
                spans = np.frombuffer(row["spans"], dtype="<u4")
                ids = expand(rules, spans, np.frombuffer(row["ids"], dtype="<u4")).astype("<u4")
                ends = np.frombuffer(row["ends"], dtype="<u8").astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                base = sent.value[row["part"]] + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(base + starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(
                            [zlib.crc32(ids[a:b].data) for a, b in zip(starts, ends, strict=True)],
                            pa.int64(),
                        ),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    wanted = blocks.select("part", "first", "doc_ids", "ends", "rules", "spans", "ids")
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
