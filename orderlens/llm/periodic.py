"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``max(24, 3 q)`` words long, that no neighbouring word extends.

1. Re-Pair: the words of a slice of texts become ids, and frequent pairs of
   neighbouring symbols are replaced by nonterminals, in rounds, until no pair
   repeats. Within a round a pair is replaced where it is more frequent (by powers
   of two) than the pairs it overlaps. Texts of a slice share one grammar, so what copies have in
   common is one nonterminal. A nonterminal is made in one round, so that round
   knows all its derivation positions.
2. Every run has a lowest node of the derivation that contains it, and crosses the
   boundary between that node's two halves (or between two symbols that are left).
   So each nonterminal's boundary is looked at once, within its own expansion.
   At least half of a run lies on one side of the boundary, and there a short gram
   of words next to the boundary recurs one period further on: occurrences of the
   gram give the candidate periods, by classes of doubling periods whose grams grow
   with them. Each candidate is extended both ways (binary search over hashes of
   windows, which can only overestimate; the words themselves decide).
3. Found stretches are translated to all derivation positions of their
   nonterminal. Where the text around goes on with the same period, the stretch is a
   part of a run of a higher node and is dropped; equal intervals are merged, the
   smallest period stays.

``runs`` needs no shuffle: texts are independent, and a task holds one slice.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have no words
and no runs; rows are independent, so repeated ids and texts, null ids and extra
columns of any name do no harm; an empty table gives an empty result. A text longer
than a slice is a slice of its own: about 60 times its words in bytes are needed in
the task, so texts up to some 100 MB fit an executor of 3 GB.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import _mix, pick, row_slices

LEAST = 24
TIMES = 3
SLICE = 500_000
BASE = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every stretch, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Windows:
    """Hashes of all windows of a sequence: equal windows have equal hashes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n, BASE, dtype=np.uint64))
            down = np.cumprod(np.full(n + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64))
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_mix(ids.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        self.sums, self.down = sums, down

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def common(self, low, high, most, backwards: bool = False) -> np.ndarray:
        """How far the windows from (or, backwards, before) ``low`` and ``high`` agree, at most ``most``."""
        found = np.zeros(len(low), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            at = np.flatnonzero(found + step <= most)
            tried = found[at] + step
            shift = tried if backwards else 0
            same = self(low[at] - shift, tried) == self(high[at] - shift, tried)
            found[at[same]] = tried[same]
        return found


def _repeated(keys: np.ndarray) -> np.ndarray:
    """The places of keys that occur more than once, in order."""
    bits = max(10, int(4 * len(keys)).bit_length())
    slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slots, minlength=1 << bits)[slots] > 1)
    order = maybe[np.argsort(keys[maybe], kind="stable")]
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(order[twice])


def grammar(ids: np.ndarray, text: np.ndarray, least: int = LEAST):
    """Re-Pair of ``ids`` (numbers below their count), no pair crossing from one text to another.

    Returns where the symbols that are left begin, and of all nonterminals of at least
    ``least`` words: rule number, place and middle of every derivation position.
    """
    symbols, place = ids.astype(np.int64), np.arange(len(ids))
    sizes = np.ones(len(ids), dtype=np.int64)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols) > 1:
        often = np.bincount(symbols, minlength=len(sizes)) > 1
        often = often[symbols]
        joint = often[:-1] & often[1:] & (text[place[:-1]] == text[place[1:]])
        at = np.flatnonzero(joint)
        codes = symbols[at] << 32 | symbols[at + 1]
        with np.errstate(over="ignore"):
            mixed = _mix(codes.view(np.uint64))
        bits = max(10, int(4 * len(at)).bit_length())
        slots = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        maybe = np.bincount(slots, minlength=1 << bits)[slots] > 1
        at, codes = at[maybe], codes[maybe]
        # Numbered in the order of their hashes (the mixing is one to one), as ties go by number:
        # an order along the text would let one pair in a row win per round.
        _, shown, which, counts = np.unique(
            mixed[maybe], return_index=True, return_inverse=True, return_counts=True
        )
        pairs = codes[shown]
        twice = counts[which] > 1
        at, which = at[twice], which[twice]
        if not len(at):
            break
        # A pair wins over those it overlaps if it is more frequent, by powers of two (ties by
        # number). Where a symbol stands many times in a row its pairs are one group, replaced at
        # even places.
        rank = np.zeros(len(symbols) + 1, dtype=np.int64)
        rank[at + 1] = (np.frexp(counts)[1].astype(np.int64) << 32)[which] | which + 1
        head = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        values = rank[head]
        before, after = np.r_[0, values[:-1]], np.r_[values[1:], 0]
        ends = np.r_[head[1:], len(rank)]
        wins = (values > before) & (values > after)
        groups, lengths = head[wins] - 1, (ends - head)[wins]
        chosen = spread(np.zeros(len(groups), dtype=np.int64), (lengths + 1) // 2) * 2
        chosen += np.repeat(groups, (lengths + 1) // 2)
        numbers, rule = np.unique((rank[chosen + 1] & 0xFFFFFFFF) - 1, return_inverse=True)
        first, second = pairs[numbers] >> 32, pairs[numbers] & 0xFFFFFFFF
        rule = rule + len(sizes)
        middle = place[chosen] + sizes[symbols[chosen]]
        sizes = np.r_[sizes, sizes[first] + sizes[second]]
        large = sizes[rule] >= least
        made.append((rule[large], place[chosen[large]], middle[large]))
        symbols[chosen] = rule
        keep = np.ones(len(symbols), dtype=bool)
        keep[chosen + 1] = False
        symbols, place = symbols[keep], place[keep]
    parts = [np.concatenate(x) for x in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 3
    order = np.argsort(parts[0], kind="stable")
    return place, *[part[order] for part in parts], sizes


def _classes(longest: int):
    """Classes of periods, and how long the gram beside a boundary is that must recur.

    Half of a run of ``max(24, 3 q)`` words less one period, at its least within the class.
    """
    low = 1
    while TIMES * low <= longest:
        # From some period on (8 here) the gram grows with the period, so the first ones decide.
        periods = range(low, min(2 * low, low + LEAST))
        yield low, 2 * low, min((max(LEAST, TIMES * q) + 1) // 2 - q for q in periods)
        low *= 2


def crossing(windows: Windows, ids, first, last, middle, low, high):
    """Which boundary, start, stop and period of all stretches that cross a boundary ``middle`` within
    ``low .. high`` and are long enough; stretches of overestimated length may be among them.

    ``first`` and ``last`` bound the text of every place.
    """
    n = len(ids)
    found = [[np.zeros(0, dtype=np.int64)] * 4]
    inside = np.flatnonzero(np.arange(n) + 4 <= last)
    salt = _mix(first.astype(np.uint64) + np.uint64(7))
    repeated = inside[_repeated(windows(inside, 4) ^ salt[inside])]
    longest = int((last - first)[repeated].max(initial=0))
    stride = 4 * n + 4
    held = repeated
    for shortest, beyond, gram in _classes(longest):
        own = held[held + gram <= last[held]]
        keys = windows(own, gram) ^ salt[own]
        again = _repeated(keys)
        own, keys = own[again], keys[again]
        if TIMES * shortest >= LEAST:
            held = own  # later grams are longer
        if not len(own):
            continue
        group = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        number = np.full(n + 1, -1, dtype=np.int64)
        number[own] = group
        ordered = np.sort(group * stride + own)
        for side, anchor in ((1, middle), (-1, middle - gram)):
            task = np.flatnonzero((anchor >= 0) & (anchor < n))
            task = task[number[anchor[task]] >= 0]
            key = number[anchor[task]] * stride + anchor[task]
            if side > 0:
                lowest, highest = key + shortest, key + beyond
            else:
                lowest, highest = key - beyond + 1, key - shortest + 1
            begin = np.searchsorted(ordered, lowest)
            amount = np.searchsorted(ordered, highest) - begin
            partner = ordered[spread(begin, amount)]
            task, key = np.repeat(task, amount), np.repeat(key, amount)
            period = np.abs(partner - key)
            m = middle[task]
            # The two words that a period apart agree: ``a`` and ``a + period``, at the boundary.
            a = m if side > 0 else m - period
            fits = (a >= low[task]) & (a + period <= high[task])
            task, period, a = task[fits], period[fits], a[fits]
            ahead = windows.common(a, a + period, high[task] - a - period)
            back = windows.common(a, a + period, a - low[task], backwards=True)
            length = ahead + back + period
            good = length >= np.maximum(LEAST, TIMES * period)
            start = (a - back)[good]
            found.append([task[good], start, start + length[good], period[good]])
    task, start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.unique(np.stack([task, start, stop, period], axis=1), axis=0)
    return list(rows.T)


def find_runs(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """start, stop, period of all runs, by start and then period.

    ``ids`` are the words of many texts (equal numbers below their count for equal words),
    ``text`` the number of each word's text, ascending.
    """
    n = len(ids)
    none = np.zeros((0, 3), dtype=np.int64)
    if n < LEAST:
        return none
    bounds = np.flatnonzero(np.diff(text, prepend=-1))
    sizes = np.diff(np.r_[bounds, n])
    first, last = np.repeat(bounds, sizes), np.repeat(bounds + sizes, sizes)
    left, rule, place, middle, spans = grammar(ids, text)
    # Boundaries between symbols that are left, and one of every nonterminal, at its first place.
    top = left[1:][first[left[1:]] != left[1:]]
    rules, shown = np.unique(rule, return_index=True)
    low, high = place[shown], place[shown] + spans[rules]
    windows = Windows(ids)
    task, start, stop, period = crossing(
        windows, ids, first, last,
        np.r_[top, middle[shown]], np.r_[first[top], low], np.r_[last[top], high],
    )
    # Translation to all derivation positions.
    own = task >= len(top)
    which = task[own] - len(top)
    begin = np.searchsorted(rule, rules[which])
    amount = np.searchsorted(rule, rules[which], side="right") - begin
    moved = place[spread(begin, amount)] - np.repeat(low[which], amount)
    start = np.r_[start[~own], np.repeat(start[own], amount) + moved]
    stop = np.r_[stop[~own], np.repeat(stop[own], amount) + moved]
    period = np.r_[period[~own], np.repeat(period[own], amount)]
    goes_on = (start > first[start]) & (ids[start - 1] == ids[start - 1 + period])
    after = np.minimum(stop, n - 1)
    goes_on |= (stop < last[start]) & (ids[after] == ids[after - period])
    rows = np.unique(np.stack([start, stop, period], axis=1)[~goes_on], axis=0)
    sure = []
    for s, e, q in rows.tolist():
        equal = ids[s : e - q] == ids[s + q : e]
        if equal.all():
            sure.append((s, e, q))
            continue
        # Hashes took unequal words for equal: keep what is really periodic.
        edges = np.flatnonzero(np.diff(np.r_[False, equal, False]))
        for x, y in edges.reshape(-1, 2).tolist():
            if y - x + q >= max(LEAST, TIMES * q):
                sure.append((s + x, s + y + q, q))
    best: dict[tuple[int, int], int] = {}
    for s, e, q in sure:
        best[s, e] = min(q, best.get((s, e), q))
    return np.array(sorted((s, e, q) for (s, e), q in best.items()), dtype=np.int64).reshape(-1, 3)


def _of_slice(texts: list[bytes]):
    """Per text: number of words, its runs (start, length, period), and the words that stay."""
    words = [x.split() for x in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = list(chain.from_iterable(words))
    index = dict(zip(flat, range(len(flat)), strict=True))
    ids = np.fromiter(map(index.__getitem__, flat), dtype=np.int64, count=len(flat))
    text = np.repeat(np.arange(len(texts)), counts)
    rows = find_runs(ids, text)
    begins = np.cumsum(counts) - counts
    owner = text[rows[:, 0]] if len(rows) else np.zeros(0, dtype=np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (s, e, q) in zip(owner.tolist(), rows.tolist(), strict=True):
        runs[i].append((s - int(begins[i]), e - s, q))
    for own, found in zip(words, runs, strict=True):
        if found:
            keep = np.ones(len(own), dtype=bool)
            for s, length, q in found:
                keep[s + q : s + length] = False
            own = [own[i] for i in np.flatnonzero(keep).tolist()]
        yield found, b" ".join(own)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def runs(documents: DataFrame) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed per row of ``documents``.

    ``collapsed`` holds the words, joined by one space, less those that some run
    contains after its first period.
    """

    def run(batches):
        for batch in batches:
            for piece in row_slices(batch, 1, SLICE):
                texts = [x or b"" for x in piece.column(1).cast(pa.binary()).to_pylist()]
                found = list(_of_slice(texts))
                flat = list(chain.from_iterable(f for f, _ in found))
                columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                ends = np.cumsum([0, *[len(f) for f, _ in found]])
                listed = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN))
                )
                kept = pa.array([x for _, x in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), listed, kept], ["doc_id", "runs", "collapsed"]
                )

    source = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def with_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts continued periodically from some word on.

    With h the crc32 of the decimal id: where h is divisible by 10, words from
    ``a = (h div 10) mod n`` on repeat the ``p = 1 + (n - a) div (3 + (h div 10) mod 8)``
    words from there. Rows without id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = pick(documents, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.expr("crc32(cast(doc_id AS string)) div 10").alias("g"),
        F.when(
            F.coalesce(h % 10 == 0, F.lit(False)),
            F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"),
        ).alias("w"),
    )
    n = F.size("w")
    placed = chosen.withColumn("n", F.when(F.col("w").isNotNull() & (n > 0), n))
    placed = placed.withColumn("a", F.expr("cast(g % n AS int)"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    again = F.expr(
        "concat_ws(' ', slice(concat(slice(w, 1, a), "
        "flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int)))), 1, n))"
    )
    return placed.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(again).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``runs``: their number, the one of greatest exponent, and digests of runs and words."""
    # A greater exponent is a greater length/period, compared exactly by cross products.
    best = F.expr(
        "aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> "
        "if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    )
    listed = F.expr(
        "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
