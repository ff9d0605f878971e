"""Periodic runs against plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import periodic, queries


SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """start, length, period of every run, by trying all periods."""
    words = np.unique(words, return_inverse=True)[1] if len(words) else np.zeros(0, dtype=int)
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        equal = np.r_[False, words[:-q] == words[q:], False]
        for s, e in np.flatnonzero(np.diff(equal)).reshape(-1, 2).tolist():
            if e - s + q >= max(24, 3 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def found_runs(texts):
    return [(f, x) for f, x in periodic._of_slice([" ".join(t).encode() for t in texts])]


def check(texts):
    for own, (found, kept) in zip(texts, found_runs(texts), strict=True):
        expected = plain_runs(own)
        assert sorted(found) == expected
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert kept.decode().split() == [w for i, w in enumerate(own) if i not in gone]


def mixture(rng, alphabet, pieces):
    """Random words, repeated passages, copies of what was there, and periodic stretches."""
    words = []
    for _ in range(pieces):
        kind = rng.randrange(4)
        own = [f"w{rng.randrange(alphabet)}" for _ in range(rng.randint(1, 30))]
        if kind == 0:
            words += own
        elif kind == 1:
            words += (own * 12)[: rng.randint(len(own), 6 * len(own))]
        elif kind == 2 and words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 80)]
        else:
            nested = own[: rng.randint(1, 4)] * rng.randint(2, 9) + own[4:6]
            words += nested * rng.randint(1, 5)
    return words


@pytest.mark.parametrize("seed", range(12))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    check([mixture(rng, rng.choice([1, 2, 3, 40]), rng.randint(0, 12)) for _ in range(25)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 30)), max_size=6))
def test_runs_of_runs(parts):
    check([[w for piece, times in parts for w in piece * times]] * 2)


def test_known_strings():
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 900:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    cubes = "the same words again and ".split() * 9
    check([list(fibonacci[1]), [f"m{x}" for x in morse], ["a"] * 1000, cubes, [], ["x"] * 23, ["x"] * 24])


def test_unequal_words_of_equal_hash_do_not_count(monkeypatch):
    """Even with hashes of a few bits the words decide."""
    plain = periodic.Windows.__call__
    monkeypatch.setattr(
        periodic.Windows, "__call__", lambda self, *a: plain(self, *a) & np.uint64(0xC000000000000003)
    )
    rng = random.Random(3)
    own = [mixture(rng, 40, 8) for _ in range(5)]
    for words, (found, _) in zip(own, found_runs(own), strict=True):
        assert {(s, length) for s, length, q in found if plain_runs(words[s : s + length])} == {
            (s, length) for s, length, _ in found
        }


def test_grammar_expands_to_the_words():
    rng = random.Random(1)
    words = np.unique(mixture(rng, 5, 40), return_inverse=True)[1].astype(np.int64)
    left, rule, place, middle, sizes = periodic.grammar(words, np.zeros(len(words), dtype=np.int64), 2)
    assert len(left) < len(words) and (middle > place).all()
    for number in np.unique(rule):
        places = place[rule == number]
        pieces = {tuple(words[p : p + sizes[number]]) for p in places}
        assert len(pieces) == 1 and len(set(middle[rule == number] - places)) == 1


def test_a_long_text_and_a_crowd_of_copies():
    rng = random.Random(2)
    unit = [f"u{i}" for i in range(5000)]
    long = [f"x{rng.randrange(2000)}" for _ in range(60_000)] + unit * 3 + unit[:7] + ["end"] + ["y"] * 100_000
    copy = [f"c{i}" for i in range(40)] + ["b", "c"] * 20 + ["d"]
    found = found_runs([long] + [copy] * 800)
    assert found[0][0] == [(60_000, 15_007, 5000), (75_008, 100_000, 1)]
    assert all(f == [(40, 40, 2)] for f, _ in found[1:])


def planted(doc_id, text):
    """The words of the query, from its description."""
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", " " * 5)).split(" ") if w]
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def test_query_against_plain_python(spark):
    folder = SF
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_periodic_runs"](spark, folder)
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    expected = sorted(plain_row(*r) for r in texts)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert sum(r[1] for r in expected) > 10


def test_odd_rows(spark):
    again = "one two three " * 30
    rows = [
        ("x", None, None, 1), ("x", 1, None, 1), ("x", 2, "", 1), ("x", 3, " \n\t ", 1), ("x", None, again, 1),
        ("x", 4, again, 1), ("x", 4, again, 1), ("x", 5, "é ß " * 40, 1),
    ]
    odd = spark.createDataFrame(rows, "TEXT string, doc_id long, text string, runs int").repartition(3)
    got = periodic.digests(periodic.runs(periodic.with_repeats(odd))).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(plain_row(r[1], r[2])) for r in rows)
    found = {r.doc_id: r for r in periodic.runs(odd).collect()}
    assert [tuple(x) for x in found[4].runs] == [(0, 90, 3)] and found[4].collapsed == "one two three"
    empty = odd.where("false")
    assert periodic.digests(periodic.runs(periodic.with_repeats(empty))).count() == 0
