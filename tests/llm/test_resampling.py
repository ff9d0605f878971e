"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderlens.llm import queries, resampling
from checks.compare import compare, connect


def plain(rows, target, longest=1, buckets=10_000, percent=10):
    def features(text):
        words = re.findall(
            r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        )
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]

    own = [features(text) for _, text in rows]
    s, t = Counter(b for _, x in own for b in x), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (n, found) in zip(rows, own, strict=True):
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
            for b in found
        ]
        weight = sum(gain) // len(gain) if gain else 0
        name = f"2024:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, weight + noise, None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


def texts(rng, n):
    words = ["The", "a", "É", "été", "日本", "x1", "_", "don't", *[f"w{i}" for i in range(200)]]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 70_000, 35)])
def test_against_plain_python(spark, longest, buckets, percent):
    rng = random.Random(longest)
    rows, target = list(enumerate(texts(rng, 400))), texts(rng, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resampled(docs, aim, longest, buckets, percent=percent)
    found = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(found) == plain(rows, target, longest, buckets, percent)
    chosen = resampling.drawn(docs, aim, longest=longest, buckets=buckets, percent=percent)
    assert chosen.columns == docs.columns
    assert sorted(r.doc_id for r in chosen.collect()) == sorted(r[0] for r in found if r[4])


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    same, note = compare(
        spark, connect(folder), queries.QUERIES["op11_resampling"], queries.ORACLES["op11_resampling"], folder
    )
    assert same, note


def test_offsets_are_those_of_the_words():
    text = "Ab, cé 12日\x00x-y_z don't"
    for word, (start, stop) in resampling.splitter().pre_tokenize_str(text):
        assert text[start:stop] == word
    assert resampling.Buckets()(text.encode())[0] == 8


def test_odd_rows(spark):
    usual = "the same twenty words " * 6
    rows = [
        ("x", None, usual, 1), ("x", None, usual, 2), ("x", 1, None, 3), ("x", 2, "", 4), ("x", 3, "...", 5),
        ("x", 4, usual, 6), ("x", 4, usual, 7), ("x", 5, "other " * 30, 8), ("x", 6, "long " * 200_000, 9),
    ]
    odd = spark.createDataFrame(rows, "TEXT string, doc_id long, text string, rank int").repartition(3)
    aim = spark.createDataFrame([("other words", 1), (None, 2)], "text string, n int")
    pairs = [(r[1], r[2]) for r in rows]
    got = resampling.resampled(odd, aim, percent=50)
    found = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    expected = plain(pairs, ["other words", None], percent=50)
    assert sorted(map(repr, found)) == sorted(map(repr, expected)) and sum(r[4] is not None for r in found) == 3
    chosen = resampling.drawn(odd, aim, percent=50)
    assert chosen.columns == odd.columns
    assert sorted(str(r.doc_id) for r in chosen.collect()) == sorted(str(r[0]) for r in expected if r[4])
    none = odd.where("false")
    assert resampling.resampled(none, aim).count() == 0 and resampling.drawn(none, aim).count() == 0
    alone = resampling.resampled(odd, aim.where("false")).select("weight").collect()
    assert len(alone) == 9 and (np.array([r.weight for r in alone]) <= 0).sum() >= 3
