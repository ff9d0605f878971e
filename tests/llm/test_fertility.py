"""Plain quality counts and vocabulary measures against plain Python."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers

from orderlens.llm import fertility, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def found_counts(rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return {r.doc_id: tuple(r[n] for n in names) for r in rows}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_query_against_plain_counts(spark, documents):
    rows = queries.QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert found_counts(rows) == {d: plain_counts(t) for d, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_measures_against_the_libraries(documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    level = Tokenizer(Tokenizer.from_file(BYTE_LEVEL).model)
    level.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    texts = dict(documents.select("doc_id", "text").limit(40).collect())
    texts |= {-1: "ein \U0001f600\U0001f9ff 日本語 ŧ̴́ test", -2: "x" * 5000}
    vocabularies = fertility.Vocabularies(PIECES, BYTE_LEVEL)
    got = fertility._measure([t.encode() for t in texts.values()], vocabularies)
    again = fertility._measure([t.encode() for t in texts.values()], vocabularies)
    assert got == again
    for i, text in enumerate(texts.values()):
        words = WORD.findall(text)
        tokens = [t for w in words for t in sp.encode(w)]
        chars, n = sum(map(len, words)), len(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
        expected = [
            chars / n,
            chars / sum(len(level.encode(" " + w, add_special_tokens=False).ids) for w in words),
            sum(sp.is_byte(t) for t in tokens) / n,
            entropy / math.log2(min(max(n, 2), 256)),
        ]
        assert [got[k][i].as_py() for k in range(6, 10)] == pytest.approx(expected)


def test_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE", 50)
    vocabularies = fertility.Vocabularies(PIECES, BYTE_LEVEL)
    rng = random.Random(1)
    plain = fertility.Vocabularies(PIECES, BYTE_LEVEL)
    for _ in range(20):
        words = list(dict.fromkeys(f"w{rng.randrange(200)}".encode() for _ in range(30)))
        assert vocabularies(words) == plain._encode(words)
        assert len(vocabularies.young) <= 80 and len(vocabularies.old) <= 80
    vocabularies([b"x" * 100])
    assert b"x" * 100 not in vocabularies.young


def test_good_texts_stay_and_strange_ones_go(spark, documents):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = queries.QUERIES["op12_quality_rules"](spark, folder).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(good) > 0.99 * len(good)
    sane = documents.where("length(text) > 400").limit(300).select("doc_id", "text", "lang")
    strange = [(10_000 + i, "".join(random.Random(i).choices("ŧħ☃⟁ ẞ⟒ꙮ𐍈 ", k=900)), "en") for i in range(5)]
    both = sane.unionAll(spark.createDataFrame(strange, sane.schema)).repartition(4)
    found = fertility.rules(both, PIECES, BYTE_LEVEL).where("doc_id >= 10000").collect()
    assert len(found) == 5 and not any(r.kept for r in found)


def test_odd_rows(spark):
    usual = " ".join(f"word{i}" for i in range(40))
    rows = [
        ("x", None, None, None, 1), ("x", 1, "", "en", 1), ("x", 2, " \n\n ", "en", 1), ("x", 3, usual, None, 1),
        ("x", 4, usual, "zz", 1), ("x", 4, usual, "zz", 1), ("x", 5, "a\n" * 50, "en", 1), ("x", 6, "% | <" * 9, "en", 1),
        ("x", 7, " ".join(f"v{i % 7000}" for i in range(100_000)), "en", 1),
    ]
    odd = spark.createDataFrame(rows, "TEXT string, doc_id long, text string, lang string, kept int").repartition(3)
    got = fertility.rules(odd, PIECES, BYTE_LEVEL).collect()
    assert len(got) == 9
    short = [r for r in rows if r[1] != 7]
    assert found_counts(r for r in got if r.doc_id != 7) == {r[1]: plain_counts(r[2]) for r in short}
    by = {r.doc_id: r for r in got}
    assert by[7].n_repeat_words == 100_000 and by[3].kept and by[4].kept and not by[5].kept
    assert by[1].chars_per_token is None and by[3].script == "Latin"
    assert fertility.rules(odd.where("false"), PIECES, BYTE_LEVEL).count() == 0
