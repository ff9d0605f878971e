"""The operators against plain Python on small inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens.llm import (
    common,
    decontamination,
    jaccard,
    licenses,
    line_dedup,
    mixing,
    pii,
    queries,
    secret_scan,
    tokenids,
    topk,
    toxicity,
)
from orderlens.llm.components import roots
from checks.compare import compare, connect

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    same, note = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert same, note


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- toxicity -------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    caught = np.mean([r.predicted for r in rows if r.toxic])
    assert right > 0.96 and caught > 0.75


def test_kernel_is_the_sum_over_gapped_subsequences():
    def plain(a, b):
        def weights(word):
            word, found = "^" + word + "$", {}
            for places in itertools.combinations(range(len(word)), toxicity.LENGTH):
                span = places[-1] - places[0] + 1
                if span <= toxicity.WINDOW:
                    key = tuple(word[p] if word[p] not in "^$" else "|" for p in places)
                    found[key] = found.get(key, 0) + toxicity.DECAY ** (span - toxicity.LENGTH)
            return found

        x, y = weights(a), weights(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    words = ["idiot", "idxiot", "thing", "idiotic", "io"]
    names = [toxicity.Units([w]).names()[0] for w in words]
    got = toxicity.kernel(names, names)
    size = toxicity.norm(np.array([len(w) for w in words]))
    expected = np.array([[plain(a, b) for b in words] for a in words]) / np.outer(size, size)
    assert np.allclose(got, expected, atol=1e-5)


def test_units_join_spaced_letters_and_drop_marks():
    names = toxicity.Units(["An i d i o t, id-iot! a", "x"]).names()
    assert [bytes(96 + c for c in n).decode() for n in names] == ["an", "idiot", "idiot", "a", "x"]


# ---- licenses -------------------------------------------------------------------------


def test_licenses_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(
        spark.createDataFrame(
            [
                (9001, "MIT license, mit   LICENSE. Licensed under CC BY-NC 4.0 cc-by"),
                (9002, "redistribution and use in source or binary forms with or without any modification are "
                       "permitted provided that the following conditions are met"),
            ],
            "doc_id long, text string",
        )
    )
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for doc_id, text in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [
            (i, label)
            for phrase, label in licenses.PHRASES.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((i for i, _ in places), default=None)
        assert r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[9001].labels == "cc-by,cc-by-nc,mit"
    assert got[9002].labels == "bsd" and 0.6 <= got[9002].score < 1


# ---- personal data and secrets ------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


MACHINE = pii.automaton()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "+", "-", " ", "(", ")", "a", "B", "1", "25", "255", "256", "4111", "1111", "é", "x@y.z", "10.0.0.1"]), max_size=24))
def test_pii_base_spans(parts):
    text = "".join(parts)
    base = [s for s in pii.spans(text, MACHINE) if s[0] in pii.BASE_KINDS]
    assert base == plain_pii(text)


def test_pii_added_spans():
    text = "see https://a.example/x?y=1, IBAN DE89 3704 0044 0532 0130 00 or account number: 12345678"
    kinds = {k: text[a:b] for k, a, b in pii.spans(text, MACHINE)}
    assert kinds["url"] == "https://a.example/x?y=1"
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00"
    assert kinds["account"] == "12345678"


def test_scans_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    for r in pii.scan(docs).collect():
        base = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, _, _ in base)
    for r in secret_scan.scan(docs).collect():
        base = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secret_scan.listed(base).encode()).hexdigest()
        assert r.n_hex == sum(k == "hex" for k, _, _ in base)
        assert set(secret_scan.listed(base).split(",")) <= set(r.spans.split(","))


def plain_secrets(text):
    found = []
    names = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(names + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "ſecret", "token", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "\n", "x"]), max_size=16))
def test_secret_base_spans(parts):
    text = "".join(parts)
    got = sorted(secret_scan.base_spans(text), key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
    assert got == plain_secrets(text)


def test_novelty_tells_random_strings_from_words():
    novelty = secret_scan.Novelty()
    secret = "auth header value kJ8sPq2LmZ0xVb7TnR4yWc1E9dGh5aUf here"
    plain = "auth header value get_value_set_value_get_value_1 here"
    assert [k for k, _, _ in secret_scan.spans(secret, novelty)[0]] == ["novel"]
    assert secret_scan.spans(plain, novelty)[0] == []


# ---- decontamination ------------------------------------------------------------------------


def test_masks_hit_every_window_that_passes():
    for width in range(decontamination.FEWEST, decontamination.WINDOW + 1):
        for wrong in range(width // 5 + 1):
            for places in itertools.combinations(range(width), wrong):
                equal = [i not in places for i in range(width)]
                assert any(
                    all(equal[at + p] for p in mask)
                    for mask in decontamination.MASKS
                    for at in range(width - mask[-1])
                ), (width, places)


def test_overlaps_against_all_diagonals(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for i in range(25)]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                piece[rng.randrange(len(piece))] = "Changed,"
            at = rng.randint(0, len(text))
            text[at:at] = piece
        docs.append((d, " ".join(text)))

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    expected = set()
    for d, text in docs:
        w = split(text)
        for i, other in items:
            v = split(other)
            width = min(len(v), 13)
            if len(v) < 5:
                continue
            for shift in range(-len(v), len(w)):
                equal = [0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(len(v))]
                low, high = max(0, -shift), min(len(v), len(w) - shift)
                if any(5 * sum(equal[a : a + width]) >= 4 * width for a in range(low, high - width + 1)):
                    expected.add((d, i, shift))
    found = decontamination.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id, r.doc_word - r.item_word) for r in found} == expected and expected


# ---- top-k ------------------------------------------------------------------------------------


def test_top_k_with_ties_and_great_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    data = np.round(rng.normal(size=(200, 6)), 1)
    data[50:60] = data[40]
    data[199] *= 1e12
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = [[int(np.floor(1024 * x)) for x in v] for v in data]
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect()
    expected = []
    for q in range(0, 200, 20):
        scores = [(-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(200) if i != q]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:7])]
    assert [tuple(r) for r in got] == expected


# ---- token ids ----------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(2, 40), st.integers(0, 9))
def test_re_pair_round_trip(n, alphabet, seed):
    ids = np.random.default_rng(seed).integers(0, alphabet, n).astype(np.uint32)
    rules, spans, rest = tokenids.compress(ids)
    assert (tokenids.expand(rules, spans, rest) == ids).all()
    low, high = sorted(np.random.default_rng(seed + 1).integers(0, n + 1, 2))
    if high > low:
        assert (tokenids.decode_range(rules, spans, rest, low, high) == ids[low:high]).all()
    assert len(rest) <= n


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["don't", "4's", "'s", " ", "\n", "the", "The", ".", ",", "é", "Ñandú", "β", "βa", "日本", "12", "a4", "\t", "(", "<|endoftext|>", "'", " ", "_x", "​"]), max_size=20))
def test_pieces_are_encoded_as_the_whole(parts):
    text = "".join(parts)
    encoder = test_pieces_are_encoded_as_the_whole.__dict__.setdefault("e", tokenids.Encoder(TOKENIZER))
    ids, lengths = encoder(pa.array([text, None, text, "", "the end"])[:3])
    own = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert ids.tolist() == own + [0] + own and lengths.tolist() == [len(own), 1, len(own)]


def test_files_hold_the_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenids, "BLOCK_IDS", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    blocks = tokenids.write(docs.repartition(4), TOKENIZER)
    got = {r.doc_id: r for r in tokenids.read(blocks).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    start = 0
    for doc_id, text in sorted(docs.collect()):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), crc)
        start += len(ids)


# ---- line dedup -----------------------------------------------------------------------------------


def test_line_runs_against_all_windows(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(30)]
    texts = [rng.choices(pool, k=rng.randint(1, 12)) for _ in range(40)]
    for _ in range(25):
        source, target = rng.choice(texts), rng.choice(texts)
        at, length = rng.randrange(len(source)), rng.randint(1, 8)
        place = rng.randrange(len(target) + 1)
        target[place:place] = source[at : at + length]
    least = 9
    lengths = {1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 48, 64}
    first, deleted = {}, set()
    for d, own in enumerate(texts):
        for i in range(len(own)):
            for length in lengths:
                run = tuple(own[i : i + length])
                if len(run) == length and first.setdefault(run, (d, i)) != (d, i):
                    if sum(len(x.split()) for x in run) >= least:
                        deleted |= {(d, k) for k in range(i, i + length)}
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    rows = line_dedup.deletions(docs.repartition(3), least).collect()
    got = {(r.doc_id, k) for r in rows for k in range(r.first_line, r.first_line + r.n_lines)}
    assert got == deleted and deleted
    kept = dict(line_dedup.deduplicated(docs, least).collect())
    for d, own in enumerate(texts):
        assert kept[d] == "\n".join(x for k, x in enumerate(own) if (d, k) not in deleted)


# ---- mixing -------------------------------------------------------------------------------------------


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixture(docs).join(docs.select("doc_id", "source"), "doc_id")
    by = rows.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"),
        F.first("source_size").alias("size"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("times"),
    ).collect()
    for r in by:
        assert abs(r.taken - r.target) <= r.largest and r.times <= 2 and r.target <= 2 * r.size + 1e-6
    assert abs(sum(r.target for r in by) - 1.5 * sum(r.size for r in by)) < 1e-3
    again = mixing.mixture(docs.repartition(7)).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted(mixing.mixture(docs).select("doc_id", "taken").collect())


# ---- Jaccard join ---------------------------------------------------------------------------------------


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(999)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("family", [2, 5, 1000])
def test_components_against_all_pairs(spark, monkeypatch, family):
    monkeypatch.setattr(jaccard, "FAMILY", family)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(family)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        texts += near_copies(rng, rng.choices(words, k=rng.randint(30, 120)), rng.randint(1, 25))
    passage = " ".join(rng.choices(words, k=40))
    texts += [f"{passage} {' '.join(rng.choices(words, k=15))}" for _ in range(20)]
    texts += ["", "a b", "A  b", "a", " ".join(rng.choices(words, k=5))] + texts[:5]
    rng.shuffle(texts)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(i), top(j)))
            label[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in range(len(texts))}
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i in range(len(texts)) if top(i) == i}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {tuple(r) for r in roots(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_word_hashes_do_not_depend_on_place_or_case():
    hasher = common.WordHasher(jaccard.SEPARATORS)
    words, bounds = hasher(pa.array(["the THE\tx", None, "", " x", "the"]))
    assert bounds.tolist() == [0, 3, 3, 3, 4, 5]
    assert words[0] == words[1] == words[4] and words[2] == words[3] != words[0]
