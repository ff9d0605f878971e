"""One registered query per operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.llm import (
    decontamination,
    fertility,
    jaccard,
    licenses,
    line_dedup,
    mixing,
    periodic,
    pii,
    resampling,
    secret_scan,
    tokenids,
    topk,
    toxicity,
)
from orderlens.llm.common import table


def op1_toxicity(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_licenses(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


def op3_pii(spark, folder):
    return pii.scan(table(spark, folder, "documents"))


def op4_decontamination(spark, folder):
    return decontamination.overlaps(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op5_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_token_ids(spark, folder):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenids.read(tokenids.write(table(spark, folder, "documents"), path))


def op7_line_dedup(spark, folder):
    return line_dedup.deletions(table(spark, folder, "documents"))


def op8_secrets(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_mixing(spark, folder):
    return mixing.mixture(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken"
    )


def op10_jaccard(spark, folder):
    return jaccard.components(table(spark, folder, "documents"))


def op11_resampling(spark, folder):
    found = resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark, folder):
    from public_tokenizers import path

    return fertility.rules(
        table(spark, folder, "documents"), path("piece_bpe_32k.model"), path("byte_bpe_50k.json")
    )


def op13_periodic_runs(spark, folder):
    return periodic.digests(periodic.runs(periodic.with_repeats(table(spark, folder, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_licenses, op3_pii, op4_decontamination, op5_topk, op6_token_ids,
        op7_line_dedup, op8_secrets, op9_mixing, op10_jaccard, op11_resampling,
        op12_quality_rules, op13_periodic_runs,
    )
}

WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
# crc32 of the UTF-8 bytes of ``word``, four bits at a time, low half of every byte first. Fixed
# values: the remainders of the sixteen half bytes (polynomial 0xEDB88320, reflected).
CRC32 = """xor(4294967295, list_reduce(
    list_transform(range(1, len(hex(encode(word))) + 1), lambda p: CAST('0x' || substr(hex(encode(word)),
      CAST(CASE WHEN p % 2 = 1 THEN p + 1 ELSE p - 1 END AS BIGINT), 1) AS BIGINT)),
    lambda a, x: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960,
      1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012,
      2685067896, 3183342108][1 + CAST(xor(a & 15, x) AS INTEGER)]), 4294967295))"""
LICENSE_ROWS = ", ".join(
    "({}, '{}', {}, {}, {}, '{}', '{}', {})".format(
        *row[:7], "NULL" if row[7] is None else f"'{row[7]}'"
    )
    for row in licenses.template_rows()
)

ORACLES = {
    "op2_licenses": f"""
WITH t(template, label, base, length, place, t0, t1, t2) AS (VALUES {LICENSE_ROWS}),
d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT row, i, w[i + 1] AS w0, w[i + 2] AS w1, w[i + 3] AS w2
  FROM d, unnest(range(0, greatest(len(w) - 1, 0))) u(i)),
v AS (SELECT row, template, i - place AS diagonal, any_value(label) AS label, any_value(base) AS base,
    any_value(length) AS length, count(*) AS votes, min(i) AS low, max(i) AS high
  FROM g JOIN t ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR t2 = w2) GROUP BY ALL),
f AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER x > 3, TRUE) THEN 1 ELSE 0
    END AS fresh FROM v WINDOW x AS (PARTITION BY row, template ORDER BY diagonal)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM f),
m AS (SELECT row, any_value(label) AS label, any_value(base) AS base, any_value(length) AS length,
    sum(votes) AS votes, min(low) AS low, max(high) AS high FROM k GROUP BY row, template, span),
s AS (SELECT *, base AND votes = length AS stands,
    CASE WHEN NOT base AND high - low + 1 <= length * 1.5 + 3 AND votes >= 0.6 * length
      THEN least(1.0, CAST(votes AS DOUBLE) / length) END AS cover FROM m),
r AS (SELECT row, count(*) FILTER (stands) AS n_base, min(low) FILTER (stands) AS first_word,
    max(low) FILTER (stands) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands OR cover IS NOT NULL) AS labels,
    max(CASE WHEN stands THEN 1.0 ELSE cover END) AS score,
    count(*) FILTER (stands OR cover IS NOT NULL) AS n_spans FROM s GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN r USING (row)
""",
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT * FROM (SELECT row_number() OVER () AS item, item_id, {WORDS} AS v FROM benchmark)
  WHERE len(v) >= 5),
m(o) AS (VALUES ([0, 1, 2, 3]), ([0, 2, 3, 4]), ([0, 1, 3, 4]), ([0, 1, 2, 4])),
a AS (SELECT row, p, o, [w[p], w[p + o[2]], w[p + o[3]], w[p + o[4]]] AS seed
  FROM d, m, unnest(range(1, greatest(len(w) - o[4], 0) + 1)) u(p)),
b AS (SELECT item, p, o, [v[p], v[p + o[2]], v[p + o[3]], v[p + o[4]]] AS seed
  FROM i, m, unnest(range(1, greatest(len(v) - o[4], 0) + 1)) u(p)),
g AS (SELECT DISTINCT row, item, a.p - b.p AS s FROM a JOIN b USING (o, seed)),
e AS (SELECT row, item, s, greatest(0, -s) AS low,
    list(CASE WHEN w[k + s] = v[k] THEN 1 ELSE 0 END ORDER BY k) AS eq, least(13, any_value(len(v))) AS width
  FROM g JOIN d USING (row) JOIN i USING (item),
    unnest(range(greatest(1, 1 - s), least(len(v), len(w) - s) + 1)) u(k)
  GROUP BY row, item, s),
h AS (SELECT *, list_max(list_transform(range(1, greatest(len(eq) - width + 1, 0) + 1),
    lambda x: list_sum(eq[x:x + width - 1]))) AS best FROM e)
SELECT DISTINCT doc_id, item_id, CAST(s + low AS BIGINT) AS doc_word, CAST(low AS BIGINT) AS item_word,
  CAST(len(eq) AS BIGINT) AS n_aligned, CAST(list_sum(eq) AS BIGINT) AS n_equal,
  CAST(best AS DOUBLE) / width AS similarity
FROM h JOIN d USING (row) JOIN i USING (item) WHERE 5 * best >= 4 * width
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, string_split(text, chr(10)) AS a
  FROM documents WHERE length(text) > 0),
n AS (SELECT row, doc_id, list_transform(a, lambda x: hash(x)) AS h, list_transform(a,
    lambda x: len(regexp_extract_all(x, '[^ 	-
]+'))) AS c FROM d),
z AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768,
  1024, 1536, 2048]) AS size),
r AS (SELECT row, doc_id, i, size, h[i:i + size - 1] AS run, list_sum(c[i:i + size - 1]) AS words
  FROM n, z, unnest(range(1, greatest(len(h) - size + 1, 0) + 1)) u(i)),
f AS (SELECT size, run, min(struct_pack(d := doc_id, r := row, i := i)) AS first FROM r
  GROUP BY size, run HAVING count(*) > 1),
l AS (SELECT row, doc_id, i - 1 AS line,
    max(struct_pack(s := i - 1 + size, f := first.d)) AS best
  FROM r JOIN f USING (size, run) WHERE words >= 25 AND NOT (first.r = row AND first.i = i)
  GROUP BY ALL),
m AS (SELECT *, max(best.s) OVER (PARTITION BY row ORDER BY line
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM l),
k AS (SELECT *, sum(CASE WHEN reached IS NULL OR line >= reached THEN 1 ELSE 0 END)
    OVER (PARTITION BY row ORDER BY line) AS stretch FROM m)
SELECT any_value(doc_id) AS doc_id, CAST(min(line) AS BIGINT) AS first_line,
  CAST(max(best.s) - min(line) AS BIGINT) AS n_lines, CAST(min(best.f) AS BIGINT) AS first_doc_id
FROM k GROUP BY row, stretch
""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w
        WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a
), c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
), k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents JOIN c ON c.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
  LEFT JOIN k ON k.doc_id = documents.doc_id
""",
    "op11_resampling": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
f AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM d) GROUP BY ALL),
a AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM benchmark) GROUP BY word),
b AS (SELECT word, {CRC32} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM a)),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM a JOIN b USING (word) GROUP BY bucket),
g AS (SELECT i AS bucket, floor(1000 * ln(
    (coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
w AS (SELECT row, floor(sum(gain * n) / sum(n)) AS weight
  FROM f JOIN b USING (word) JOIN g USING (bucket) GROUP BY row),
o AS (SELECT row, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (row)),
p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM o),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    10 * count(*) OVER () // 100 AS most FROM p WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN rank <= most THEN rank END AS rank
FROM p LEFT JOIN r USING (row)
""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
    AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15)
      AS BIGINT) AS ticket
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size,
    CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)]
      AS DOUBLE) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS budget,
    sum(2.0 * source_size) OVER w - 2.0 * source_size AS held,
    sum(weight) OVER () - sum(weight) OVER w + weight AS free
  FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST
    ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT arg_min((budget - held) / free, most / weight) FILTER (WHERE most / weight > (budget - held) / free) AS level
  FROM o
), t AS (
  SELECT source, source_size, CAST(least(most, weight * level) AS DOUBLE) AS target FROM o, l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), g AS (
  SELECT u.source, ticket, target - whole * source_size AS rest, sum(size) AS words, count(*) AS n
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source GROUP BY ALL
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY ticket ROWS UNBOUNDED PRECEDING) AS upto FROM g
), k AS (
  SELECT source, ticket, CASE WHEN upto <= rest THEN n WHEN rest <= 0 OR upto - words > rest THEN 0
    ELSE least(n, floor(room / each) + CASE WHEN room - floor(room / each) * each
      > (floor(room / each) + 1) * each - room THEN 1 ELSE 0 END) END AS chosen
  FROM (SELECT *, rest - (upto - words) AS room, CAST(words AS DOUBLE) / n AS each FROM c)
), e AS (
  SELECT *, row_number() OVER (PARTITION BY source, ticket) AS place FROM d
)
SELECT doc_id, size, CAST(u.source_size AS BIGINT) AS source_size,
  round(target, 3) AS target,
  CAST((whole + CASE WHEN place <= chosen AND target > whole * u.source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM e JOIN u ON e.source IS NOT DISTINCT FROM u.source
  JOIN k ON e.source IS NOT DISTINCT FROM k.source AND e.ticket = k.ticket
""",
}
