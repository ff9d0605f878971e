"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers: component x is floor(1024 * x). For integer vectors
``2 q.v = |q|^2 + |v|^2 - d(q, v)^2``, and for every pivot p the triangle
inequality gives ``d(q, v) >= |d(q, p) - d(v, p)|``. A table of each vector's
distances to many pivots thus bounds every score from above. Candidates are
evaluated in the order of their bounds, in blocks, until the k-th best score
exceeds every bound that is left.

Queries are taken in blocks of a fixed size: a block is sent to all tasks, each
task searches its own candidates and returns k rows per query, and these few
rows are merged per query.

Defined results: vectors that are null or hold a null or non-finite component
take no part; neither do pairs of different lengths; rows repeating a query's
vec_id are no candidates for it; ties go to the smaller vec_id (repeated
candidate rows stay repeated); vec_id null takes no part; fewer than k candidates give all of them. Scores are
computed exactly at any magnitude; one beyond 64 bits is held at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, stage

SCALE = 1024
PIVOTS = 48
# Rows looked at when pivots are chosen; the choice only affects speed.
PIVOT_SAMPLE = 2000
QUERY_BLOCK = 2048
ROW_BLOCK = 8192
# Below this magnitude (and up to MOST_COLUMNS components) all sums of products are integers that
# float64 holds exactly; beyond it they are computed with Python's integers.
FAST = 1 << 19
MOST_COLUMNS = 1 << 12
LIMIT = (1 << 63) - 1


def _clean(vectors: DataFrame) -> DataFrame:
    plain = pick(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    bad = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return plain.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def _exact(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 52 else int(np.floor(x * SCALE))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows floor(1024 x) per length: float64 where exact, else Python integers."""
    ids = np.asarray(batch.column(0), dtype=np.int64)
    widths = np.asarray(pc.list_value_length(batch.column(1)))
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        flat = batch.column(1).take(pa.array(rows)).flatten()
        raw = np.asarray(flat, dtype=np.float64).reshape(len(rows), width)
        with np.errstate(over="ignore"):
            whole = np.floor(raw * SCALE)
        great = np.abs(whole).max(axis=1, initial=0) >= FAST
        if width > MOST_COLUMNS:
            great[:] = True
        if not great.all():
            yield ids[rows[~great]], whole[~great]
        if great.any():
            exact = [[_exact(x) for x in row] for row in raw[great]]
            yield ids[rows[great]], np.array(exact, dtype=object)


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per vector length, pivots far apart from each other.

    They are picked greedily from a bounded sample, the rows with the smallest
    hash of their id; any choice gives the same results.
    """
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE)
    rows = sample.collect()
    chosen: dict[int, np.ndarray] = {}
    for width in {len(r.embedding) for r in rows}:
        data = np.array([r.embedding for r in rows if len(r.embedding) == width])
        data = np.clip(np.floor(np.clip(data, -FAST, FAST) * SCALE), 1 - FAST, FAST - 1)
        picked, nearest = [0], np.full(len(data), np.inf)
        while len(picked) < min(count, len(data)):
            nearest = np.minimum(nearest, np.linalg.norm(data - data[picked[-1]], axis=1))
            far = int(np.argmax(nearest))
            if nearest[far] <= 0:
                break
            picked.append(far)
        chosen[width] = data[picked]
    return chosen


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: Euclidean distances, integers of modest size being exact in float64."""
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search_block(
    query_ids, queries, ids, vectors, pivots, k: int
) -> tuple[list[int], list[int], list[int]]:
    """Top ``k`` of one block of candidates for each query, by elimination."""
    out_q, out_v, out_s = [], [], []
    exact = queries.dtype == object or vectors.dtype == object
    if not exact:
        slack = 1e-6
        query_table, table = _distances(queries, pivots), _distances(vectors, pivots)
        query_norms, norms = (queries**2).sum(1), (vectors**2).sum(1)
    for i, query in enumerate(query_ids):
        others = np.flatnonzero(ids != query)
        if not len(others):
            continue
        if exact:
            own = [int(x) for x in queries[i]]
            scores = [sum(a * int(b) for a, b in zip(own, v, strict=True)) for v in vectors[others]]
            order = sorted(range(len(others)), key=lambda j: (-scores[j], ids[others[j]]))[:k]
            best_ids, best = ids[others[order]], [scores[j] for j in order]
        else:
            gap = np.zeros(len(others))
            for p in range(table.shape[1]):
                np.maximum(gap, np.abs(table[others, p] - query_table[i, p]), out=gap)
            gap = np.maximum(gap * (1 - slack) - slack, 0)
            bound = (query_norms[i] + norms[others] - gap * gap) / 2 + 0.5
            order = np.argsort(-bound, kind="stable")
            best, best_ids, step, done = np.zeros(0), np.zeros(0, dtype=np.int64), 4 * k, 0
            while done < len(order):
                if len(best) == k and bound[order[done]] < best[-1]:
                    break
                rows = others[order[done : done + step]]
                best = np.concatenate([best, vectors[rows] @ queries[i]])
                best_ids = np.concatenate([best_ids, ids[rows]])
                top = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[top], best_ids[top]
                done, step = done + step, step * 2
        out_q += [int(query)] * len(best)
        out_v += [int(x) for x in best_ids]
        out_s += [max(-LIMIT - 1, min(LIMIT, int(x))) for x in best]
    return out_q, out_v, out_s


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows of each query row.

    ``is_query`` is a condition on vec_id.
    """
    clean = _clean(vectors)
    spark = vectors.sparkSession
    pivots = choose_pivots(clean)
    # Query vectors are numbered within their parts, so that blocks have a fixed size.
    wanted = clean.where(is_query).withColumn("mark", F.monotonically_increasing_id())
    wanted = stage(
        wanted.withColumn("part", F.shiftright("mark", 33)).withColumn(
            "row", F.col("mark") - F.shiftleft(F.shiftright("mark", 33), 33)
        )
    )
    counts = sorted(tuple(r) for r in wanted.groupBy("part").count().collect())
    blocks: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for part, rows in counts:
        for start in range(0, rows, QUERY_BLOCK):
            size = min(QUERY_BLOCK, rows - start)
            if held + size > QUERY_BLOCK:
                blocks.append([])
                held = 0
            blocks[-1].append((part, start, start + size))
            held += size
    best = None
    for block in blocks:
        inside = F.lit(False)
        for part, start, stop in block:
            inside |= (F.col("part") == part) & (F.col("row") >= start) & (F.col("row") < stop)
        rows = wanted.where(inside).select("vec_id", "embedding").toArrow().combine_chunks()
        queries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in rows.to_batches():
            for ids, data in _by_width(batch):
                queries.setdefault(data.shape[1], []).append((ids, data))
        sent = spark.sparkContext.broadcast((queries, pivots))

        def search(batches, sent=sent):
            queries, pivots = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, ROW_BLOCK):
                    for ids, data in _by_width(batch.slice(start, ROW_BLOCK)):
                        width = data.shape[1]
                        near = pivots.get(width, np.zeros((1, width)))
                        for asked in queries.get(width, ()):
                            found = search_block(*asked, ids, data, near, k)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(x, pa.int64()) for x in found],
                                ["query_id", "vec_id", "score"],
                            )

        found = clean.mapInArrow(search, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = ranked if best is None else best.unionAll(ranked)
    return best.select("query_id", "rank", "vec_id", "score")
