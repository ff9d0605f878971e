"""Grouped prefix join: documents whose sets of five-word shingles are similar.

Shingles are ordered, shared ones last, and two sets with a Jaccard index of 0.8
or more must share one of the first ``n - ceil(0.8 n) + 1``. So:

1. Equal sets are one node from the start (copies need no comparison).
2. Shingles that occur in several documents are counted exactly; the most shared
   ones (a table of fixed size) go to the end of the order. Any order gives right
   results; this one leaves hardly anything to compare.
3. Nodes with the same prefix and the same size are one group. Groups meet by
   prefix shingle. Where few groups share one, pairs of groups are counted: a pair
   is dropped if sizes rule a link out or it shares fewer prefix shingles than a
   link needs. Where many share one, they are candidates without being paired, but
   only groups whose sizes and places of the shingle allow it to be the first common
   one, so that passages in otherwise different texts do not make one large family.
4. Candidates form families. Groups are expanded to their nodes, families are cut
   into blocks and blocks are compared as matrices of whole sets. For classes and
   numbers of links every node of a block pair gives one row, with the sum of its
   links there and the root of its tree; ``links`` and ``pairs`` list every link. The
   comparisons within a family grow with the square of its size, as its copies may
   drift apart.
5. Links become components.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a
text with one to four words has one shingle, its whole sequence; null and empty
texts have none and are linked with nothing (their component is their own id);
repeated rows are copies; a null doc_id never names a component. An empty table
gives an empty result; other columns, whatever their names, are not looked at (or
kept, where rows are returned). A text's set is made in one task (about 50 bytes per
byte of text, beyond the usual slice for a text longer than one).

Shingles are 64-bit hashes. Equal sets are recognised by 64 bits of the whole set, and
overlaps are counted on 40 bits of each hash: of two sets with n shingles each, one
unequal pair in 2^40 / n^2 or so counts as shared, which matters only for pairs within
one shingle of the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import (
    WordHasher,
    _mix,
    give_back,
    pick,
    row_slices,
    shingles,
    stage,
    word_hasher,
)
from orderlens.llm.components import roots
from orderlens.operators.skew import attach

WIDTH = 5
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
# Shared shingles that go to the end of the order: at most this many.
SHARED = 1 << 21
FILTER_BITS = 25
# A shingle in more groups than this makes them candidates unpaired; blocks of families have so
# many nodes.
FAMILY = 16
BLOCK = 512
# Classes of size between a set and one a quarter larger.
CLASSES = 4
# Bytes of packed sets in a block, so that long sets make smaller blocks.
BLOCK_BYTES = 4_000_000
# Tables of at most so many rows of two or three numbers are broadcast.
BROADCAST_ROWS = 500_000
SLICE = 500_000


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def linked(overlap, n, m):
    return 100 * overlap >= 80 * (n + m - overlap)


def document_sets(words: np.ndarray, bounds: np.ndarray):
    """The sorted distinct shingle hashes of every text."""
    every = shingles(words, WIDTH)
    for i in range(len(bounds) - 1):
        start, stop = bounds[i], bounds[i + 1]
        if stop - start >= WIDTH:
            yield np.unique(every[start : stop - WIDTH + 1])
        elif stop > start:
            with np.errstate(over="ignore"):
                total = np.uint64(stop - start)
                for word in words[start:stop]:
                    total = total * np.uint64(0x9E3779B97F4A7C15) + word
            yield _mix(np.array([total], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def node_of(values: np.ndarray) -> int:
    """64 bits of the set, the same for equal sets only (but for hash collisions)."""
    if not len(values):
        return 0
    with np.errstate(over="ignore"):
        mixed = _mix(values + np.uint64(0x632BE59BD9B4E019))
        total = mixed.sum(dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        total ^= np.bitwise_xor.reduce(_mix(mixed ^ np.uint64(len(values))))
        return int(_mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _each_set(batch: pa.RecordBatch, column: int, hasher: WordHasher):
    for piece in row_slices(batch, column, SLICE):
        words, bounds = hasher(piece.column(column))
        yield piece, list(document_sets(words, bounds))
    give_back()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])]
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def nodes(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, print (hash of the text), n, node."""

    def run(batches):
        hasher = word_hasher(SEPARATORS)
        for batch in batches:
            for piece, sets in _each_set(batch, 2, hasher):
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns[:2],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "print", "n", "node"],
                )

    source = pick(documents, "doc_id", "text").select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("print"), "text"
    )
    return source.mapInArrow(run, "doc_id long, print long, n long, node long")


def _ordered(values: np.ndarray, late) -> np.ndarray:
    """The shingles in the common order: by hash, shared ones last."""
    if late is None:
        return values
    last = late(values)
    return np.concatenate([values[~last], values[last]])


def group_of(prefix: np.ndarray, n: int) -> int:
    """64 bits of prefix and size."""
    return node_of(np.concatenate([prefix, np.array([n], dtype=np.uint64)]))


def _prefixes(documents: DataFrame, shared=None) -> DataFrame:
    """node, group, n, tokens: the prefix of every set, once per task."""

    def run(batches):
        hasher = word_hasher(SEPARATORS)
        seen: set[int] = set()
        late = shared.value if shared is not None else None
        for batch in batches:
            for _, sets in _each_set(batch, 0, hasher):
                ids, groups, sizes, parts = [], [], [], []
                for values in sets:
                    node = node_of(values)
                    if not len(values) or node in seen:
                        continue
                    seen.add(node)
                    n = len(values)
                    ids.append(node)
                    sizes.append(n)
                    parts.append(_ordered(values, late)[: prefix_length(n)])
                    groups.append(group_of(parts[-1], n))
                columns = [pa.array(c, pa.int64()) for c in (ids, groups, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _lists(parts)], ["node", "group", "n", "tokens"]
                )

    schema = "node long, group long, n long, tokens array<long>"
    return pick(documents, "text").mapInArrow(run, schema)


def slots_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots of a packed bit table (lowest bit first) are set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


class Among:
    """Membership in a sorted array of hashes, with a packed bit table in front."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        table[slots_of(self.values)] = True
        self.bits = np.packbits(table, bitorder="little")

    def __call__(self, values: np.ndarray) -> np.ndarray:
        found = marked(self.bits, slots_of(values))
        maybe = np.flatnonzero(found)
        if len(self.values) and len(maybe):
            at = np.searchsorted(self.values, values[maybe])
            at[at == len(self.values)] = 0
            found[maybe] = self.values[at] == values[maybe]
        else:
            found[:] = False
        return found


def _shared_tokens(documents: DataFrame) -> np.ndarray:
    """The most shared prefix shingles: the lowest count from 2 up that fits the table."""
    counts = stage(
        _prefixes(documents)
        .select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .count()
        .where("count > 1")
    )
    held, least = 0, None
    for number, tokens in sorted(counts.groupBy("count").agg(F.count("token")).collect())[::-1]:
        if held + tokens > SHARED:
            break
        held, least = held + tokens, number
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    found = counts.where(F.col("count") >= least).select("token").toArrow().column(0)
    return np.asarray(found.combine_chunks(), dtype=np.int64).view(np.uint64)


def pack(values: np.ndarray) -> bytes:
    """40 bits of each hash, in ascending order."""
    return (values >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return raw.view(np.uint64).ravel()


def _sets(documents: DataFrame, families: DataFrame, shared) -> DataFrame:
    """family, node, content (packed set) of the nodes of all groups in ``families``."""
    spark = documents.sparkSession

    # A filter of fixed size, 64 slots a row: it only spares rows; the join decides.
    slot = F.shiftrightunsigned("group", 64 - FILTER_BITS)
    one = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    rows = families.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("bigint").alias("at"))
    words = np.zeros((1 << FILTER_BITS) // 64, dtype="<i8")
    found = rows.agg(F.bit_or(one).alias("bits")).toArrow()
    words[np.asarray(found.column("at"))] = np.asarray(found.column("bits"))
    sent = spark.sparkContext.broadcast(words.view(np.uint8))

    def run(batches):
        hasher = word_hasher(SEPARATORS)
        late = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _each_set(batch, 0, hasher):
                rows = []
                for values in sets:
                    if not len(values) or (node := node_of(values)) in seen:
                        continue
                    seen.add(node)
                    n = len(values)
                    group = group_of(_ordered(values, late)[: prefix_length(n)], n)
                    place = (group & (1 << 64) - 1) >> (64 - FILTER_BITS)
                    if sent.value[place >> 3] >> (place & 7) & 1:
                        rows.append((group, node, pack(values)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["group", "node", "content"],
                    )

    sets = pick(documents, "text").mapInArrow(run, "group long, node long, content binary")
    few = families.count() <= BROADCAST_ROWS
    sets = sets.join(F.broadcast(families) if few else families, "group")
    return stage(sets.select("family", "node", "content").dropDuplicates(["node"]))


def _good(contents: list[np.ndarray], sides: np.ndarray) -> np.ndarray:
    """Which sets are linked across a block pair (``sides`` -1 and 1) or within a block (all 0).

    Overlaps come from products of 0/1 matrices over the shingles that occur twice.
    """
    m = len(contents)
    owner = np.repeat(np.arange(m), [len(c) for c in contents])
    values, inverse, counts = np.unique(
        np.concatenate(contents), return_inverse=True, return_counts=True
    )
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    rows, columns = owner[keep], column[inverse[keep]]
    overlap = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, int(shared.sum()), 4096):
        low, high = np.searchsorted(columns, (start, start + 4096))
        part = np.zeros((m, 4096), dtype=np.float32)
        part[rows[low:high], columns[low:high] - start] = 1
        overlap += part @ part.T
    sizes = np.array([len(c) for c in contents])
    good = linked(overlap.astype(np.int64), sizes[:, None], sizes[None, :])
    np.fill_diagonal(good, False)
    if sides.any():
        good &= sides[:, None] != sides[None, :]
    return good


def _trees(good: np.ndarray) -> np.ndarray:
    """For every place the least one it is connected with."""
    parent = list(range(len(good)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(good)), strict=True):
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(len(good))], dtype=np.int64)


def _family_links(sets: DataFrame, every: bool = False) -> DataFrame:
    """a, b, links: what is linked within families, block pair by block pair.

    With ``every`` one row per linked pair, else one per node that has links in the
    block pair: ``b`` is the root of its tree there, and ``links`` the sum of the
    copies of the sets it is linked with. A pair meets in one block pair only.
    """
    members = sets.groupBy("family").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.length("content")).alias("bytes")
    ).where("members > 1")
    members = members.withColumn("rows", F.col("members"))
    sized = attach(sets, members, ["family"], "rows").where("members IS NOT NULL")
    most = F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES)
    # A set longer than a block stands alone; more blocks than sets are of no use.
    blocks = F.least(F.ceil(most), F.col("members")).cast("bigint")
    # Each block meets each other block once: key (smaller, larger).
    placed = (
        sized.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "family",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "node",
            F.signum(F.col("block") - F.col("other")).cast("int").alias("side"),
            "content",
            "copies",
        )
    )

    def compare(batch: pa.Table) -> pa.Table:
        contents = [unpack(c.as_py()) for c in batch.column("content")]
        number = lambda name: np.asarray(batch.column(name).combine_chunks())
        node, copies = number("node"), number("copies").astype(np.int64)
        good = _good(contents, number("side"))
        if every:
            i, j = np.nonzero(np.triu(good))
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            links_ = np.ones(len(i), dtype=np.int64)
        else:
            i = np.flatnonzero(good.any(axis=1))
            a, b = node[i], node[_trees(good)[i]]
            links_ = np.array([copies[row].sum() for row in good[i]], dtype=np.int64)
        if len(contents) > BLOCK // 2:
            give_back()
        return pa.table({"a": pa.array(a), "b": pa.array(b), "links": pa.array(links_)})

    return placed.groupBy("family", "low", "high").applyInArrow(compare, "a long, b long, links long")


def _least_shared(n: str, m: str) -> F.Column:
    """How many prefix shingles sets of these sizes share at least if they are linked.

    A link needs ceil(4 (n + m) / 9) common shingles, so at most n minus that many
    of a set's are missing in the other; of the two prefixes, the one that ends
    first in the order has its other shingles in the other prefix as well.
    """
    overlap = F.floor((4 * (F.col(n) + F.col(m)) + 8) / 9)
    longest = F.greatest(F.floor((4 * F.col(n) + 4) / 5), F.floor((4 * F.col(m) + 4) / 5))
    return overlap + 1 - longest


def _may_begin(n: str, m: str, place: str) -> F.Column:
    """Can a link between sets of these sizes have its first common shingle at this place of the first?

    All shingles before it are missing in the other set, and of n shingles a link leaves
    at most n - 4 (n + m) / 9 missing.
    """
    return 9 * F.col(place) <= 5 * F.col(n) - 4 * F.col(m)


def _stars(large: DataFrame) -> DataFrame:
    """a, b: groups connected where their sets may have a widely shared shingle as first common one.

    Groups that share a shingle meet by classes of size, the smaller set's class and how far
    the larger one's is above it. A group takes part in a meeting only if its place of the
    shingle allows a link with some size of the other class.
    """
    start = lambda number: F.floor(F.pow(F.lit(1.25), number / CLASSES))
    kind = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25)) * CLASSES)
    # Sizes of a link differ by a quarter at most; one class more for rounding.
    apart = F.explode(F.sequence(F.lit(0), F.lit(CLASSES + 1)))
    rows = large.select("token", "group", "n", "place", kind.alias("kind"), apart.alias("apart"))
    smaller = rows.withColumn("m", F.greatest("n", start(F.col("kind") + F.col("apart"))))
    least = F.greatest(F.ceil(4 * F.col("n") / 5), start(F.col("kind") - F.col("apart")))
    larger = rows.withColumn("m", least).withColumn("kind", F.col("kind") - F.col("apart"))
    names = [F.xxhash64("token", "kind", "apart").alias("meeting"), "group"]
    met = _may_begin("n", "m", "place")
    members = smaller.where(met).select(*names, F.lit(False).alias("larger")).unionAll(
        larger.where(met).select(*names, F.lit(True).alias("larger"))
    )
    heads = (
        members.groupBy("meeting")
        .agg(
            F.min("group").alias("head"), F.max("group").alias("last"), F.count(F.lit(1)).alias("rows"),
            (F.bool_or("larger") & F.bool_or(~F.col("larger"))).alias("both"),
        )
        .where("both AND head <> last")
        .select("meeting", "head", "rows")
    )
    starred = attach(members, heads, ["meeting"], "rows").where("head <> group")
    return starred.select(F.col("head").alias("a"), F.col("group").alias("b"))


def _candidates(met: DataFrame) -> DataFrame:
    """a, b: groups to be compared, not all pairs of them, but all connected.

    Two linked sets have a first common shingle, which is in both prefixes: one that many
    groups share (then ``_stars`` connects them), or one of few groups, which are paired.
    """
    large = met.where(F.col("size") > FAMILY)
    several = met.where("low <> high").select(F.col("group").alias("a"), F.col("group").alias("b"))
    small = met.where(F.col("size").between(2, FAMILY)).select("token", "group", "n", "place")
    wide = large.groupBy("group").agg(F.count(F.lit(1)).alias("wide"))
    x, y = small.alias("x"), small.alias("y")
    shared = (
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where("x.group < y.group AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n")
        .groupBy(
            F.col("x.group").alias("a"), F.col("y.group").alias("b"),
            F.col("x.n").alias("n"), F.col("y.n").alias("m"),
        )
        .agg(
            F.count(F.lit(1)).alias("shared"),
            F.min("x.place").alias("place"), F.min("y.place").alias("other"),
        )
        .where(_may_begin("n", "m", "place") & _may_begin("m", "n", "other"))
    )
    # Widely shared shingles are not paired, so what two groups have of them is bounded.
    wide_of = lambda name: wide.toDF(name, f"{name}_wide")
    most = F.least(*[F.coalesce(f"{name}_wide", F.lit(0)) for name in "ab"])
    paired = (
        shared.join(wide_of("a"), "a", "left")
        .join(wide_of("b"), "b", "left")
        .where(F.col("shared") + most >= _least_shared("n", "m"))
        .select("a", "b")
    )
    return stage(_stars(large).unionAll(several).distinct().unionAll(paired))


def _families(documents: DataFrame) -> DataFrame:
    """family, node, content: every linked pair of nodes is within one family."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Among(_shared_tokens(documents)))
    spread = _prefixes(documents, shared).select(
        F.posexplode("tokens").alias("place", "token"), "group", "n", "node"
    )
    # One shuffle serves the grouping and the window.
    met = spread.repartition("token").groupBy("token", "group").agg(
        F.max("n").alias("n"), F.min("place").alias("place"),
        F.min("node").alias("low"), F.max("node").alias("high"),
    )
    bucket = Window.partitionBy("token")
    met = met.withColumn("size", F.count(F.lit(1)).over(bucket)).where("size > 1 OR low <> high")
    edges = _candidates(stage(met))
    family = roots(edges)
    groups = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    families = groups.join(family, "node", "left").select(
        F.col("node").alias("group"), F.coalesce("root", "node").alias("family")
    )
    return _sets(documents, stage(families), shared)


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")
    )


def links(documents: DataFrame) -> DataFrame:
    """a, b: every pair of different sets that are linked, once (a < b, as nodes)."""
    sets = _families(documents).withColumn("copies", F.lit(1).cast("bigint"))
    return _family_links(sets, every=True).select("a", "b")


def pairs(documents: DataFrame) -> DataFrame:
    """doc_a, doc_b: every linked pair of different sets, by the smallest id that has each.

    Copies of a document are linked as it is; their rows are not listed.
    """
    named = stage(_named(stage(nodes(documents)))).select("node", "least")
    a = named.select(F.col("node").alias("a"), F.col("least").alias("x"))
    b = named.select(F.col("node").alias("b"), F.col("least").alias("y"))
    joined = links(documents).join(a, "a").join(b, "b")
    return joined.select(
        F.when(F.col("y") < F.col("x"), F.col("y")).otherwise(F.col("x")).alias("doc_a"),
        F.when(F.col("y") < F.col("x"), F.col("x")).otherwise(F.col("y")).alias("doc_b"),
    )


def _with_root(rows: DataFrame, found: DataFrame) -> DataFrame:
    few = found.count() <= BROADCAST_ROWS
    table = F.broadcast(found) if few else found
    return rows.join(table, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _classified(documents: DataFrame) -> DataFrame:
    """doc_id, print, n, root (of the component of nodes), component_id, n_links per row."""
    rows = stage(nodes(documents))
    named = _named(rows)
    copies = named.select("node", F.col("rows").alias("copies"))
    linked_ = stage(_family_links(_families(documents).join(copies, "node")))
    found = stage(roots(linked_.select("a", "b")))
    others = linked_.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rooted = stage(_with_root(named, found).join(others, "node", "left"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("nodes"))
    summary = rooted.join(least.where("nodes > 1").drop("nodes"), "root", "left").select(
        "node",
        "rows",
        "root",
        F.coalesce("component", "least").alias("component"),
        (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("others"),
    )
    joined = attach(rows, summary, ["node"], "rows")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id", "print", "n", "root", own.alias("component_id"),
        F.coalesce("others", F.lit(0)).cast("bigint").alias("n_links"),
    )


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links per row of ``documents``.

    ``n_links`` is the number of other rows that the row is linked with, copies included.
    """
    return _classified(documents).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links"
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows with one document of each component kept (the smallest id), all columns kept.

    Texts without words are all kept; of repeated rows one is kept.
    """
    names = documents.columns
    classes = stage(_classified(documents).where("n > 0"))
    keepers = classes.groupBy("root").agg(
        F.min(F.struct("doc_id", "print")).alias("k"), F.count(F.lit(1)).alias("rows")
    )
    each = classes.groupBy("root", "doc_id", "print").agg(F.count(F.lit(1)).alias("copies"))
    keep = stage(
        attach(each, keepers, ["root"], "rows").select(
            F.col("doc_id").alias("_id"),
            F.col("print").alias("_print"),
            "copies",
            (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("print") == F.col("k.print"))).alias("kept"),
        )
    )
    plain = documents.toDF(*[f"_{i}" for i in range(len(names))]).withColumns(
        {"_id_": F.col(f"_{names.index('doc_id')}"), "_print_": F.xxhash64(f"_{names.index('text')}")}
    )
    same = F.col("_id_").eqNullSafe(F.col("_id")) & (F.col("_print_") == F.col("_print"))
    drop = keep.where("not kept").select("_id", "_print")
    rest = plain.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, same, "left_anti")
    repeated = keep.where("kept and copies > 1").select("_id", "_print")
    if not repeated.isEmpty():
        table = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
        single = rest.join(table, same, "left_semi").dropDuplicates(["_id_", "_print_"])
        rest = rest.join(table, same, "left_anti").unionAll(single)
    return rest.drop("_id_", "_print_").toDF(*names)
