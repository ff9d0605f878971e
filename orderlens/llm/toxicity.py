"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Texts fall apart into units: words without their punctuation, and runs of single
letters joined ("i d i o t"). The kernel of two units counts their common
subsequences of four symbols within a window of six, each gap weighed by DECAY;
the blank before and after a unit is a symbol, so beginnings and ends count, and
a letter put in between only costs a gap. Landmark units span the Nyström
feature space, in which a linear SVM is trained. As it is linear, the landmarks'
subsequences and the SVM's weights fold into one table of weights per
subsequence, and a unit is scored by looking its own subsequences up.

Labels belong to whole documents: training repeatedly picks the units of toxic
documents that score highest as positive and adds the highest units of clean
documents as negative examples. A document's score is a logistic function of its
best units' scores, fitted on documents that the SVM has not seen.

Defined results: null and empty texts have no units and get the (low) score of
that; repeated rows get equal scores; rows with a null doc_id are not held out;
labels that are null, or whose document is missing, teach nothing; without
labels of both kinds every score is the share of toxic labels (0 if none). An empty
table gives an empty result; other columns, whatever their names, are not looked at (or
kept, where rows are returned). A text is scored whole in one task, its units by blocks:
about 30 bytes of memory per character, so texts up to some 30 MB fit an executor of 3 GB.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import give_back, pick, row_slices

LENGTH, WINDOW, DECAY = 4, 6, 0.5
OFFSETS = list(combinations(range(1, WINDOW), LENGTH - 1))
# The bounded training sample: documents per label, and the longest document in it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 3000, 50_000
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS = 150, 100
# Clean units that every round learns from (as many of the commonest as of the others), and
# the most that are added for scoring high.
USUAL, HARD = 3000, 3000
ROUNDS = 5
C = 0.1
DELETED = 255
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2971215073, 4222234741, 1540483477], dtype=np.uint64)
SLICE = 500_000
# Units that are scored together.
UNITS = 20_000


def _symbols() -> np.ndarray:
    """Symbol per code point: 0 blank, 1-26 letters, 27-31 other letters, 255 dropped."""
    table = np.full(1 << 16, DELETED, dtype=np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isspace():
            table[code] = 0
        elif char.isalpha():
            low = ord(char.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low % 5
    table[-1] = DELETED
    return table


SYMBOLS = _symbols()


class Units:
    """All units of some texts as one array of symbols, blanks between them."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = SYMBOLS[np.minimum(codes, (1 << 16) - 1)]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        keep = symbols != DELETED
        symbols, owner = symbols[keep], owner[keep]
        blank = symbols == 0
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        symbols, owner = symbols[keep], owner[keep]
        if len(symbols) and symbols[0] == 0:
            symbols, owner = symbols[1:], owner[1:]
        if len(symbols) > 4:
            # A blank between two single letters of one text is dropped.
            at = np.flatnonzero(symbols == 0)
            before, after = np.diff(at, prepend=-1) == 2, np.diff(at, append=at[-1] + 99) == 2
            joins = before & after
            joins[:-1] &= owner[at[:-1] - 1] == owner[at[:-1] + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at[joins]] = False
            symbols, owner = symbols[keep], owner[keep]
        self.symbols = np.concatenate([[0], symbols]).astype(np.int32)
        self.blanks = np.flatnonzero(self.symbols == 0)
        self.sizes = np.diff(self.blanks) - 1
        self.owner = owner[self.blanks[:-1]] if len(owner) else np.zeros(0, dtype=np.int32)

    def __len__(self) -> int:
        return len(self.sizes)

    def names(self) -> list[bytes]:
        return self.symbols.astype(np.uint8).tobytes().split(b"\0")[1:-1] if len(self) else []

    def subsequences(self):
        """(place, code) arrays and weight, per choice of offsets that stays in the unit."""
        if not len(self):
            return
        room = np.repeat(self.blanks[1:], np.diff(self.blanks)) - np.arange(self.blanks[-1])
        padded = np.concatenate([self.symbols, np.zeros(WINDOW, dtype=np.int32)])
        n = len(room)
        first, second, third = padded[:n] << 15, padded << 10, padded << 5
        for a, b, c in OFFSETS:
            code = first | second[a : n + a] | third[b : n + b] | padded[c : n + c]
            yield room >= c, code, DECAY ** (c + 1 - LENGTH)

    def scores(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        """The score of every unit, by blocks of units, so that little is held at a time."""
        parts = [np.zeros(0)]
        for start in range(0, len(self), UNITS):
            block = self.block(start, min(start + UNITS, len(self)))
            total = np.zeros(block.blanks[-1], dtype=np.float32)
            for inside, code, weight in block.subsequences():
                total += weights[code] * (inside * np.float32(weight))
            parts.append(np.add.reduceat(total, block.blanks[:-1]) / norm(block.sizes) + intercept)
        return np.concatenate(parts)

    def block(self, start: int, stop: int) -> Units:
        units = Units.__new__(Units)
        low, high = self.blanks[start], self.blanks[stop]
        units.symbols, units.blanks = self.symbols[low : high + 1], self.blanks[start : stop + 1] - low
        units.sizes, units.owner = self.sizes[start:stop], self.owner[start:stop]
        return units


def norm(sizes: np.ndarray) -> np.ndarray:
    """Length normalisation: the root of the kernel of a unit of that size with itself, as if
    no subsequence occurred in it twice, and a constant that keeps short units small."""
    places = np.arange(1, 4096)
    table = np.zeros(4096)
    for _, _, c in OFFSETS:
        table[1:] += np.maximum(places + 2 - c, 0) * DECAY ** (2 * (c + 1 - LENGTH))
    return np.sqrt(table + 3.0)[np.minimum(sizes, 4095)]


def units_of(names: list[bytes]) -> Units:
    """Units from their names, each its own."""
    units = Units.__new__(Units)
    raw = np.frombuffer(b"\0" + b"\0".join(names) + b"\0", dtype=np.uint8).astype(np.int32)
    units.symbols, units.blanks = raw, np.flatnonzero(raw == 0)
    units.sizes = np.diff(units.blanks) - 1
    units.owner = np.arange(len(names), dtype=np.int32)
    return units


def kernel(names: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel of units and landmarks."""
    marks = units_of(landmarks)
    column = np.full(1 << (5 * LENGTH), -1, dtype=np.int32)
    parts = []
    for inside, code, weight in marks.subsequences():
        rows = np.repeat(np.arange(len(landmarks)), np.diff(marks.blanks))
        parts.append((code[inside], rows[inside], np.full(inside.sum(), weight)))
    codes, rows, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
    known = np.unique(codes)
    column[known] = np.arange(len(known))
    table = np.zeros((len(known), len(landmarks)), dtype=np.float32)
    np.add.at(table, (column[codes], rows), weights)
    table /= norm(marks.sizes)
    out = np.zeros((len(names), len(landmarks)), dtype=np.float32)
    for start in range(0, len(names), 500):
        units = units_of(names[start : start + 500])
        owner = np.repeat(np.arange(len(units)), np.diff(units.blanks))
        for inside, code, weight in units.subsequences():
            found = inside & (column[code] >= 0)
            np.add.at(out[start : start + 500], owner[found], weight * table[column[code[found]]])
        out[start : start + 500] /= norm(units.sizes)[:, None]
    return out


def fold(landmarks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    """The table of weights per subsequence that stands for all landmarks."""
    marks = units_of(landmarks)
    table = np.zeros(1 << (5 * LENGTH), dtype=np.float32)
    share = np.repeat(alpha / norm(marks.sizes), np.diff(marks.blanks))
    for inside, code, weight in marks.subsequences():
        np.add.at(table, code[inside], weight * share[inside])
    return table


def svm(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, c: float = 1.0):
    """Linear SVM with squared hinge loss, by Newton steps; returns weights and intercept."""
    data = np.hstack([features, np.ones((len(features), 1))]).astype(np.float64)
    w = np.zeros(data.shape[1])
    ridge = np.eye(data.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        active = labels * (data @ w) < 1
        x, s = data[active], c * weights[active]
        scaled = (x * s[:, None]).T
        fresh = np.linalg.solve(ridge + scaled @ x, scaled @ labels[active])
        if np.allclose(fresh, w, atol=1e-6):
            break
        w = fresh
    return w[:-1], float(w[-1])


def document_features(units: Units, scores: np.ndarray, count: int) -> np.ndarray:
    """Per text: its three best different unit scores, how many are positive, how many there are."""
    best = np.full((count, 3), -2.0)
    order = np.lexsort((-scores, units.owner))
    if len(order):
        # A repeated unit has the same score again.
        repeat = np.r_[False, np.diff(units.owner[order]) == 0] & np.r_[False, np.diff(scores[order]) == 0]
        order = order[~repeat]
    owner = units.owner[order]
    begins = np.searchsorted(owner, np.arange(count + 1))
    place = np.arange(len(order)) - begins[owner] if len(order) else np.zeros(0, dtype=int)
    for rank in range(3):
        rows = order[place == rank]
        best[units.owner[rows], rank] = np.clip(scores[rows], -2, 1)
    positive = np.bincount(owner[scores[order] > 0], minlength=count)[:count]
    number = np.diff(begins)
    return np.column_stack([best, np.log1p(positive), np.log1p(number) / 4])


def logistic(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    data = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(data.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        step = np.linalg.solve(
            (data * (p * (1 - p))[:, None]).T @ data + 0.05 * np.eye(len(w)),
            data.T @ (labels - p) - 0.05 * w,
        )
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def with_insertions(unit: bytes) -> list[bytes]:
    """The unit with a foreign letter put in at each inner place (units of five letters or more)."""
    if len(unit) < 5:
        return []
    return [unit[:i] + bytes([1 + (7 * i + unit[i]) % 26]) + unit[i:] for i in range(2, len(unit) - 1)]


def without_copies(bags: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """One bag of each group of near copies (half of eight min-hashes equal), so that what a
    copied document happens to say does not look typical of its label."""
    seen: dict[tuple, list[int]] = {}
    kept = []
    for bag, label in bags:
        if not bag:
            continue
        codes = np.fromiter((crc32(u) for u in bag), dtype=np.uint64, count=len(bag))
        prints = [(k, int(((codes * m) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate(FACTORS)]
        shared = Counter(other for p in prints for other in seen.get(p, ()))
        if shared and max(shared.values()) >= len(FACTORS) // 2:
            continue
        for p in prints:
            seen.setdefault(p, []).append(len(kept))
        kept.append((bag, label))
    return kept


def train(rows: list[tuple[str, int]]) -> dict:
    """Model from (text, toxic) rows, the same for the same rows in the same order."""
    labels = np.array([y for _, y in rows], dtype=int)
    if not len(rows) or labels.min() == labels.max():
        return {"constant": float(labels.mean()) if len(rows) else 0.0}
    learn = np.arange(len(rows)) % 10 < 7
    if len(set(labels[learn])) < 2 or len(set(labels[~learn])) < 2:
        learn = np.ones(len(rows), dtype=bool)
    # Units are shared between bags, and bags are tuples: the driver holds them all.
    pool: dict[bytes, bytes] = {}
    bags = []
    for (text, y), own in zip(rows, learn, strict=True):
        if own:
            bags.append((tuple({pool.setdefault(u, u) for u in Units([text]).names()}), y))
    bags = without_copies(bags)
    toxic, clean = [b for b, y in bags if y], [b for b, y in bags if not y]
    if not toxic or not clean:
        return {"constant": float(labels.mean())}
    in_toxic, in_clean = Counter(), Counter()
    for bag in toxic:
        in_toxic.update(bag)
    for bag in clean:
        in_clean.update(bag)
    # How surely a unit is commoner in toxic documents: a two-proportion z-score.
    surely = {}
    for u, n in in_toxic.items():
        both = (n + in_clean[u]) / (len(toxic) + len(clean))
        spread = np.sqrt(both * (1 - both) * (1 / len(toxic) + 1 / len(clean))) or 1.0
        surely[u] = (n / len(toxic) - in_clean[u] / len(clean)) / spread

    def telling(u: bytes, least: float = 4.0) -> bool:
        rare = in_clean[u] * len(toxic) * 4 < in_toxic[u] * len(clean)
        return rare and surely[u] > least

    everything = sorted(set(in_toxic) | set(in_clean))
    clean_units = sorted(in_clean, key=lambda u: (-in_clean[u], u))
    others = np.random.default_rng(7).permutation(np.arange(USUAL, max(USUAL, len(clean_units))))
    usual = clean_units[:USUAL] + [clean_units[i] for i in sorted(others[:USUAL])]
    rest = [row for row, own in zip(rows, learn, strict=True) if not own] or rows
    rest_labels = np.array([y for _, y in rest], float)
    # By hundreds of texts, so that only their symbols are held, not what they are made from.
    parts = [[text for text, _ in rest[i : i + 100]] for i in range(0, len(rest), 100)]
    rest_units = [(Units(texts), len(texts)) for texts in parts]
    least, best = np.inf, {}
    picks = Counter()
    for bag in toxic:
        picks.update([u for u in bag if telling(u)] or ([max(bag, key=lambda u: (surely[u], u))] if bag else []))
    hard: list[bytes] = []
    scored = units_of(everything)
    for _ in range(ROUNDS):
        positive = sorted(picks, key=lambda u: (-picks[u], u))
        plain = hard + [u for u in usual if u not in set(hard)]
        plain = [u for u in plain if u not in picks]
        marks = positive[:POSITIVE_LANDMARKS] + plain[:NEGATIVE_LANDMARKS]
        square = kernel(marks, marks).astype(np.float64)
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        useful = values > 1e-4 * values.max()
        root = vectors[:, useful] / np.sqrt(values[useful])
        altered = [v for u in positive[:POSITIVE_LANDMARKS] for v in with_insertions(u) if v not in in_clean]
        examples = positive + altered + plain
        y = np.r_[np.ones(len(positive) + len(altered)), -np.ones(len(plain))]
        weight = np.array(
            [min(picks[u], 20) for u in positive]
            + [1] * len(altered)
            + [min(in_clean[u], 20) for u in plain],
            float,
        )
        weight[y > 0] *= weight[y < 0].sum() / (2 * weight[y > 0].sum())
        w, intercept = svm(kernel(examples, marks) @ root, y, weight, C)
        table = fold(marks, root @ w)
        features = np.concatenate(
            [document_features(u, u.scores(table, intercept), n) for u, n in rest_units]
        )
        shape = logistic(features, rest_labels)
        odds = np.hstack([features, np.ones((len(rest), 1))]) @ shape
        loss = np.logaddexp(0, np.where(rest_labels > 0, -odds, odds)).mean()
        if loss < least:
            least, best = loss, {"table": table, "intercept": intercept, "shape": shape}
        value = dict(zip(everything, scored.scores(table, intercept), strict=True))
        picks = Counter()
        for bag in toxic:
            picks.update(u for u in bag if telling(u) or (value[u] > 0 and telling(u, 1.5)))
        if not picks:
            picks = Counter(positive)
        fresh = {u for u in clean_units if value[u] > -0.5 and u not in picks} | set(hard)
        hard = sorted(fresh - set(picks), key=lambda u: (-value[u] * np.log1p(in_clean[u]), u))[:HARD]
    return best


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    units = Units(texts)
    features = document_features(units, units.scores(model["table"], model["intercept"]), len(texts))
    linear = np.hstack([features, np.ones((len(texts), 1))]) @ model["shape"]
    return 1 / (1 + np.exp(-np.clip(linear, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample: per label the rows with the smallest hash of their id."""
    known = (
        pick(labels, "doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))
        .where("toxic = least")
    )
    texts = pick(documents, "doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # A few more ids than wanted, for those without a text.
    chosen = [
        known.where(F.col("toxic") == value).orderBy(*order).limit(2 * limit)
        for value, limit in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    ids = chosen[0].unionAll(chosen[1]).select("doc_id", "toxic")
    joined = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    rows = []
    for value, limit in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        best = joined.where(F.col("toxic") == value).orderBy(*order, "text").limit(limit)
        rows += [(r.doc_id, r.text, int(r.toxic)) for r in best.collect()]
    rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[1]))
    return [(text, toxic) for _, text, toxic in rows]


def score(documents: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = model or train(training_rows(documents, labels))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in row_slices(batch, 1, SLICE):
                texts = [x or "" for x in piece.column(1).to_pylist()]
                values = pa.array(score_texts(texts, sent.value), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), values], ["doc_id", "score"]
                )

    scored = pick(documents, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    model = train(training_rows(documents, labels))
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names, schema = documents.columns, documents.schema
    place = names.index("text")

    def run(batches):
        for batch in batches:
            for piece in row_slices(batch, place, SLICE):
                texts = [x or "" for x in piece.column(place).to_pylist()]
                keep = score_texts(texts, sent.value) < 0.5
                yield piece.filter(pa.array(keep))
        give_back()

    plain = documents.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*[f.name for f in schema.fields])
