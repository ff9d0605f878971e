"""Quality rules from how well public vocabularies fit a text.

Per text, over its words, each encoded by itself:

* ``chars_per_token``: characters per token of a vocabulary with byte fallback;
* ``chars_per_byte_token``: the same with a byte-level vocabulary, whose merges are applied
  to the word behind a blank;
* ``byte_share``: share of the first one's tokens that stand for a single byte;
* ``token_entropy``: entropy of the text's tokens, as a share of what as many tokens
  (256 at most) could have.

What is usual differs between languages and scripts, so the bands are theirs: the
quartiles of every measure over all texts of a language, or of a script where the
language is missing or rare, found exactly from counts per narrow bin. A text is
rejected where a measure lies further out than ``REACH`` times the distance of the
quartiles (``LEAST_REACH`` at least, so that a uniform collection rejects no ordinary
text). Texts that fail the plain rules (too few words, too many in repeated windows)
take no part in the quartiles and are never kept.

One pass measures (a task remembers the tokens of recent words), one groups narrow
columns; texts are not shuffled. Bands are one row per language and script; few are
broadcast, many are joined with hot ones apart.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none, measures
null, and fail; a language or script with fewer than ``FEWEST`` texts has no band and
rejects nothing; repeated ids and texts are rows like others; an empty table gives an
empty result; other columns, whatever their names, are not looked at. A very long text
is measured whole, in one task: some 200 bytes of memory per word.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, row_slices, stage
from orderlens.llm.periodic import Windows, _repeated, spread
from orderlens.llm.tokenids import BYTE_CHARACTERS
from orderlens.operators.skew import attach

SLICE = 500_000
CACHE = 300_000
# Longer words are encoded, but not remembered.
CACHED_BYTES = 64
LEAST_WORDS = 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"
FEWEST = 100
REACH = 5.0
# Width of a bin, and how far from a quartile a measure may always be.
MEASURES = {
    "chars_per_token": (0.005, 0.2),
    "chars_per_byte_token": (0.005, 0.2),
    "byte_share": (0.001, 0.1),
    "token_entropy": (0.001, 0.05),
}
ENTROPY_TOKENS = 256

# Where blocks of scripts begin (first code point, script).
SCRIPTS = (
    (0x0000, "none"), (0x0041, "Latin"), (0x005B, "none"), (0x0061, "Latin"), (0x007B, "none"),
    (0x00C0, "Latin"), (0x0250, "none"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "none"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "none"), (0x0E00, "Thai"), (0x0E80, "none"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "none"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "none"), (0x3040, "Kana"),
    (0x3100, "none"), (0x3400, "Han"), (0x4DC0, "none"), (0x4E00, "Han"), (0xA000, "none"),
    (0xAC00, "Hangul"), (0xD7B0, "none"), (0xF900, "Han"), (0xFB00, "none"), (0x20000, "Han"),
    (0x32000, "none"),
)
_STARTS = [start for start, _ in SCRIPTS]
NAMES = sorted({name for _, name in SCRIPTS} - {"none"})
_NUMBERS = [NAMES.index(name) if name != "none" else -1 for _, name in SCRIPTS]


def script_of(word: str) -> int:
    """The number of the script of a word's first letter, -1 without one."""
    for character in word:
        if (number := _NUMBERS[bisect_right(_STARTS, ord(character)) - 1]) >= 0:
            return number
    return -1


def byte_characters(words: list[bytes]) -> list[str]:
    """Words behind a blank, as byte-level vocabularies write them."""
    data = b"".join(b" " + w for w in words)
    text = BYTE_CHARACTERS[np.frombuffer(data, dtype=np.uint8)].tobytes().decode("utf-16-le")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Vocabularies:
    """What words cost in tokens, remembered in two generations."""

    def __init__(self, pieces: str, byte_level: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size = self.pieces.get_piece_size()
        self.bytes = np.array([self.pieces.is_byte(i) for i in range(self.size)], dtype=bool)
        self.byte_level = Tokenizer.from_file(byte_level).model
        self.young: dict[bytes, tuple[bytes, int, int]] = {}
        self.old: dict[bytes, tuple[bytes, int, int]] = {}

    def _encode(self, words: list[bytes]) -> list[tuple[bytes, int, int]]:
        texts = [w.decode() for w in words]
        merged = map(self.byte_level.tokenize, byte_characters(words))
        ids = self.pieces.encode(texts, num_threads=1)
        return [
            (array("I", own).tobytes(), len(other), script_of(text))
            for own, other, text in zip(ids, merged, texts, strict=True)
        ]

    def __call__(self, words: list[bytes]) -> list[tuple[bytes, int, int]]:
        """Per (different) word: its ids, packed, its number of byte-level tokens, its script."""
        found = {w: x for w in words if (x := self.young.get(w) or self.old.get(w)) is not None}
        fresh = [w for w in words if w not in found]
        for start in range(0, len(fresh), 4096):
            part = fresh[start : start + 4096]
            found.update(zip(part, self._encode(part), strict=True))
        if len(self.young) + len(found) > CACHE:
            self.old, self.young = self.young, {}
        self.young.update((w, x) for w, x in found.items() if len(w) <= CACHED_BYTES)
        return [found[w] for w in words]


def repeated_words(ids: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text: its words within windows of ``WINDOW`` words that it holds twice or more."""
    last = np.searchsorted(text, text, side="right")
    at = np.flatnonzero(np.arange(len(ids)) + WINDOW <= last)
    if not len(at):
        return np.zeros(texts, dtype=np.int64)
    keys = Windows(ids)(at, WINDOW) ^ (text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = at[_repeated(keys)]
    # Hashes only choose; equal windows of words of one text decide.
    rows = np.column_stack([text[at], ids[at[:, None] + np.arange(WINDOW)]])
    _, which, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[which.ravel()] > 1]
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    inside = np.cumsum(edges[:-1]) > 0
    return np.bincount(text[inside], minlength=texts)


def entropies(tokens: np.ndarray, text: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Per text the entropy of its tokens as a share of the most that as many could have."""
    codes, counts = np.unique(text * size + tokens, return_counts=True)
    owner = codes // size
    total = np.bincount(text, minlength=texts)
    share = counts / total[owner]
    entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=texts)
    most = np.log2(np.clip(total, 2, ENTROPY_TOKENS))
    return entropy / most


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "chars_per_token double, chars_per_byte_token double, byte_share double, token_entropy double"
)
_NAMES = [part.split()[0] for part in COLUMNS.split(", ")]


def _measure(texts: list[bytes], vocabularies: Vocabularies) -> list[pa.Array]:
    words = [x.split() for x in texts]
    flat = list(chain.from_iterable(words))
    counts = np.array([len(w) for w in words], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(index.__getitem__, flat), dtype=np.int64, count=len(flat))
    chars, symbols, lines = [], [], []
    for x in texts:
        plain = x.decode()
        chars.append(len(plain) - sum(map(plain.count, " \t\n\v\f\r")))
        symbols.append(sum(map(plain.count, SYMBOLS)))
        worded = [line for line in x.split(b"\n") if line.strip()]
        lines.append(len(worded) - len(set(worded)))
    known = vocabularies(list(index))
    packed = np.frombuffer(b"".join(k[0] for k in known), dtype="<u4")
    sizes = np.array([len(k[0]) // 4 for k in known], dtype=np.int64)
    level = np.array([k[1] for k in known], dtype=np.int64)
    scripts = np.array([k[2] for k in known], dtype=np.int64)
    n = len(texts)
    tokens = packed[spread((np.cumsum(sizes) - sizes)[ids], sizes[ids])].astype(np.int64)
    owner = np.repeat(text, sizes[ids])
    total = np.bincount(owner, minlength=n)
    level = np.bincount(text, weights=level[ids], minlength=n)
    single = np.bincount(owner, weights=vocabularies.bytes[tokens], minlength=n)
    lettered = scripts[ids] >= 0
    by_script = np.bincount(
        text[lettered] * len(NAMES) + scripts[ids][lettered], minlength=n * len(NAMES)
    ).reshape(n, len(NAMES))
    script = [NAMES[i] if most else None for i, most in zip(by_script.argmax(1), by_script.max(1), strict=True)]
    missing = total == 0
    many = np.maximum(total, 1)
    chars = np.array(chars, dtype=np.int64)

    def measure(values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.float64(), mask=missing)

    return [
        pa.array(counts), pa.array(chars), pa.array(symbols, pa.int64()), pa.array(lines, pa.int64()),
        pa.array(repeated_words(ids, text, n)), pa.array(script, pa.string()),
        measure(chars / many), measure(chars / np.maximum(level, 1)), measure(single / many),
        measure(entropies(tokens, owner, n, vocabularies.size)),
    ]


def measured(documents: DataFrame, pieces: str, byte_level: str) -> DataFrame:
    """doc_id, lang, the plain counts and the measures per row of ``documents``.

    ``pieces`` and ``byte_level`` are the files of the two vocabularies.
    """

    def run(batches):
        vocabularies = Vocabularies(pieces, byte_level)
        for batch in batches:
            for piece in row_slices(batch, 2, SLICE):
                texts = [x or b"" for x in piece.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:2], *_measure(texts, vocabularies)], ["doc_id", "lang", *_NAMES]
                )

    source = pick(documents, "doc_id", "lang", "text").select(
        F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), "text"
    )
    return source.mapInArrow(run, f"doc_id long, lang string, {COLUMNS}")


def plain_failure() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """kind ('lang' or 'script'), name, texts, and per measure the least and greatest value allowed.

    Quartiles are the middles of the bins that hold the ranks; bins are counted, so no
    task sees more rows of a language than there are bins.
    """
    sound = rows.where(~plain_failure())
    cells = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.lit(name).alias("measure"),
                F.floor(F.col(name) / width).alias("bin"),
            )
            for kind in ("lang", "script")
            for name, (width, _) in MEASURES.items()
        ]
    )
    counts = (
        sound.select(F.inline(cells))
        .where("name IS NOT NULL AND bin IS NOT NULL")
        .groupBy("kind", "name", "measure", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy("kind", "name", "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("texts", F.sum("n").over(group))

    def quartile(quarters: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= quarters * F.col("texts"), F.col("bin")))

    found = placed.where(F.col("texts") >= FEWEST).groupBy("kind", "name", "measure").agg(
        F.max("texts").alias("texts"), quartile(1).alias("q1"), quartile(3).alias("q3")
    )
    chosen = []
    for name, (width, least) in MEASURES.items():
        own = F.col("measure") == name
        reach = F.greatest(REACH * (F.col("q3") - F.col("q1")) * width, F.lit(least))
        chosen += [
            F.max(F.when(own, F.col("q1") * width - reach)).alias(f"{name}_low"),
            F.max(F.when(own, (F.col("q3") + 1) * width + reach)).alias(f"{name}_high"),
        ]
    return found.groupBy("kind", "name").agg(F.max("texts").alias("texts"), *chosen)


def judged(rows: DataFrame) -> DataFrame:
    """The rows of ``measured`` (staged) with base_failed and kept."""
    found = stage(bands(rows))
    edges = [f"{name}_{side}" for name in MEASURES for side in ("low", "high")]
    for kind in ("lang", "script"):
        own = found.where(F.col("kind") == kind).select(
            F.col("name").alias(kind), "texts", *[F.col(e).alias(f"{kind}_{e}") for e in edges]
        )
        rows = attach(rows, own, [kind], "texts")
    outside = F.lit(False)
    for name in MEASURES:
        low = F.coalesce(F.col(f"lang_{name}_low"), F.col(f"script_{name}_low"))
        high = F.coalesce(F.col(f"lang_{name}_high"), F.col(f"script_{name}_high"))
        outside = outside | F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))
    failed = plain_failure()
    judged_rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~outside)
    return judged_rows.drop(*[f"{kind}_{e}" for kind in ("lang", "script") for e in edges])


def rules(documents: DataFrame, pieces: str, byte_level: str) -> DataFrame:
    """doc_id, the plain counts, base_failed, kept, then the measures they rest on."""
    found = judged(stage(measured(documents, pieces, byte_level)))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "script", *MEASURES,
    )
