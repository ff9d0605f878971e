"""Secret scan with dictionary-primed compression novelty.

Patterns name the candidates: assignments to sensitive names, access keys, long
hex runs, and, in texts that hold a sensitive cue, every long run of key-like
characters shortly after such a cue. Each candidate is then weighed: zstandard,
primed with a dictionary of common code and identifier text, compresses its
surroundings with and without it, and the growth in bytes per byte of the
candidate is its novelty. Names, paths, words and copies of nearby text compress
well; random strings do not. Base candidates are always reported; the others
(kind ``novel``) only if they are novel.

Defined results: null and empty texts have no spans and the digest of the empty
string; each row gives one row, repeated rows included; doc_id may be null.
Offsets count code points, the end exclusive; matches of one kind never overlap. An
empty table gives an empty result; other columns are not looked at. Each text is scanned
whole in one task, in time proportional to its length and its candidates.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from orderlens.llm.common import pick

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Maximal runs: the runs of at least 32 are exactly the runs of any length that pass.
HEX = re.compile(r"[0-9a-f]{32,}")
# Cues of a sensitive context beyond the base names.
CUES = (*NAMES, "auth", "bearer", "credential", "private", "access_key", "access key", "signature", "pwd")
CUE = re.compile("|".join(sorted(CUES, key=len, reverse=True)), re.IGNORECASE | re.ASCII)
SHORTEST = 20
KEYLIKE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
REACH = 80
AROUND = 256
NOVEL = 0.55

# Text that is common around secrets and carries no secret itself.
DICTIONARY = """
import os import sys from typing import config = settings environment variables os.environ.get(
def main(self, *args, **kwargs): return None class Client: public static final String private key
const token = process.env.TOKEN; let secret = ""; var password = "password"; "api_key": "apiKey":
Authorization: Bearer access_token refresh_token client_id client_secret username user_name passwd
BEGIN RSA PRIVATE KEY END RSA PRIVATE KEY BEGIN CERTIFICATE ssh-rsa AAAAB3NzaC1yc2E signature=
https://api.example.com/v1/ http://localhost:8080/ application/json Content-Type utf-8 charset
select from where insert into values update set create table primary key foreign_key not null
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
change_me changeme your_token_here YOUR_API_KEY example EXAMPLE xxxxxxxxxxxxxxxx 0000000000000000
_internal_identifier get_value set_value create_instance initialize configuration_manager
the of and to in is that for with this was by are from not have which will one all be as
"""


class Novelty:
    """Marginal compressed size of a piece of text within its surroundings."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict(
            DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed)

    def __call__(self, text: str, start: int, end: int) -> float:
        before = text[max(0, start - AROUND) : start]
        after = text[end : end + AROUND]
        piece = text[start:end]
        without = (before + after).encode("utf-8", "replace")
        size = len(piece.encode("utf-8", "replace"))
        whole = (after + before + piece).encode("utf-8", "replace")
        grown = len(self.compressor.compress(whole)) - len(self.compressor.compress(without))
        return max(0.0, min(1.5, grown / size))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    lower = text.lower()
    found = []
    if any(name in lower for name in NAMES):
        found += [
            ("assign", m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= 8
        ]
    if "AKIA" in text:
        found += [
            ("access", m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= 16
        ]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def added_candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs that begin within reach of a cue and touch no base span."""
    lower = text.lower()
    if not any(cue in lower for cue in CUES):
        return []
    ends = [cue.end() for cue in CUE.finditer(text)]
    runs = []
    for run in KEYLIKE.finditer(text):
        # The first cue that ends within reach before the run, or in it with a key's length left.
        first = bisect_left(ends, run.start() - REACH)
        if first == len(ends) or ends[first] > run.end() - SHORTEST:
            continue
        start = max(run.start(), ends[first])
        piece = text[start : run.end()]
        if any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece):
            runs.append((start, run.end()))
    # Both lists by start; the furthest end of the base spans that begin before a run decides.
    base = sorted((x, y) for _, x, y in taken)
    starts, reached = [x for x, _ in base], list(accumulate((y for _, y in base), max))
    free = []
    for start, end in runs:
        before = bisect_left(starts, end)
        if not before or reached[before - 1] <= start:
            free.append((start, end))
    return free


def spans(text: str, novelty: Novelty) -> tuple[list[tuple[str, int, int]], float]:
    """All spans by start and then kind, and the greatest novelty among the candidates."""
    found = base_spans(text)
    weights = [novelty(text, start, end) for _, start, end in found]
    for start, end in added_candidates(text, found):
        weight = novelty(text, start, end)
        weights.append(weight)
        if weight >= NOVEL:
            found.append(("novel", start, end))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found, max(weights, default=0.0)


def listed(items: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in items)


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans string, novelty double"
)


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans and
    the greatest novelty (0 without a candidate)."""

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, lists, tops = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                items, top = spans(text, novelty) if text else ([], 0.0)
                base = [x for x in items if x[0] in BASE_KINDS]
                for column, kind in zip(counts, BASE_KINDS, strict=True):
                    column.append(sum(x[0] == kind for x in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(items))
                tops.append(top)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array(lists, pa.string()),
                    pa.array(tops, pa.float64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty"],
            )

    return pick(documents, "doc_id", "text").mapInArrow(run, SCHEMA)
