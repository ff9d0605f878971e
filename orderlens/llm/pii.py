"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. From each anchor a small deterministic parser walks
outwards to the ends of the address, number or account and checks it. Parsers of
one kind run from left to right and never look behind the end of their last
match, so matches are leftmost and do not overlap within a kind.

Kinds, in this order: email, ip, card, phone (as their patterns say), then those
the method adds: url (``http://``, ``https://``, ``ftp://``, ``www.``), iban (two
letters, two check digits, mod 97 = 1, after the cue ``IBAN``) and account (6 to
17 digits after a cue such as ``account no``, ``passport``, ``ssn``).

Defined results: null and empty texts have no spans and the digest of the empty
string; each row gives one row, repeated rows included; doc_id may be null.
Offsets count code points, the end exclusive. An empty table gives an empty result;
other columns, whatever their names, are not looked at. Each text is scanned whole in
one task, in time proportional to its length and its anchors.
"""

from __future__ import annotations

import hashlib
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from orderlens.llm.common import pick

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
# The cues that announce an identifier.
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = (
    "iban", "account number", "account no", "acct no", "passport", "ssn",
    "social security", "driver license no", "kontonummer", "customer id",
)

DIGITS = frozenset(string.digits)
LETTERS = frozenset(string.ascii_letters)
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL = LETTERS | DIGITS | frozenset("-._~:/?#[]@!$&'()*+,;=%")


def _run(text: str, at: int, allowed: frozenset) -> int:
    """Where the run of allowed characters from ``at`` ends."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From an at-sign: the run before it, then two or more dot-separated labels."""
    start = _back(text, at, LOCAL, floor)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, LABEL)
        if stop == end + 1:
            break
        end, dots = stop, dots + 1
    return (start, end, True) if dots else None


def ip(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From the first digit of a run: four dotted numbers."""
    end, valid = at, True
    for part in range(4):
        if part:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        stop = _run(text, end, DIGITS)
        if stop == end:
            return None
        number = text[end:stop].lstrip("0")
        valid = valid and len(number) <= 3 and int(number or 0) <= 255
        end = stop
    return at, end, valid


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From a digit: digits with at most one blank or dash between two of them."""
    end = at + 1
    while True:
        if end < len(text) and text[end] in DIGITS:
            end += 1
        elif end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    if end - at > 40:  # 19 digits and 18 separators are the most that can pass
        return at, end, False
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From a plus sign: digits, blanks, brackets, dots and dashes, up to the last digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 1, PHONE)
    while text[end - 1] not in DIGITS:
        end -= 1
    if end - at < 4:
        return None
    return at, end, 9 <= sum(map(DIGITS.__contains__, text[at:end])) <= 15


def url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    end = _run(text, at, URL)
    while end > at and text[end - 1] in ".,;:!?)]'":
        end -= 1
    body = text[at:end].split("://")[-1].removeprefix("www.")
    return (at, end, "." in body.split("/")[0]) if body else None


def iban(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """The word group after the cue: country, check digits, up to 30 more, mod 97 = 1."""
    while at < len(text) and text[at] in " :#.":
        at += 1
    end = at
    while end < len(text) and end - at < 42 and (text[end] in LETTERS or text[end] in DIGITS or text[end] == " "):
        end += 1
    # The longest beginning that passes, so that words after the number do no harm.
    for stop in range(end, at + 14, -1):
        body = text[at:stop].replace(" ", "").upper()
        if text[stop - 1] == " " or not 15 <= len(body) <= 34:
            continue
        if body[0] in LETTERS and body[1] in LETTERS and body[2] in DIGITS and body[3] in DIGITS:
            number = "".join(str(int(c, 36)) for c in body[4:] + body[:4])
            if int(number) % 97 == 1:
                return at, stop, True
    return None


def account(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    while at < len(text) and text[at] in " :#.=":
        at += 1
    end = at
    while end < len(text) and (text[end] in DIGITS or (text[end] == "-" and end > at)):
        end += 1
    while end > at and text[end - 1] == "-":
        end -= 1
    return (at, end, 6 <= end - at - text.count("-", at, end) <= 17) if end > at else None


def automaton() -> ahocorasick.Automaton:
    """Anchors and the parsers they start; the place handed on is where the anchor begins,
    or ends for a cue."""
    machine = ahocorasick.Automaton()
    machine.add_word("@", ("at", 1))
    machine.add_word("+", ("plus", 1))
    for digit in string.digits:
        machine.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        machine.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for spelling in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            machine.add_word(spelling, ("iban" if cue == "iban" else "cue", len(spelling)))
    machine.make_automaton()
    return machine


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url, "iban": iban, "account": account}
STARTS = {"at": ("email",), "plus": ("phone",), "digit": ("ip", "card"), "scheme": ("url",), "iban": ("iban",), "cue": ("account",)}


def spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All valid spans, by kind as listed and then by start."""
    floors = dict.fromkeys(KINDS, 0)
    found: dict[str, list] = {kind: [] for kind in KINDS}
    barren = -1
    for last, (anchor, length) in machine.iter(text):
        at = last + 1 if anchor in ("iban", "cue") else last - length + 1
        for kind in STARTS[anchor]:
            if at < floors[kind]:
                continue
            if kind == "ip" and last <= barren:
                continue
            match = PARSERS[kind](text, at, floors[kind])
            if match is None:
                if kind == "ip":
                    # No later digit of this run can begin a match either.
                    barren = _run(text, at, DIGITS) - 1
                continue
            start, end, valid = match
            floors[kind] = end
            if valid:
                found[kind].append((kind, start, end))
    return [span for kind in KINDS for span in found[kind]]


def listed(items: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in items)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string"
)


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans."""

    def run(batches):
        machine = automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                text = value.as_py()
                items = spans(text, machine) if text else []
                base = [x for x in items if x[0] in BASE_KINDS]
                for column, kind in zip(columns, BASE_KINDS, strict=False):
                    column.append(sum(x[0] == kind for x in base))
                columns[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                columns[5].append(listed(items))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *arrays], ["doc_id", *names]
            )

    return pick(documents, "doc_id", "text").mapInArrow(run, SCHEMA)
