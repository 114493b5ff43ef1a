"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over each whole text once and reports anchors: at-signs, URL schemes, digits and cues
that name an identifier. A small deterministic parser then expands each anchor to its left and right, and validates
what it found. Email, ip, card and phone are the base kinds; url, iban, account and address are added by the cues.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "address")

# Schemes, and words that announce an identifier or a postal address.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "HTTP://", "HTTPS://")
IBAN_CUES = ("IBAN", "iban", "Iban")
ACCOUNT_CUES = ("account number", "account no", "Account number", "Account no", "acct", "Kontonummer", "numéro de compte",
                "número de cuenta")
ADDRESS_CUES = (" Street", " Avenue", " Road", " Lane", " Boulevard", "straße", "strasse")

_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>()\[\]{}|\\^`]+")
_IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"[\s:#.=]{0,4}([0-9](?:[ -]?[0-9]){5,17})")
_HOUSE = re.compile(r"([0-9]{1,5}[A-Za-z]?(?: [A-Z][^\W\d_]+){1,4})$")
_HOUSE_AFTER = re.compile(r" [0-9]{1,5}[A-Za-z]?\b")
_CAPITAL_BEFORE = re.compile(r"[^\W\d_]+$")

_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    """The anchors; built once per worker."""
    if not _AUTOMATON:
        built = ahocorasick.Automaton()
        for kind, cues in (("at", "@"), ("digit", "0123456789"), ("plus", "+"), ("url", SCHEMES), ("iban", IBAN_CUES),
                           ("account", ACCOUNT_CUES), ("address", ADDRESS_CUES)):
            for cue in cues:
                built.add_word(cue, (kind, len(cue)))
        built.make_automaton()
        _AUTOMATON.append(built)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Remainder 1 modulo 97, country and check digits moved to the end."""
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


class Finder:
    """Spans of one text; ``passed`` keeps matches of a kind from overlapping, also where a match failed its test."""

    def __init__(self, text: str):
        self.text = text
        self.spans: dict[str, list[tuple[int, int]]] = {}
        self.passed = dict.fromkeys((*KINDS, "number"), 0)

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.setdefault(kind, []).append((start, end))

    def at(self, start: int, end: int) -> None:
        """Local part to the left, not before the last match; labels to the right."""
        text, left = self.text, start
        while left > self.passed["email"] and text[left - 1] in _EMAIL_LEFT:
            left -= 1
        right = _EMAIL_RIGHT.match(text, end) if left < start else None
        if right:
            self.add("email", left, right.end())
            self.passed["email"] = right.end()

    def digit(self, start: int, end: int) -> None:
        """The number that begins here, as the first of four and as the first digits of a card."""
        text, passed = self.text, self.passed
        if start >= passed["ip"] and start >= passed["number"]:
            quad = _QUAD.match(text, start)
            if quad:
                passed["ip"] = quad.end()
                parts = [part.lstrip("0") or "0" for part in quad.groups()]
                if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                    self.add("ip", start, quad.end())
            else:
                passed["number"] = _NUMBER.match(text, start).end()
        if start >= passed["card"]:
            run = _CARD.match(text, start)
            passed["card"] = run.end() if run else end
            if run and 16 <= run.end() - start:
                digits = run[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.add("card", start, run.end())

    def plus(self, start: int, end: int) -> None:
        run = _PHONE.match(self.text, start) if start >= self.passed["phone"] else None
        if run:
            self.passed["phone"] = run.end()
            if 8 <= sum("0" <= c <= "9" for c in run[0]) <= 15:
                self.add("phone", start, run.end())

    def url(self, start: int, end: int) -> None:
        run = _URL.match(self.text, end) if start >= self.passed["url"] else None
        if run and any(c.isalnum() for c in run[0]):
            stop = end + len(run[0].rstrip(".,;:!?"))
            self.add("url", start, stop)
            self.passed["url"] = stop

    def iban(self, start: int, end: int) -> None:
        run = _IBAN.match(self.text, end) if end >= self.passed["iban"] else None
        stop = run.end(1) if run else 0
        while run and stop - run.start(1) >= 15:
            if iban_valid(self.text[run.start(1) : stop]):
                self.add("iban", run.start(1), stop)
                self.passed["iban"] = stop
                return
            stop = self.text.rfind(" ", run.start(1), stop)

    def account(self, start: int, end: int) -> None:
        run = _ACCOUNT.match(self.text, end) if end >= self.passed["account"] else None
        if run:
            self.add("account", run.start(1), run.end(1))
            self.passed["account"] = run.end(1)

    def address(self, start: int, end: int) -> None:
        """House number and capitalised street name before the cue, or the number after a street in one word."""
        text = self.text
        if end < len(text) and text[end].isalnum():
            return
        before = text[max(self.passed["address"], start - 80) : start]
        if text[start] == " ":
            found = _HOUSE.search(before)
            left, right = (start - len(found[1]), end) if found else (0, 0)
        else:
            found, after = _CAPITAL_BEFORE.search(before), _HOUSE_AFTER.match(text, end)
            left, right = (start - len(found[0]), after.end()) if found and after and found[0][0].isupper() else (0, 0)
        if right:
            self.add("address", left, right)
            self.passed["address"] = right


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, in code points, each kind ordered by start and without overlaps."""
    finder = Finder(text)
    for last, (kind, length) in automaton().iter(text):
        getattr(finder, kind)(last + 1 - length, last + 1)
    return finder.spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans.get(kind, ()))


_FIELDS = (*(f"n_{kind}" for kind in KINDS), "base_sha256", "spans")


def personal_data(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` reduced to doc_id, with the number of spans of each kind, the digest of the base spans and
    all spans as ``kind:start:end``.

    Base spans are those of the base patterns, leftmost and non-overlapping per kind. A null or empty text has none.
    Repeated rows each give a row; other columns are not read.
    """
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        _find, f"doc_id bigint, {counts}, base_sha256 string, spans string")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_spans(text) if text else {} for text in (x.as_py() for x in batch.column(1))]
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            *(pa.array([len(x.get(kind, ())) for x in found], pa.int64()) for kind in KINDS),
            pa.array([hashlib.sha256(joined(x, BASE_KINDS).encode()).hexdigest() for x in found], pa.string()),
            pa.array([joined(x, KINDS) for x in found], pa.string()),
        ], names=["doc_id", *_FIELDS])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans become one, named by the first.

    A null text stays null, and ``n_chars``, where there is such a column, is counted anew.
    """
    changed = docs.withColumn("text", F.pandas_udf(_redact, "string")("text"))
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if (
        "n_chars" in docs.columns) else changed


def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(_redact_text, na_action="ignore")


def _redact_text(text: str) -> str:
    spans = sorted((start, end, kind) for kind, own in find_spans(text).items() for start, end in own)
    if not spans:
        return text
    starts, out, at = np.array([s[0] for s in spans]), [], 0
    ends = np.maximum.accumulate([s[1] for s in spans])
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] >= ends[:-1]]))
    for i, j in zip(cut, np.append(cut[1:], len(spans)), strict=True):
        out += [text[at : starts[i]], f"[{spans[i][2].upper()}]"]
        at = int(ends[j - 1])
    return "".join(out) + text[at:]
