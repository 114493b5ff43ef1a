"""Anchor expansion against the base patterns."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from gatehouse.llm import pii
from gatehouse.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()}


def digest(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, own in base(text).items() for s, e in own).encode()).hexdigest()


CASES = [
    None, "", "a@b", "a@b.c", "x.y@z-1.org, a@b@c.d @x.y a@b..c a@b.c@d.e", "1.2.3.4.5.6.7.8 1.2..3.4.5.6 256.1.1.1 1.1.1.1.",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "+1 (555) 010-9999 +12 +1 2 ++49 30 1234567.",
    "é𝔘 é@é.com 𝔘 a@b.co 10.0.0.1", "9" * 5000 + ".1.1.1 " + "0" * 5000 + ".1.1.1", "+1" + " " * 4000 + "+1 555 0100 222", "1" * 3000,
]


def test_cases():
    for text in CASES:
        found = pii.find_spans(text) if text else {}
        assert {k: found.get(k, []) for k in pii.BASE_KINDS} == base(text), text


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1290.@+- ()é%\n5", max_size=60))
def test_any_text(text):
    found = pii.find_spans(text)
    assert {k: found.get(k, []) for k in pii.BASE_KINDS} == base(text)


def test_cued_kinds():
    text = ("See https://example.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00 end; IBAN GB00 1234 5678 9012 3456 78, "
            "account number 123-456-789, 12 Baker Street, 221B Great Portland Street. Hauptstraße 5 in Ulm, the street, a Road")
    found = {k: [text[s:e] for s, e in v] for k, v in pii.find_spans(text).items()}
    assert found["url"] == ["https://example.org/a?b=1"]
    assert found["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert found["account"] == ["123-456-789"]
    assert found["address"] == ["12 Baker Street", "221B Great Portland Street", "Hauptstraße 5"]


def test_rows_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, t, "x", 7) for t in CASES] + [(None, "a@b.co", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email long")
    found = [(r.doc_id, r.base_sha256) for r in pii.personal_data(docs).collect()]
    assert sorted(map(repr, found)) == sorted(repr((i, digest(t))) for i, t, *_ in rows)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", 5), (2, None, None), (3, "", 0), (4, "clean", 5), (5, "x 10.0.0.1", 1)],
                                 "doc_id long, text string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert found == {1: ("mail [EMAIL] now", 16), 2: (None, None), 3: ("", 0), 4: ("clean", 5), 5: ("x [IP]", 6)}


def test_query_matches_patterns(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op1_pii"](spark, folder).collect()}
    assert len(found) == len(docs)
    for doc_id, text in docs:
        own = base(text)
        assert tuple(found[doc_id][f"n_{k}"] for k in PATTERNS) == tuple(len(x) for x in own.values())
        assert found[doc_id].base_sha256 == digest(text)
