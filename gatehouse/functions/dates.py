"""Date text: a documented month-first set of shapes, parsed to ``timestamp_ntz``.

Accepted, each with optional outer whitespace: ``2024-01-05``, ``2024/1/5``, ``1/5/2024``, ``1-5-2024``,
``Jan 5, 2024``, ``January 5 2024``, ``5 Jan 2024``; each optionally followed by a blank or ``T`` and ``H:mm``,
``H:mm:ss`` or ``H:mm:ss.fffffff``, optionally with AM/PM, or with ``Z`` / ``+hh:mm`` (converted to UTC), also without
seconds or after a blank. Two-digit years (``1/5/24``, up to 49 in this century), ``2024-01`` (its first day), a leading
weekday name, which is not compared with the day, and a trailing ``GMT`` are accepted as well.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from gatehouse.functions.text import trim_ws

# English month names; the first three letters also stand alone.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"
_ABBREVIATIONS = "".join(m[:3] for m in MONTHS)

_CLOCK = r"[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,7})?)?"
_TWELVE = r"[T ](?:0?[1-9]|1[0-2]):\d{2}(?::\d{2}(?:\.\d{1,7})?)? ?[AaPp][Mm]"
_ZONED_CLOCK = r"[T ]\d{1,2}:\d{2}:\d{2}(?:\.\d{1,7})?(?:Z|[+-]\d{2}:\d{2})"
_NUMERIC_DAY = r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}([/-])\d{1,2}[/-]\d{4})"
_NAME_FIRST = _MONTH + r"\.? (\d{1,2}),? (\d{4})"
_NAME_SECOND = r"(\d{1,2})[ -]" + _MONTH + r"[ -](\d{4})"

_NUMERIC = rf"\A{_NUMERIC_DAY}(?:{_CLOCK})?\z"
_ZONED = rf"\A\d{{4}}-\d{{1,2}}-\d{{1,2}}{_ZONED_CLOCK}\z"
_NAMED_DAY = f"(?:{_NAME_FIRST}|{_NAME_SECOND})"
_WORDED = rf"(?i)\A(?:{_NAMED_DAY}(?:{_CLOCK})?|(?:{_NUMERIC_DAY}|{_NAMED_DAY}){_TWELVE})\z"
# A cheap first test: a day with two separators, or letters where a month name may stand.
_CANDIDATE = r"\d[/-]\d{1,2}[/-]\d|\A\s*\d{4}-\d{1,2}\s*\z|(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec).*\d{4}"


_WEEKDAY = r"(?i)\A(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? "
_SHORT_YEAR = r"\A(\d{1,2})([/-])(\d{1,2})\2"
_ZONE = r"(?:Z|[+-]\d{2}:\d{2})\z"
# Shapes that are brought to one of the others first, and how.
_REWRITES = (
    (_WEEKDAY, ""),
    (r"(?i)(:\d{2}) GMT\z", "$1"),
    (_SHORT_YEAR + r"([0-4]\d)(?=\z|[T ])", "$1$2$3$220$4"),
    (_SHORT_YEAR + r"([5-9]\d)(?=\z|[T ])", "$1$2$3$219$4"),
    (r"\A(\d{4}-\d{1,2})\z", "$1-1"),
    (rf" (?={_ZONE})", ""),
    (rf"\A([^ T]+[T ]\d{{1,2}}:\d{{2}})(?={_ZONE})", "$1:00"),
)
_REWRITTEN = "|".join(f"(?:{pattern})" for pattern, _ in (*_REWRITES[:2], *_REWRITES[4:])) + (
    r"|\A\d{1,2}[/-]\d{1,2}[/-]\d{2}(?=\z|[T ])")


def to_datetime(value: Column) -> Column:
    """Timestamp without zone, or null when the text is in none of the accepted shapes.

    Each shape has a branch that rewrites the day to year-month-day by replacements mentioning their input once,
    which keeps the generated code small, and then casts. Rarer shapes are rewritten first, outside generated code.
    """
    text = trim_ws(value)
    rewritten = text
    for pattern, replacement in _REWRITES:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    rare = F.get(F.transform(F.array(rewritten), _parsed), F.lit(0))
    return F.when(value.rlike(_CANDIDATE), F.when(text.rlike(_REWRITTEN), rare).otherwise(_parsed(text)))


def _parsed(text: Column) -> Column:
    return (
        F.when(text.rlike(_NUMERIC), _year_first(text).try_cast("timestamp_ntz"))
        .when(text.rlike(_ZONED), _to_utc(text))
        .when(text.rlike(_WORDED), _worded(text))
    )


def _year_first(text: Column) -> Column:
    for pattern, replacement in (
        (r"\A(\d{1,2})[/-](\d{1,2})[/-](\d{4})", "$3-$1-$2"),
        (r"\A(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _to_utc(text: Column) -> Column:
    return F.convert_timezone(None, F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))


def _named(text: Column) -> Column:
    """Month-name text with the day as year-month-day; other text unchanged."""
    abbreviation = F.lower(F.regexp_extract(text, "[A-Za-z]{3}", 0))
    month = ((F.position(abbreviation, F.lit(_ABBREVIATIONS)) + 2) / 3).cast("int").cast("string")
    first = F.regexp_replace(text, rf"(?i)\A{_NAME_FIRST}", "$3-$1-$2")
    second = F.regexp_replace(first, rf"(?i)\A{_NAME_SECOND}", "$3-$2-$1")
    return F.regexp_replace(second, F.lit(r"(?<=-)[A-Za-z]{3,9}(?=-)"), month)


def _worded(text: Column) -> Column:
    """Month names and twelve-hour clocks: the day at hour zero plus the hour as it is meant."""
    at_zero = F.regexp_replace(_year_first(_named(text)), r"[T ]\d{1,2}:([0-9:.]+).*\z", " 00:$1")
    written = F.coalesce(F.regexp_extract(text, r"[T ](\d{1,2}):", 1).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(text, r"(?i)[ap]m\z", 0))
    hour = F.when(half == "am", written % 12).when(half == "pm", written % 12 + 12).when(written < 24, written)
    return at_zero.try_cast("timestamp_ntz") + F.make_dt_interval(hours=hour)


# One-letter standard formats and the pattern each stands for.
STANDARD_FORMATS = {
    "d": "MM/dd/yyyy",
    "D": "dddd, dd MMMM yyyy",
    "f": "dddd, dd MMMM yyyy HH:mm",
    "F": "dddd, dd MMMM yyyy HH:mm:ss",
    "g": "MM/dd/yyyy HH:mm",
    "G": "MM/dd/yyyy HH:mm:ss",
    "M": "MMMM dd",
    "m": "MMMM dd",
    "o": "yyyy-MM-ddTHH:mm:ss.fffffff",
    "O": "yyyy-MM-ddTHH:mm:ss.fffffff",
    "s": "yyyy-MM-ddTHH:mm:ss",
    "t": "HH:mm",
    "T": "HH:mm:ss",
    "u": "yyyy-MM-dd HH:mm:ssZ",
    "Y": "yyyy MMMM",
    "y": "yyyy MMMM",
}
# Format tokens whose Spark spelling differs; all other letters are literal text.
TOKENS = {
    "yyyy": "yyyy", "yy": "yy", "y": "yy",
    "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M",
    "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d",
    "HH": "HH", "H": "H", "hh": "hh", "h": "h",
    "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a",
}


_FORMAT_RUN = re.compile(
    r"'(?P<quoted>[^']*)'|(?P<token>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<other>[^A-Za-z'])"
)


def spark_date_pattern(pattern: str) -> str:
    """Translate a custom or one-letter date format to Spark's pattern letters."""
    expanded = STANDARD_FORMATS.get(pattern, pattern)
    pieces = []
    for run in _FORMAT_RUN.finditer(expanded):
        if run["quoted"] is not None:
            pieces.append(_literal(run["quoted"]))
        elif run["token"]:
            token = run["token"]
            if set(token) == {"f"}:
                pieces.append("S" * len(token))
            else:
                pieces.append(TOKENS.get(token) or _literal(token))
        else:
            pieces.append(run["other"])
    return "".join(pieces)


def _literal(text: str) -> str:
    return f"'{text}'" if text else ""


def format_datetime(value: Column, pattern: str) -> Column:
    """Print date text in another format; null when the text is not a date."""
    return F.date_format(to_datetime(value), spark_date_pattern(pattern))
