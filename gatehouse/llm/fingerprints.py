"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of each of its prefixes, modulo a Mersenne prime and for two
bases. A difference of two entries answers whether two spans are equal, wherever they are, and a binary search over
lengths finds the longest common extension of two positions. A fingerprint keeps the whole hash, the prefix and suffix
hashes at a grid of places, and the smallest hashes among all spans of one length, so that two fingerprints tell how
much the texts share, in place or moved. The texts of a block are hashed as one, with one pair of prefix arrays; a span's
hash does not depend on where it stands.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIME = (1 << 31) - 1
BASES = (1_103_515_249, 69_069_157)
#: Grid places at most, span length in code points, and span hashes kept.
GRID, SPAN, KEPT = 32, 24, 32
#: Code points of the texts that are hashed together.
BLOCK_CHARS = 1 << 18
#: Standard deviations by which the share estimated from KEPT hashes must exceed what is shared in place.
DEVIATIONS = 2.0

_MASK = np.uint64(PRIME)
_TABLES: list[tuple[np.ndarray, ...]] = []


def reduce(values: np.ndarray) -> np.ndarray:
    """Modulo the prime, for values below 2^62."""
    values = (values & _MASK) + (values >> np.uint64(31))
    values = (values & _MASK) + (values >> np.uint64(31))
    return np.where(values >= _MASK, values - _MASK, values)


def _powers(length: int) -> tuple[np.ndarray, ...]:
    """Powers of both bases and of their inverses, grown by doubling."""
    if not _TABLES or len(_TABLES[0][0]) < length:
        size = 1 << max(16, (length - 1).bit_length())
        tables = []
        for base in (*BASES, *(pow(b, -1, PRIME) for b in BASES)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, reduce(out * np.uint64(pow(base, len(out), PRIME)))])
            tables.append(out)
        _TABLES[:] = [tuple(tables)]
    return _TABLES[0]


class Prefixes(NamedTuple):
    """Prefix arrays of a text for both bases: entry i is the sum of code[j] * base^j for j < i."""

    sums: tuple[np.ndarray, np.ndarray]

    @property
    def length(self) -> int:
        return len(self.sums[0]) - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hash of each span; equal spans of equal or other texts have equal hashes."""
        powers, out = _powers(self.length + 1), np.zeros(len(starts), np.uint64)
        for base in (0, 1):
            part = self.sums[base]
            out = (out << np.uint64(31)) | reduce(reduce(part[ends] + _MASK - part[starts]) * powers[2 + base][starts])
        return out

    def equal(self, start: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` from ``start`` and from ``at`` are equal, wherever the two are."""
        return self.spans(start, start + length) == self.spans(at, at + length)

    def common_extension(self, start: np.ndarray, at: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Length, up to ``most``, of the longest common prefix of what follows ``start`` and what follows ``at``; with
        ``back``, of the longest common suffix of what goes before them. A binary search for all pairs at once."""
        low, high = np.zeros(len(start), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            same = self.equal(start - shift, at - shift, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefixes(codes: np.ndarray) -> Prefixes:
    powers, sums = _powers(len(codes) + 1), []
    values = codes.astype(np.uint64) + np.uint64(1)
    for base in (0, 1):
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(reduce(values * powers[base][: len(codes)]), out=out[1:])
        sums.append(reduce(out))
    return Prefixes((sums[0], sums[1]))


class Fingerprint(NamedTuple):
    """Length, whole hash, grid step with 32 bits of the hashes of prefixes and suffixes at its multiples, and of the
    smallest span hashes."""

    length: int
    whole: int
    step: int
    heads: np.ndarray
    tails: np.ndarray
    least: np.ndarray

    def text(self) -> str:
        numbers = np.concatenate([self.heads, self.tails, self.least]).astype(">u4").tobytes().hex()
        return f"{self.length:x}.{self.whole:x}.{self.step:x}.{len(self.heads):x}.{numbers}"


def parse(text: str) -> Fingerprint:
    """The fingerprint written by ``Fingerprint.text``."""
    length, whole, step, grid, numbers = text.split(".")
    parts = np.split(np.frombuffer(bytes.fromhex(numbers), ">u4").astype(np.uint32), [int(grid, 16), 2 * int(grid, 16)])
    return Fingerprint(int(length, 16), int(whole, 16), int(step, 16), *parts)


def _short(values: np.ndarray) -> np.ndarray:
    return (_spread(values) >> np.uint64(32)).astype(np.uint32)


def together(texts: list[np.ndarray]) -> tuple[Prefixes, np.ndarray]:
    """Prefix arrays of the texts one after the other, and the bounds of each."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    return prefixes(np.concatenate([np.empty(0, np.uint32), *texts])), bounds


def fingerprints_of(found: Prefixes, bounds: np.ndarray) -> list[Fingerprint]:
    """The fingerprint of each text between two bounds."""
    length = np.diff(bounds)
    span = np.minimum(SPAN, length)
    spans = np.where(length > 0, length - span + 1, 0)
    step = np.ones(len(length), np.int64)
    while (over := length // step > GRID).any():
        step[over] *= 2
    places = length // step
    first, grid_of = np.cumsum(places) - places, np.repeat(np.arange(len(length)), places)
    grid = (np.arange(int(places.sum())) - first[grid_of] + 1) * step[grid_of]
    begin, end = bounds[:-1][grid_of], bounds[1:][grid_of]
    heads, tails = _short(found.spans(begin, begin + grid)), _short(found.spans(end - grid, end))
    whole = found.spans(bounds[:-1], bounds[1:])
    before, span_of = np.cumsum(spans) - spans, np.repeat(np.arange(len(length)), spans)
    starts = np.arange(int(spans.sum())) - before[span_of] + bounds[:-1][span_of]
    hashes = _short(found.spans(starts, starts + span[span_of]))
    out = []
    for i, n in enumerate(length.tolist()):
        own, at = hashes[before[i] : before[i] + spans[i]], slice(first[i], first[i] + places[i])
        if len(own) > 4 * KEPT:
            near = np.partition(own, 4 * KEPT)[: 4 * KEPT]
            own = near if len(np.unique(near)) >= KEPT else own
        out.append(Fingerprint(n, int(whole[i]), int(step[i]), heads[at], tails[at], np.unique(own)[:KEPT]))
    return out


def fingerprint(codes: np.ndarray) -> Fingerprint:
    return fingerprints_of(*together([codes]))[0]


def _spread(values: np.ndarray) -> np.ndarray:
    """A bijection, so that the smallest hashes are a fair sample of the spans."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _shared(a: Fingerprint, left: np.ndarray, b: Fingerprint, right: np.ndarray) -> int:
    """The largest common grid place at which both hashes agree: a binary search, as they agree up to it only."""
    step = max(a.step, b.step)
    left, right = left[step // a.step - 1 :: step // a.step], right[step // b.step - 1 :: step // b.step]
    low, high = 0, min(len(left), len(right))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if left[middle - 1] == right[middle - 1] else (low, middle - 1)
    return low * step


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: the share in place, common head and tail against the longer text; or, where that is larger by DEVIATIONS
    of the estimate of texts that share no more than that, the share of spans estimated from the smallest hashes of both,
    for text that moved (as 2 J / (1 + J), the shared part of two texts of one length)."""
    if a.length == b.length and a.whole == b.whole:
        return 1.0
    if not a.length or not b.length:
        return 0.0
    shorter, longer = sorted((a.length, b.length))
    in_place = min(_shared(a, a.heads, b, b.heads) + _shared(a, a.tails, b, b.tails), shorter) / longer
    both = np.union1d(a.least, b.least)[:KEPT]
    jaccard = np.isin(both, np.intersect1d(a.least, b.least)).mean() if min(shorter, SPAN) == min(longer, SPAN) else 0.0
    moved, expected = 2 * jaccard / (1 + jaccard), in_place / (2 - in_place)
    deviation = np.sqrt(expected * (1 - expected) / max(1, len(both))) * 2 / (1 + expected) ** 2
    return float(moved if moved > in_place + DEVIATIONS * deviation else in_place)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    "near_next double, head_next bigint, tail_next bigint"
)
_SCHEMA = pa.schema([(x.split()[0], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in _RESULT.split(",")])
#: Rows of one stretch of doc_ids, about, and stretches at most; a stretch is one unit of sorting, on disk if need be.
STRETCH_ROWS, STRETCHES = 1_000, 16_384


class Cuts(NamedTuple):
    """Bounds that cut the doc_ids into stretches, and into how many parts a doc_id of many rows, alone between two bounds,
    is cut by the hash of its texts; None stands for the null doc_ids."""

    bounds: list[int]
    parts: dict[int | None, int]


def _cuts(ids: DataFrame) -> Cuts:
    """Stretches of even numbers of rows, from a quantile sketch and the doc_ids that have more rows than a stretch."""
    rows = ids.count()
    most = max(STRETCH_ROWS, -(-rows // STRETCHES))
    if rows <= most:
        return Cuts([], {})
    # A doc_id of more than a stretch's rows: there are as many as stretches at most.
    hot = {r["doc_id"]: -(-r["count"] // most) for r in ids.groupBy("doc_id").count().filter(F.col("count") > most).collect()}
    parts = -(-rows // most)
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * parts)).alias("cuts")).first()["cuts"] or []
    alone = [bound for doc_id in hot if doc_id is not None for bound in (doc_id, doc_id + 1)]
    return Cuts(sorted({*cuts, *alone}), hot)


def _stretch(bounds: list[int]) -> Column:
    """Number of bounds above the doc_id, found in two steps; nulls come after the smallest doc_id."""
    each = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    doc_id = F.col("doc_id")

    def literals(values: list[int]) -> Column:
        return F.array(*(F.lit(v).cast("bigint") for v in values)).cast("array<bigint>")

    # Groups whose first bound is above count as a whole; of the group before them some bounds may be.
    first = F.size(F.filter(literals([g[0] for g in groups]), lambda cut: cut <= doc_id))
    above = F.lit(len(bounds)) - (first - 1) * each - F.size(F.filter(
        F.get(F.array(*map(literals, groups)), first - 1), lambda cut: cut <= doc_id)) if groups else F.lit(0)
    found = F.when(first == 0, F.lit(len(bounds))).otherwise(above) if groups else F.lit(0)
    return F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(found).cast("int")


def _part(parts: dict[int | None, int]) -> Column:
    """Which part of its stretch a row is in, by its text's hash."""
    number = F.lit(1)
    if named := {doc_id: n for doc_id, n in parts.items() if doc_id is not None}:
        number = F.coalesce(F.create_map(*(F.lit(x).cast("bigint") for pair in named.items() for x in pair))[F.col("doc_id")], F.lit(1))
    number = F.when(F.col("doc_id").isNull(), F.lit(parts.get(None, 1))).otherwise(number)
    return F.floor((F.col("text_hash") / F.lit(2.0**64) + 0.5) * number).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: lengths, fingerprints, likeness to the edited and to the next text, and the lengths of
    the longest common beginning and end with the next text.

    The next text is that of the next row by descending doc_id (null doc_ids last, rows of one doc_id by the hash of
    their text), and of the first row for the last. A null text counts as empty; the likeness of two empty texts is 1,
    that of an empty and another text 0. Other columns are not read.

    Rows are cut into stretches by fixed bounds and shuffled once; the first row of each stretch is also sent to the
    stretch before, as the follower of its last row.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    cuts = _cuts(ids)
    placed = own.withColumn("stretch", _stretch(cuts.bounds)).withColumn("part", _part(cuts.parts))
    keys = ["stretch", "part"]
    firsts = placed.groupBy(*keys).agg(F.max("doc_id").alias("first")).orderBy(*keys).collect()
    rows = placed.select(*keys, F.lit(False).alias("follower"), "doc_id", "text_hash", "text")
    if firsts:
        starts = docs.sparkSession.createDataFrame(
            [(r["stretch"], r["part"], r["first"], *(firsts[i - 1][k] for k in keys)) for i, r in enumerate(firsts)],
            "at int, nth int, first bigint, stretch_before int, part_before int")
        # One row per stretch and part, of which there are about twice STRETCHES at most.
        found = placed.join(F.broadcast(starts), (placed["stretch"] == starts["at"]) & (placed["part"] == starts["nth"])
                            & placed["doc_id"].eqNullSafe(starts["first"]))
        followers = found.groupBy("stretch_before", "part_before").agg(F.min(F.struct("text_hash", "text")).alias("least")).select(
            F.col("stretch_before").alias("stretch"), F.col("part_before").alias("part"), F.lit(True).alias("follower"),
            F.lit(None).cast("bigint").alias("doc_id"), "least.text_hash", "least.text")
        rows = rows.union(followers)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "follower", F.col("doc_id").desc_nulls_last(), "text_hash", "text")
    return dealt.select("follower", "doc_id", "text").mapInArrow(_walk, _RESULT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in sorted rows; a row is given out when its follower is known, with others of its block."""
    held, waiting, size = None, [], 0
    for batch in batches:
        for follower, doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held is not None:
                waiting.append((*held, text))
                size += len(held[1]) + len(text)
            held = None if follower else (doc_id, text)
            if size >= BLOCK_CHARS:
                yield _rows(waiting)
                waiting, size = [], 0
    if waiting:
        yield _rows(waiting)


def _rows(pairs: list[tuple]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, next text) rows; each next text is most often the next row's text as well."""
    ids, texts, following = zip(*pairs, strict=True)
    changed = [edited(text, after) for text, after in zip(texts, following, strict=True)]
    every = list(dict.fromkeys([*texts, *following, *changed]))
    number = {text: i for i, text in enumerate(every)}
    found, bounds = together([code_points(text) for text in every])
    prints = fingerprints_of(found, bounds)
    written = [x.text() for x in prints]
    own, after, other = (np.array([number[text] for text in side], np.int64) for side in (texts, following, changed))
    length = np.diff(bounds)
    most = np.minimum(length[own], length[after])
    columns = [
        ids, length[own], [hashlib.sha256(text.encode()).hexdigest() for text in changed], [written[i] for i in own], [written[i] for i in other],
        [likeness(prints[a], prints[b]) for a, b in zip(own, other, strict=True)],
        [likeness(prints[a], prints[b]) for a, b in zip(own, after, strict=True)],
        found.common_extension(bounds[:-1][own], bounds[:-1][after], most),
        found.common_extension(bounds[1:][own], bounds[1:][after], most, back=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
