"""Phrase collocations by Rabin-Karp fingerprints.

Words of each language are written once, as blocks of word numbers. In a block, prefix polynomials over the words'
hashes give the fingerprint of every n-gram in constant time. A block sends each fingerprint once, with its occurrences
and the block as pointer to them; a shuffle adds up the fingerprints, and frequent ones go back to the blocks they point
to. Words and pairs come first, then longer n-grams all of whose pairs are frequent, from the stretches of the blocks
that have any. Where a frequent fingerprint points to, the words are spelt out, counted and added up by their text, so
fingerprints that collide are told apart, and no other phrase is ever spelt.

Fingerprints and phrases move as sorted, compressed runs: one row for a block and a bucket of fingerprints, which holds
a bounded share of the words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from gatehouse.llm.arrow_text import LOWER, Block, mix, span_hashes, text_blocks, tokens
from gatehouse.llm.rows import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Words after which a task writes its blocks, and words whose fingerprints meet in one bucket.
BLOCK_WORDS, BUCKET_WORDS = 2_000_000, 2_000_000
#: Bits of a fingerprint; a collision costs a place among the frequent ones until the text is read.
_FINGERPRINT = np.uint64((1 << 48) - 1)

_CODES = np.arange(256)
#: Bytes at which texts are split into pieces, and those of words.
_SPLIT = np.isin(_CODES, [*b".,;:!?", *range(0x0A, 0x0E)])
_WORD = ~(_SPLIT | np.isin(_CODES, [0x20, 0x09]))
#: The polynomials' base is odd, so that it has an inverse modulo 2^64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _words(block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, first, bounds): lower-cased words of the block, whether each begins a piece, and the bounds of each text's."""
    found = tokens(block, _WORD)
    letters = LOWER[block.data][_WORD[block.data]]
    offsets = np.concatenate([[0], np.cumsum(found.ends - found.starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(found.starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes()))
    splits = np.concatenate([[0], np.cumsum(_SPLIT[block.data])])[found.starts]
    first = np.ones(len(found.starts), bool)
    first[1:] = splits[1:] != splits[:-1]
    first[found.bounds[:-1][found.bounds[:-1] < len(first)]] = True
    return words, first, found.bounds


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers with their bytes in planes, compressed."""
    planes = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


def _text(lines: list[str]) -> bytes:
    return zstandard.compress("\n".join(lines).encode(), 1)


def _lines(blob: bytes) -> list[str]:
    return zstandard.decompress(blob).decode().split("\n")


#: Rows that blocks give: their words, their fingerprints (``words`` has the sorted differences, ``numbers`` the
#: occurrences), and their phrases (``words`` has the texts, ``numbers`` the occurrences).
_BLOCK, _GRAMS, _PHRASES = 0, 1, 2
_ROWS = "kind int, bucket bigint, block bigint, lang string, words binary, numbers binary"
_TABLE = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()),
                    ("numbers", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _TABLE, strict=True)], schema=_TABLE) \
        if rows else _TABLE.empty_table()


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, lang, n, words, numbers): the block's different words, and its n words' numbers, 0 before each piece."""
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    size, written, part = 0, 0, TaskContext.get().partitionId()

    def out():
        nonlocal written
        for lang, parts in held.items():
            words = pa.chunked_array([own for own, _ in parts]).combine_chunks()
            words = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
            numbers, first = words.indices.to_numpy().astype(np.int64) + 1, np.concatenate([x for _, x in parts])
            spaced = np.zeros(len(first) + int(first.sum()), np.int64)
            spaced[np.arange(len(first)) + np.cumsum(first)] = numbers
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 24 | written], pa.int64()), pa.array([lang]), pa.array([len(numbers)], pa.int64()),
                pa.array([_text(words.dictionary.to_pylist())], pa.binary()), pa.array([_packed(spaced)], pa.binary())],
                names=["block", "lang", "n", "words", "numbers"])
            written += 1
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in text_blocks(batch.column(1)):
            words, first, bounds = _words(block)
            own = langs[block.first : block.first + block.count]
            run = 0
            for i in range(1, block.count + 1):
                if i == block.count or own[i] != own[run]:
                    low, high = bounds[run], bounds[i]
                    if high > low:
                        held.setdefault(own[run], []).append((words.slice(low, high - low), first[low:high]))
                    run = i
            size += len(words)
            if size >= limit:
                yield from out()
                size = 0
    yield from out()


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Write the words of ``docs`` to the shared scratch folder, in blocks of one language each, and return them."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").alias("text"))
    return stored(rows.mapInArrow(
        lambda batches: _blocks(batches, block_words), "block bigint, lang string, n bigint, words binary, numbers binary"), "word-blocks")


class Words:
    """A block's words by number, the sequence of numbers, and prefix polynomials over the words' hashes."""

    def __init__(self, words: list[str], numbers: np.ndarray, lang: str):
        self.words, self.numbers, self.lang = words, numbers, lang
        letters = np.frombuffer("\n".join([*words, lang]).encode(), np.uint8)
        ends = np.append(np.flatnonzero(letters == 0x0A)[: len(words)], len(letters))
        hashes = span_hashes(letters, np.append(0, ends[: len(words)] + 1), ends)
        self.salt = hashes[-1]
        hashes = np.append(np.uint64(0), hashes[: len(words)])[numbers]
        power, self.inverse = np.full(len(numbers), _BASE, np.uint64), np.full(len(numbers), _INVERSE, np.uint64)
        power[:1] = self.inverse[:1] = 1
        self.inverse = np.multiply.accumulate(self.inverse)
        self.sums = np.append(np.uint64(0), np.cumsum(hashes * np.multiply.accumulate(power)))

    def fingerprints(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Fingerprint of the ``size`` words from each of ``starts`` on; the language is part of it."""
        return mix((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts] + self.salt + np.uint64(size)) & _FINGERPRINT

    def inside(self, size: int) -> np.ndarray:
        """Starts of all n-grams of ``size`` words inside a piece."""
        word = self.numbers > 0
        whole = word[: max(0, len(word) - size + 1)].copy()
        for k in range(1, size):
            whole &= word[k : k + len(whole)]
        return np.flatnonzero(whole)

    def among(self, starts: np.ndarray, size: int, frequent: np.ndarray) -> np.ndarray:
        """Those of ``starts`` whose fingerprint is one of the sorted ``frequent`` ones."""
        if not len(frequent):
            return starts[:0]
        fp = self.fingerprints(starts, size)
        return starts[frequent[np.minimum(np.searchsorted(frequent, fp), len(frequent) - 1)] == fp]

    def longer(self, frequent: np.ndarray, size: int) -> np.ndarray:
        """Starts of n-grams all of whose pairs are frequent."""
        pair = np.zeros(len(self.numbers) + size, bool)
        pair[self.among(self.inside(2), 2, frequent)] = True
        starts = self.inside(size)
        for k in range(size - 1):
            starts = starts[pair[starts + k]]
        return starts

    def counted(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprints, places, occurrences) of the different n-grams at ``starts``, told apart by their words."""
        found = []
        while len(starts):
            fp, at, own, n = np.unique(self.fingerprints(starts, size), return_index=True, return_inverse=True, return_counts=True)
            place, same = starts[at], np.ones(len(starts), bool)
            for k in range(size):
                same &= self.numbers[starts + k] == self.numbers[place[own] + k]
            if not same.all():
                n = np.bincount(own[same], minlength=len(fp))
            found.append((fp, place, n))
            starts = starts[~same]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)

    def spelt(self, places: np.ndarray, size: int) -> list[str]:
        words, numbers = self.words, self.numbers
        return [" ".join([words[number - 1] for number in run]) for run in numbers[places[:, None] + np.arange(size)].tolist()]

    def cut(self, starts: np.ndarray, size: int) -> "Words":
        """The stretches that n-grams of ``size`` words at ``starts`` cover, as a block of their own."""
        covered = np.zeros(len(self.numbers) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.minimum(starts + size, len(self.numbers)), -1)
        inside = np.cumsum(covered[:-1]) > 0
        keep = np.flatnonzero(inside | np.append(False, inside[:-1]))
        numbers = np.where(inside[keep], self.numbers[keep], 0)
        used = np.unique(numbers[numbers > 0])
        names = np.zeros(len(self.words) + 1, np.int64)
        names[used] = np.arange(1, len(used) + 1)
        return Words([self.words[number - 1] for number in used.tolist()], names[numbers], self.lang)


def _of_block(row: pa.Table) -> Words:
    return Words(_lines(row.column("words")[0].as_py()), _unpacked(row.column("numbers")[0].as_py()), row.column("lang")[0].as_py())


def _by_bucket(fp: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, numbers of its fingerprints), ascending."""
    bucket = fp % np.uint64(buckets)
    order = np.lexsort((fp, bucket))
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _gram_rows(block: int, own: Words, sizes: dict[int, np.ndarray], buckets: int) -> list[tuple]:
    """Fingerprint rows of the n-grams at the given starts, by size."""
    found = [own.counted(starts, size) for size, starts in sizes.items()]
    fp, n = (np.concatenate([x[i] for x in found]) for i in (0, 2))
    return [(_GRAMS, bucket, block, None, _packed(np.diff(fp[part].astype(np.int64), prepend=0)), _packed(n[part]))
            for bucket, part in _by_bucket(fp, buckets)]


def _phrase_rows(own: Words, frequent: np.ndarray, sizes: tuple[int, ...], buckets: int) -> list[tuple]:
    """Phrase rows of the n-grams that have a frequent fingerprint."""
    fps, texts, counts = [], [], []
    for size in sizes:
        fp, place, n = own.counted(own.among(own.inside(size), size, frequent), size)
        fps.append(fp)
        texts.extend(own.spelt(place, size))
        counts.append(n)
    fp, n = np.concatenate(fps), np.concatenate(counts)
    return [(_PHRASES, bucket, None, own.lang, _text([texts[i] for i in part.tolist()]), _packed(n[part])) for bucket, part in _by_bucket(fp, buckets)]


def _short(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Words and pairs of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(i, 1)])
            own = _of_block(row)
            rows = _gram_rows(row.column("block")[0].as_py(), own, {size: own.inside(size) for size in (1, 2)}, buckets)
            yield from _table(rows).to_batches()


def _frequent(rows: pa.Table, least: int) -> pa.Table:
    """(block, fps): of the fingerprint rows of one bucket, the frequent fingerprints of each block."""
    fps = [np.cumsum(_unpacked(x.as_py())) for x in rows.column("words")]
    owner = np.repeat(np.arange(len(fps)), [len(x) for x in fps])
    every, own = np.unique(np.concatenate(fps), return_inverse=True)
    total = np.bincount(own, np.concatenate([_unpacked(x.as_py()) for x in rows.column("numbers")]), len(every))
    keep = np.flatnonzero(total[own] >= least)
    parts = np.split(keep, np.searchsorted(owner[keep], np.arange(1, len(fps))))
    fp = np.concatenate(fps)
    some = [i for i, part in enumerate(parts) if len(part)]
    return pa.table({"block": rows.column("block").take(pa.array(some, pa.int64())),
                     "fps": pa.array([_packed(np.diff(fp[parts[i]], prepend=0)) for i in some], pa.binary())})


def _fps(rows: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.cumsum(_unpacked(x.as_py())) for x in rows.column("fps")])).astype(np.uint64)


def _middle(row: pa.Table, rows: pa.Table, longest: int, buckets: int) -> pa.Table:
    """Of a block and its frequent words and pairs: their phrases, its longer n-grams, and the stretches these cover."""
    if not row.num_rows or not rows.num_rows:
        return _TABLE.empty_table()
    own, frequent, block = _of_block(row), _fps(rows), row.column("block")[0].as_py()
    out = _phrase_rows(own, frequent, (1, 2), buckets)
    if longest > 2:
        rest = own.cut(own.longer(frequent, 3), 3)
        if len(rest.words):
            out += _gram_rows(block, rest, {size: rest.longer(frequent, size) for size in range(3, longest + 1)}, buckets)
            out.append((_BLOCK, None, block, own.lang, _text(rest.words), _packed(rest.numbers)))
    return _table(out)


def _last(row: pa.Table, rows: pa.Table, longest: int, buckets: int) -> pa.Table:
    """Of a block's stretches and its frequent longer n-grams: their phrases."""
    if not row.num_rows or not rows.num_rows:
        return _TABLE.empty_table()
    return _table(_phrase_rows(_of_block(row), _fps(rows), tuple(range(3, longest + 1)), buckets))


def _added(rows: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, size, f) of the frequent phrases of one bucket, added up by text."""
    texts = [_lines(x.as_py()) for x in rows.column("words")]
    table = pa.table({
        "lang": rows.column("lang").combine_chunks().take(pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in texts]))),
        "phrase": pa.array([phrase for own in texts for phrase in own], pa.string()),
        "f": np.concatenate([_unpacked(x.as_py()) for x in rows.column("numbers")])})
    found = table.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    found = found.filter(pa.compute.greater_equal(found.column("f_sum"), least))
    size = pa.compute.add(pa.compute.count_substring(found.column("phrase"), " "), 1)
    return pa.table({"lang": found.column("lang"), "phrase": found.column("phrase"), "size": size.cast(pa.int32()), "f": found.column("f_sum")})


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, size, f) of every phrase of up to ``longest`` words with at least ``least``
    occurrences, and (lang, n), the number of all words."""
    blocks = word_blocks(docs, block_words)
    totals = stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))

    def frequent(grams: DataFrame, label: str) -> DataFrame:
        own = grams.filter(F.col("kind") == _GRAMS).select("bucket", "block", "words", "numbers")
        return stored(own.groupBy("bucket").applyInArrow(lambda rows: _frequent(rows, least), "block bigint, fps binary"), label)

    short = frequent(blocks.mapInArrow(lambda batches: _short(batches, buckets), _ROWS), "frequent-pairs")
    middle = stored(blocks.groupBy("block").cogroup(short.groupBy("block")).applyInArrow(
        lambda row, rows: _middle(row, rows, longest, buckets), _ROWS), "pairs-and-stretches")
    long = frequent(middle, "frequent-phrases")
    last = middle.filter(F.col("kind") == _BLOCK).groupBy("block").cogroup(long.groupBy("block")).applyInArrow(
        lambda row, rows: _last(row, rows, longest, buckets), _ROWS)
    spelt = middle.filter(F.col("kind") == _PHRASES).unionByName(last).select("bucket", "lang", "words", "numbers")
    return stored(spelt.groupBy("bucket").applyInArrow(
        lambda rows: _added(rows, least), "lang string, phrase string, size int, f bigint"), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to ``longest`` words.

    A phrase's ``score`` is that of its lowest-scoring cut, ``a`` its occurrences, ``l`` and ``r`` those of the cut's
    parts, ``n`` the language's words. Only phrases with at least ``least`` occurrences count, and none whose words lie
    inside a longer one that occurs as often. A null text has no words, a null language is ``und``; repeated rows count
    again, and other columns are not read.
    """
    every, totals = phrases(docs, least, longest)
    words = F.split("phrase", " ")
    candidates = every.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    # A phrase inside one that is longer by two or more words and as frequent is inside one longer by one as well.
    inner = candidates.filter("size >= 3").select("lang", "a", F.explode(F.array(
        F.expr("array_join(slice(words, 1, size - 1), ' ')"), F.expr("array_join(slice(words, 2, size - 1), ' ')"))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"),
        F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    left = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # The product of three counts may pass 64 bits, the quotient does not.
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0)) * 1000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = scored.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return lowest.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL that counts every n-gram of every piece.
CHECKING_SQL = f"""
WITH piece AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM piece),
gram AS (
  SELECT lang, size, words[place : place + size - 1] AS words
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM split, range(1, {LONGEST + 1}) s(size))),
counted AS (SELECT lang, size, words, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang),
candidate AS (SELECT lang, size, words, f AS a FROM counted WHERE size >= 2),
covered AS (
  SELECT lang, words, max(a) AS longer
  FROM (SELECT lang, a, words[place : place + short - 1] AS words
        FROM (SELECT lang, a, words, short, unnest(range(1, size - short + 2)) AS place FROM candidate, range(2, {LONGEST}) t(short) WHERE short < size))
  GROUP BY ALL),
kept AS (SELECT c.* FROM candidate c LEFT JOIN covered v ON v.lang = c.lang AND v.words = c.words WHERE v.longer IS NULL OR v.longer < c.a),
cut AS (
  SELECT c.lang, c.words, c.a, k, l.f AS l, r.f AS r, n,
    ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) c
  JOIN counted l ON l.lang = c.lang AND l.words = c.words[1 : k]
  JOIN counted r ON r.lang = c.lang AND r.words = c.words[k + 1 :]
  JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' '))::BIGINT AS rank,
  array_to_string(words, ' ') AS phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {TOP}"""
