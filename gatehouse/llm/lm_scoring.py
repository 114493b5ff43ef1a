"""Language-model scoring with a hierarchical Pitman-Yor model.

The model spells a text byte by byte, tokens parted by one blank and closed by an end mark. Every context of up to five
bytes is a restaurant whose parent is the context without its first byte; a restaurant's new tables are customers of
its parent. Table counts are sampled by Gibbs sweeps, and the predictive probabilities of the kept sweeps are averaged.

Documents are cut into segments. A segment sends its different grams (a byte with the five before it) once, with their
counts in training documents, to buckets by the last two bytes of the context. All contexts that end in the same two
bytes form a subtree; a bucket samples its subtrees from the counts of all segments, whatever the segments are. A bucket
that many segments ask is salted, and each part samples the same restaurants from the same counts and seed. The bucket
returns the averaged probability of every gram that a segment asked for. Only the restaurants of single bytes are shared:
they are sampled first, in a model of contexts of up to two bytes, and their 256 x 256 probabilities are sent to all tasks.

Counts of whole tokens, for the base score, are exact over the whole corpus: a segment sends its different tokens once,
buckets of tokens add them up and answer every segment that asked.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from gatehouse.llm.arrow_text import LOWER, TOKEN, Block, mix, span_hashes, text_blocks, tokens
from gatehouse.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Longest context in bytes; discount and strength by context length 1 to ORDER.
ORDER = 5
DISCOUNTS, STRENGTHS = (0.4, 0.5, 0.6, 0.7, 0.75), (1.0, 1.0, 0.5, 0.5, 0.5)
SWEEPS, BURN_IN = 6, 3
#: Bytes of the context that make a subtree, and those of the model that is sampled for the levels above it.
SUFFIX = 2
SEGMENT_BYTES, BUCKET_TOKENS, BLOCK_BYTES = 8 << 20, 2_000_000, 1 << 17
#: Buckets of subtrees, and segments that one part of a bucket answers.
BUCKETS, TOGETHER = 128, 512
BLANK, END = 0x20, 0x0A

#: One row per segment: numbers as the bytes of an array, ``named`` and ``held`` as one byte per text, texts compressed.
_SEGMENT = (
    "seg bigint, doc_ids binary, named binary, held binary, text binary, offsets binary, vocabulary binary, counts binary,"
    "n_train bigint"
)


def held_out():
    """Whether crc32 of the doc_id as text has no remainder by 10; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def spelled(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): each text as ORDER end marks, its lower-cased tokens each followed by a blank, and an end mark;
    text i is bytes ``bounds[i]`` to ``bounds[i + 1]``."""
    found = tokens(block, TOKEN)
    lengths = found.ends - found.starts
    per_text = np.diff(found.bounds)
    text_of = np.repeat(np.arange(block.count), per_text)
    sizes = np.bincount(text_of, lengths + 1, block.count).astype(np.int64) + ORDER + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], END, np.uint8)
    before = np.cumsum(lengths) - lengths + np.arange(len(lengths)) + text_of * (ORDER + 1) + ORDER
    kept = np.arange(int(lengths.sum())) + np.repeat(before - (np.cumsum(lengths) - lengths), lengths)
    out[kept] = LOWER[block.data[TOKEN[block.data]]]
    out[before + lengths] = BLANK
    return out, bounds


def grams(data: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes up to each place from ORDER on, as one number."""
    out = np.zeros(max(0, len(data) - ORDER), np.uint64)
    for i in range(ORDER + 1):
        out = (out << np.uint64(8)) | data[i : len(data) - ORDER + i]
    return out


def _inside(bounds: np.ndarray) -> np.ndarray:
    """Whether the place of each gram belongs to a text and not to its leading marks."""
    out = np.ones(max(0, int(bounds[-1]) - ORDER), bool)
    for i in range(ORDER):
        lead = bounds[:-1] + i - ORDER
        out[lead[lead >= 0]] = False
    return out


def segments(docs: DataFrame) -> DataFrame:
    """Write the documents as segments of whole texts to the shared scratch folder: texts, different tokens and their
    counts in training documents. Every row is in exactly one segment."""
    path = scratch_path(docs.sparkSession, "segments")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held"), F.col("text").alias("text"))
    rows.mapInArrow(_segments, _SEGMENT).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for block in text_blocks(batch.column(2)):
            rows = batch.slice(block.first, block.count)
            named = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            held.append((block, rows.column(0).fill_null(0).to_numpy(), named, np.array(rows.column(1).to_pylist(), bool)))
            size += len(block.data) + 64 * block.count
            if size >= SEGMENT_BYTES:
                yield _segment((part << 24) + number, held)
                held, size, number = [], 0, number + 1
    if held:
        yield _segment((part << 24) + number, held)


def _segment(seg: int, held: list[tuple]) -> pa.RecordBatch:
    vocabularies, counts = [], []
    for block, _, _, out in held:
        hashes, bounds = token_hashes(block)
        training = np.repeat(~out, np.diff(bounds))
        different, number = np.unique(hashes, return_inverse=True)
        vocabularies.append(different)
        counts.append(np.bincount(number, training, len(different)).astype(np.int64))
    vocabulary, number = np.unique(np.concatenate(vocabularies), return_inverse=True)
    total = np.bincount(number, np.concatenate(counts), len(vocabulary)).astype(np.int64)
    offsets, at = [np.zeros(1, np.int64)], 0
    for block, *_ in held:
        offsets.append(block.offsets[1:] + at)
        at += len(block.data)
    ids, named, out = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    texts = pa.compress(np.concatenate([x[0].data for x in held]).tobytes(), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([
        pa.array([seg]), blob(ids), blob(named), blob(out),
        pa.array([texts], pa.binary()), blob(np.concatenate(offsets)), blob(vocabulary), blob(total),
        pa.array([int((~out).sum())])],
        names=[x.split()[0] for x in _SEGMENT.split(",")])


def token_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    found = tokens(block, TOKEN)
    return span_hashes(LOWER[block.data], found.starts, found.ends), found.bounds


def _texts(text, offsets) -> Iterator[Block]:
    """The texts of a segment, a block at a time."""
    bounds = np.frombuffer(offsets, np.int64)
    data = np.frombuffer(pa.decompress(text, int(bounds[-1]), "zstd"), np.uint8)
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, "right")) - 1)
        yield Block(first, last - first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def token_answers(parts: DataFrame) -> DataFrame:
    """(seg, bucket, totals, n, v): the corpus counts of each segment's tokens, and each bucket's sum and number of
    training tokens, in its first row; written to the shared scratch folder."""
    spark = parts.sparkSession
    entries = parts.agg(F.sum(F.length("vocabulary") / 8)).first()[0] or 0
    buckets = max(1, int(entries) // BUCKET_TOKENS)
    asked = parts.select("seg", "vocabulary", "counts").mapInArrow(
        lambda batches: _asked(batches, buckets), "bucket int, seg bigint, vocabulary binary, counts binary")
    path = scratch_path(spark, "token-counts")
    asked.groupBy("bucket").applyInPandas(_answered, "seg bigint, bucket int, totals binary, n bigint, v bigint").write.parquet(path)
    return spark.read.parquet(path)


def _cuts(vocabulary: np.ndarray, buckets: int) -> np.ndarray:
    edges = [np.uint64((i << 64) // buckets) for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(vocabulary, np.array(edges, np.uint64)), [len(vocabulary)]])


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seg, vocabulary, counts in zip(*batch.columns, strict=True):
            words, numbers = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((vocabulary, np.uint64), (counts, np.int64)))
            cuts = _cuts(words, buckets)
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([seg.as_py()] * len(some), pa.int64()),
                *(pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()) for x in (words, numbers))],
                names=["bucket", "seg", "vocabulary", "counts"])


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    words = [np.frombuffer(x, np.uint64) for x in rows["vocabulary"]]
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
    different, number = np.unique(np.concatenate(words), return_inverse=True)
    totals = np.zeros(len(different), np.int64)
    np.add.at(totals, number, counts)
    own = np.split(totals[number], np.cumsum([len(x) for x in words])[:-1])
    first = np.arange(len(rows)) == 0
    return pd.DataFrame({
        "seg": rows["seg"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "totals": [x.tobytes() for x in own],
        "n": np.where(first, totals.sum(), 0), "v": np.where(first, (totals > 0).sum(), 0)})


def bucket_of(codes: np.ndarray) -> np.ndarray:
    """The bucket of each gram, by the last bytes of its context."""
    suffix = (codes >> np.uint64(8)) & np.uint64((1 << (8 * SUFFIX)) - 1)
    return (mix(suffix) % np.uint64(BUCKETS)).astype(np.int64)


def _packed(codes: np.ndarray) -> bytes:
    """Sorted codes as the bytes of their differences, in planes."""
    planes = np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _numbers(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.int64).tobytes(), 1)


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.int64)


def segment_grams(parts: DataFrame) -> DataFrame:
    """(bucket, salt, seg, codes, counts): the different grams of each segment with their counts in training documents,
    written to the shared scratch folder."""
    salts = max(1, -(-parts.count() // TOGETHER))
    found = parts.select("seg", "text", "offsets", "held").mapInArrow(_grams_asked, "bucket int, seg bigint, codes binary, counts binary")
    path = scratch_path(parts.sparkSession, "segment-grams")
    found.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(salts))).write.parquet(path)
    return parts.sparkSession.read.parquet(path)


def _grams_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seg, text, offsets, held in zip(*batch.columns, strict=True):
            out = np.frombuffer(held.as_buffer(), bool)
            merged, waiting = (np.empty(0, np.uint64), np.empty(0, np.int64)), []
            for block in _texts(text.as_buffer(), offsets.as_buffer()):
                data, bounds = spelled(block)
                own = _inside(bounds)
                training = np.repeat(~out[block.first : block.first + block.count], np.diff(bounds))[ORDER:][own]
                codes, number = np.unique(grams(data)[own], return_inverse=True)
                waiting.append((codes, np.bincount(number, training, len(codes)).astype(np.int64)))
                if sum(len(x[0]) for x in waiting) > len(merged[0]) + 500_000:
                    merged, waiting = _added([merged, *waiting]), []
            codes, counts = _added([merged, *waiting])
            bucket = bucket_of(codes)
            order = np.argsort(bucket, kind="stable")
            some, first = np.unique(bucket[order], return_index=True)
            cut = np.split(order, first[1:]) if len(order) else []
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([seg.as_py()] * len(some), pa.int64()),
                pa.array([_packed(codes[part]) for part in cut], pa.binary()),
                pa.array([_numbers(counts[part]) for part in cut], pa.binary())], names=["bucket", "seg", "codes", "counts"])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of all parts, each with the sum of its counts."""
    codes = np.concatenate([x[0] for x in parts])
    counts = np.concatenate([x[1] for x in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _added([(_unpacked(c.as_py()), _counts(n.as_py())) for c, n in zip(rows.column("codes"), rows.column("counts"), strict=True)])


def corpus_grams(asked: DataFrame) -> DataFrame:
    """(bucket, codes, counts): the grams of all training documents, one row a bucket. Each part of a bucket adds up its
    segments first."""

    def added(rows: pa.Table) -> pa.Table:
        codes, counts = _summed(rows)
        some = counts > 0
        return pa.table({"bucket": rows.column("bucket")[:1], "codes": pa.array([_packed(codes[some])], pa.binary()),
                         "counts": pa.array([_numbers(counts[some])], pa.binary())})

    schema = "bucket int, codes binary, counts binary"
    path = scratch_path(asked.sparkSession, "corpus-grams")
    asked.groupBy("bucket", "salt").applyInArrow(added, schema).groupBy("bucket").applyInArrow(added, schema).write.parquet(path)
    return asked.sparkSession.read.parquet(path)


def shared_levels(grams_: DataFrame) -> np.ndarray:
    """Probability of each byte after each single byte, sampled in a model of contexts of up to SUFFIX bytes; at most
    256 x 256 numbers come to the driver."""
    spark, path = grams_.sparkSession, scratch_path(grams_.sparkSession, "short-grams")
    grams_.mapInArrow(_shortened, "last int, code bigint, n bigint").groupBy("last", "code").agg(F.sum("n").alias("n")).write.parquet(path)
    short = spark.read.parquet(path)
    bytes_ = np.zeros(256)
    for at, n in short.groupBy(F.col("code").bitwiseAND(F.lit(255))).agg(F.sum("n")).collect():
        bytes_[at] = n
    root = (bytes_ + 1) / (bytes_.sum() + 256)

    def sampled(rows: pa.Table) -> pa.Table:
        codes, counts = _added([(rows.column("code").to_numpy().view(np.uint64), rows.column("n").to_numpy())])
        last = rows.column("last")[0].as_py()
        levels = subtree(codes, counts, lambda own: root[own & np.uint64(255)], last, range(1, SUFFIX + 1))
        every = np.arange(256, dtype=np.uint64) | np.uint64(last << 8)
        return pa.table({"last": pa.array([last], pa.int32()), "p": pa.array([averaged(levels[:1], every, root[every & np.uint64(255)]).tolist()])})

    first = np.tile(root, (256, 1))
    for last, p in short.groupBy("last").applyInArrow(sampled, "last int, p array<double>").collect():
        first[last] = p
    return first


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, counts in zip(batch.column("codes"), batch.column("counts"), strict=True):
            own = _unpacked(codes.as_py()) & np.uint64((1 << (8 * (SUFFIX + 1))) - 1)
            own, n = _added([(own, _counts(counts.as_py()))])
            last = ((own >> np.uint64(8)) & np.uint64(255)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(last), pa.array(own.view(np.int64)), pa.array(n)], names=["last", "code", "n"])


def seat(counts: np.ndarray, start: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of each dish after seating its customers one by one: the first opens a table, customer j + 1 a further one
    with weight ``start`` (strength and discounted tables of the restaurant times the parent's probability) against
    j less the discounted tables of the dish. Beyond the first sixteen, customers come in groups of an eighth."""
    tables = np.ones(len(counts), np.int64)
    open_, seated = np.flatnonzero(counts > 1), 1
    while len(open_):
        group = 1 if seated < 16 else seated // 8
        more = np.minimum(group, counts[open_] - seated)
        new = start[open_] / (start[open_] + seated - discount * tables[open_])
        tables[open_] += random.binomial(more, np.clip(new, 0, 1))
        seated += group
        open_ = open_[counts[open_] > seated]
    return tables


class Level(NamedTuple):
    """Restaurants of one context length: grams and contexts, and, for each kept sweep, a gram's own part of its
    probability and a context's weight of its parent."""

    length: int
    grams: np.ndarray
    contexts: np.ndarray
    own: np.ndarray
    back: np.ndarray


def subtree(
    codes: np.ndarray, counts: np.ndarray, above_first: Callable[[np.ndarray], np.ndarray], seed: int, lengths: range
) -> list[Level]:
    """Sampled restaurants of the given context ``lengths``, from the different grams of the longest one and their counts;
    ``above_first`` gives the parents' probability of the shortest one's grams. The seed alone fixes the sample."""
    random = np.random.default_rng(seed)
    levels = []  # per context length: grams, number of the parent's gram, contexts, number of the context
    for length in reversed(lengths):
        houses, house = np.unique(codes >> np.uint64(8), return_inverse=True)
        shorter, parent = np.unique(codes & np.uint64((1 << (8 * length)) - 1), return_inverse=True)
        levels.append((codes, parent, houses, house))
        codes = shorter if length > lengths[0] else codes
    levels.reverse()
    first = above_first(levels[0][0])
    tables = [np.ones(len(level[0]), np.int64) for level in levels]
    own, back = [[] for _ in levels], [[] for _ in levels]
    for sweep in range(SWEEPS):
        customers = _customers(levels, tables, counts)
        probability, chances = None, []
        for k, (_, parent, houses, house) in enumerate(levels):
            discount, strength = DISCOUNTS[lengths[k] - 1], STRENGTHS[lengths[k] - 1]
            seats, open_ = (np.bincount(house, x, len(houses)) for x in (customers[k], tables[k]))
            weight = strength + discount * open_
            share, rest = (customers[k] - discount * tables[k]) / (strength + seats)[house], weight / (strength + seats)
            above = first if k == 0 else probability[parent]
            probability = share + rest[house] * above
            chances.append((above, weight))
            if sweep >= BURN_IN:
                own[k].append(share)
                back[k].append(rest)
        for k in range(len(levels) - 1, -1, -1):
            above, weight = chances[k]
            tables[k] = seat(_customers(levels, tables, counts)[k], weight[levels[k][3]] * above, DISCOUNTS[lengths[k] - 1], random)
    return [Level(lengths[k], level[0], level[2], np.array(own[k]), np.array(back[k])) for k, level in enumerate(levels)]


def _customers(levels: list[tuple], tables: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """Customers of each level's dishes: the tables of the longer contexts, and at the longest the counts."""
    inner = [np.bincount(levels[k + 1][1], tables[k + 1], len(levels[k][0])).astype(np.int64) for k in range(len(levels) - 1)]
    return [*inner, counts]


def averaged(levels: list[Level], codes: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Predictive probability of each gram, averaged over the kept sweeps; ``above`` is that of the shared levels."""
    probability = np.tile(above, (SWEEPS - BURN_IN, 1))
    for level in levels:
        gram = codes & np.uint64((1 << (8 * (level.length + 1))) - 1)
        house, seated = _place(level.contexts, gram >> np.uint64(8))
        dish, known = _place(level.grams, gram)
        probability = np.where(known, level.own[:, dish], 0) + np.where(seated, level.back[:, house], 1) * probability
    return probability.mean(axis=0)


def _place(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def bucket_probabilities(asked: np.ndarray, codes: np.ndarray, counts: np.ndarray, shared: np.ndarray, seed: int) -> np.ndarray:
    """Probability of each of the ``asked`` grams of a bucket, from its training grams and their counts."""
    def above(own: np.ndarray) -> np.ndarray:
        return shared[(own >> np.uint64(8)) & np.uint64(255), own & np.uint64(255)]

    levels = subtree(codes, counts, above, seed, range(SUFFIX, ORDER + 1)) if len(codes) else []
    # A bounded number at a time: each gram has a probability for each sweep.
    parts = np.split(asked, range(100_000, len(asked), 100_000))
    return np.concatenate([averaged(levels, part, above(part)) for part in parts])


def gram_answers(asked: DataFrame, grams_: DataFrame, shared: np.ndarray) -> DataFrame:
    """(seg, bucket, codes, logs): log10 probability of every gram that a segment asked for."""
    last = asked.agg(F.max("salt")).first()[0] or 0
    copies = grams_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))

    def answered(rows: pa.Table, corpus: pa.Table) -> pa.Table:
        own = [_unpacked(x.as_py()) for x in rows.column("codes")]
        known = _summed(corpus) if corpus.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        different, number = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_inverse=True)
        seed = int(bucket_of(different[:1])[0]) if len(different) else 0
        logs = np.log10(bucket_probabilities(different, *known, shared, seed))[number]
        parts = np.split(logs, np.cumsum([len(x) for x in own])[:-1])
        return pa.table({"seg": rows.column("seg"), "bucket": rows.column("bucket"), "codes": rows.column("codes"),
                         "logs": pa.array([x.astype(np.float32).tobytes() for x in parts[: len(own)]], pa.binary())})

    return asked.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(
        answered, "seg bigint, bucket int, codes binary, logs binary")


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training rows are those that are not held out; all rows are scored. A null or empty text has the end only, which
    counts as a token. Rows with a null doc_id are held out; repeated rows count as often as they occur. Without
    training rows the base score is 0 and the model spells every byte alike. Other columns are not read.
    """
    parts = segments(docs)
    answers = token_answers(parts)
    totals = answers.agg(F.sum("n"), F.sum("v")).first()
    ends = parts.agg(F.sum("n_train")).first()[0] or 0
    train_tokens, different = (totals[0] or 0) + ends, (totals[1] or 0) + (1 if ends else 0)
    asked = segment_grams(parts)
    corpus = corpus_grams(asked)
    spelt = gram_answers(asked, corpus, shared_levels(corpus))
    nothing = F.lit(None).cast("binary")
    every = answers.select("seg", "bucket", "totals", nothing.alias("codes"), nothing.alias("logs")).unionByName(
        spelt.select("seg", "bucket", nothing.alias("totals"), "codes", "logs"))
    return parts.select("seg", "doc_ids", "named", "held", "text", "offsets").groupBy("seg").cogroup(every.groupBy("seg")).applyInPandas(
        _scorer(ends, train_tokens, different),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _scorer(ends: int, train_tokens: int, different: int):
    def scored(parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        of_tokens, of_grams = answers[answers["totals"].notna()], answers[answers["codes"].notna()]
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in of_tokens.sort_values("bucket")["totals"])])
        codes = np.concatenate([np.empty(0, np.uint64), *(_unpacked(x) for x in of_grams["codes"])])
        logs = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x, np.float32) for x in of_grams["logs"])])
        order = np.argsort(codes)
        out = []
        for row in parts.itertuples():
            found = _base_scores(row, counts, ends, train_tokens, different)
            found["score"] = _model_scores(row, codes[order], logs[order].astype(float))
            out.append(found)
        return pd.concat(out)

    return scored


def _base_scores(row, counts: np.ndarray, ends: int, train_tokens: int, different: int) -> pd.DataFrame:
    value = np.log10((counts + 0.1) / (train_tokens + 0.1 * (different + 1)))
    end = np.log10((ends + 0.1) / (train_tokens + 0.1 * (different + 1)))
    found = [token_hashes(block) for block in _texts(row.text, row.offsets)]
    # The answers are in the order of the segment's different tokens.
    number = np.unique(np.concatenate([hashes for hashes, _ in found]), return_inverse=True)[1]
    per_text = np.concatenate([np.diff(bounds) for _, bounds in found])
    text = np.repeat(np.arange(len(per_text)), per_text)
    n_known = np.bincount(text, counts[number] > 0, len(per_text)).astype(np.int64) + (ends > 0)
    base = np.bincount(text, value[number], len(per_text)) + end
    named = np.frombuffer(row.named, bool)
    return pd.DataFrame({
        "doc_id": pd.arrays.IntegerArray(np.frombuffer(row.doc_ids, np.int64).copy(), ~named),
        "held_out": np.frombuffer(row.held, bool), "n_tokens": per_text + 1, "n_known": n_known,
        "train_tokens": train_tokens, "base_score": base})


def _model_scores(row, codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a segment, from those of its different grams."""
    out = np.zeros(len(row.held))
    for block in _texts(row.text, row.offsets):
        data, bounds = spelled(block)
        own = _inside(bounds)
        text = np.repeat(np.arange(block.count), np.diff(bounds))[ORDER:][own]
        # Sorted grams find their places one near the other.
        wanted = grams(data)[own]
        order = np.argsort(wanted)
        out[block.first : block.first + block.count] = np.bincount(text[order], logs[np.searchsorted(codes, wanted[order])], block.count)
    return out


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, base_perplexity, perplexity) per token, of the held-out and of the training rows."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), per_token("base_score").alias("base_perplexity"), per_token("score").alias("perplexity"))
