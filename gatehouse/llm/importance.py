"""Quality by importance resampling.

Two generative models over hashed n-grams, one of the target text (rows labelled good) and one of the raw text (all
rows), give every document the log ratio of its probabilities. Adding Gumbel noise and keeping the k highest values
draws k documents without replacement with these ratios as weights. The noise is a hash of the document, so reruns
agree, and the k-th value is found by counting, not by gathering.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gatehouse.llm.arrow_text import LOWER, TOKEN, WORD, Block, mix, span_hashes, text_blocks
from gatehouse.operators.ordered import running_number

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashed n-grams of both models together, added to each count, and labelled rows that the target model is fitted on.
BINS, PRIOR, TARGET_ROWS = 1 << 16, 1.0, 20_000

#: 0 blank, 1 word, 2 punctuation; a token is a run of one class.
_KIND = np.where(~TOKEN, 0, np.where(WORD, 1, 2)).astype(np.int8)


def gram_bins(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of every token and of every pair of neighbouring tokens of a block."""
    kind = _KIND[block.data]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[block.offsets] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] > 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[solid], ends[solid]
    hashes = span_hashes(LOWER[block.data], starts, ends)
    row = np.searchsorted(block.offsets, starts, "right") - 1
    pairs = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])
    both = row[:-1] == row[1:]
    return np.concatenate([row, row[:-1][both]]), (np.concatenate([hashes, pairs[both]]) >> np.uint64(48)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        good = np.isin(batch.column(0).fill_null(0).to_numpy(), wanted) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for block in text_blocks(batch.column(1)):
            row, bins = gram_bins(block)
            raw += np.bincount(bins, minlength=BINS)
            target += np.bincount(bins[good[block.first + row]], minlength=BINS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bin", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log of target over raw probability for every bin; zeros without labelled good rows.

    All rows count for the raw model. The target model is fitted on at most TARGET_ROWS rows labelled good, those of the
    smallest hashes of doc_id.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    wanted = np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).collect()], np.int64)
    if not len(wanted):
        return np.zeros(BINS)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        lambda batches: _counted(batches, sent.value), "bin bigint, raw bigint, target bigint")
    counts = np.zeros((2, BINS))
    for row in rows.groupBy("bin").agg(F.sum("raw"), F.sum("target")).collect():  # BINS rows at most
        counts[:, row[0]] = row[1:]
    share = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * BINS)
    return np.log(share[1]) - np.log(share[0])


def _weighted(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights, sizes = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
        for block in text_blocks(batch.column(2)):
            row, bins = gram_bins(block)
            own = slice(block.first, block.first + block.count)
            weights[own] = np.bincount(row, ratios[bins], block.count)
            sizes[own] = np.bincount(row, minlength=block.count)
        noise = mix(batch.column(1).to_numpy().astype(np.uint64))
        uniform = ((noise >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(sizes), pa.array(weights), pa.array(weights - np.log(-np.log(uniform)))],
            names=["doc_id", "noise", "n_grams", "log_weight", "gumbel_key"])


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, score, gumbel_key, rank, kept.

    The ``share`` of rows (by default the share of good rows among the labelled ones, all without labels) with the
    highest ``gumbel_key`` is kept. ``score`` is the logistic function of the mean log ratio, one half for a text that
    is as likely in either model. A null or empty text has weight 0. Rows that repeat doc_id and text have equal
    noise. Null labels are ignored; other columns are not read.
    """
    if share is None:
        known = labels.filter("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if known is None else known
    sent = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))
    weighted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("noise"),
        F.col("text").alias("text")).mapInArrow(
        lambda batches: _weighted(batches, sent.value),
        "doc_id bigint, noise bigint, n_grams bigint, log_weight double, gumbel_key double")
    ranked = running_number(weighted.withColumn("below", -F.col("gumbel_key")), [], ["below", "noise"], "rank")
    taken = round(share * docs.count())
    mean = F.col("log_weight") / F.greatest(F.col("n_grams"), F.lit(1))
    return ranked.select(
        "doc_id", "n_grams", "log_weight", (1 / (1 + F.exp(-mean))).alias("score"), "gumbel_key", "rank",
        (F.col("rank") <= taken).alias("kept"))
