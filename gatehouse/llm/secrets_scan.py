"""Secrets by a character convolutional network.

Candidates of every whole text are found by byte runs in numpy and three base patterns; each candidate, with the
characters around it, is scored by a small convolutional network. The network is trained in numpy, on all findings of the
base patterns (labelled secret) and all long tokens that no pattern takes (labelled not): Spark deals three quarters of
them into parts, each part is trained on by itself for an epoch, and the weights are averaged before the next. Scores are
calibrated, and the threshold keeps a stated recall, on the held-out quarter, counted by bins of the score. Base findings
always stay; the network adds spans of kind ``cnn``.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gatehouse.llm.arrow_text import text_blocks, tokens
from gatehouse.llm.rows import scratch_tables, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "cnn")

# The base patterns and the shortest match that counts.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ASSIGN_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: A generic candidate is a run of at least this many key characters with a digit and a letter.
TOKEN_LEAST = 16
#: Characters of context on each side, and characters of the candidate, that the network sees; a longer candidate is
#: seen as overlapping pieces, and its score is that of its highest piece.
CONTEXT, BODY = 24, 48
WIDTH = 2 * CONTEXT + BODY
FILTERS, KERNEL, ALPHABET = 24, 5, 40

_CODES = np.arange(256)
_HEX = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x66))
_DIGIT = (_CODES >= 0x30) & (_CODES <= 0x39)
_LETTER = ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
_KEY = _DIGIT | _LETTER | np.isin(_CODES, [ord(c) for c in "+/_=-"])
_LOWERED = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _classes() -> np.ndarray:
    """Character classes of the network: 0 padding, 1 to 26 letters, 27 digits, 28 beyond ASCII, then punctuation."""
    out = np.full(256, 29, np.uint8)
    out[_DIGIT] = 27
    out[0x80:] = 28
    for i in range(26):
        out[0x41 + i] = out[0x61 + i] = i + 1
    for i, c in enumerate("=:\"' \n_-/+"):
        out[ord(c)] = 30 + i
    return out


_CLASS = _classes()


class Network(NamedTuple):
    """Weights, calibration (slope and shift of the log-odds) and threshold of the calibrated probability."""

    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: float
    slope: float
    offset: float
    threshold: float


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int


def byte_candidates(text: bytes, hex_runs: list[tuple[int, int]], key_runs: list[tuple[int, int]]) -> list[Candidate]:
    """Base findings and generic candidates of one text, as byte spans; generic ones do not touch base findings."""
    found = [Candidate("hex", start, end) for start, end in hex_runs]
    if b"AKIA" in text:
        found += [Candidate("access", *m.span()) for m in _ACCESS.finditer(text.decode("latin-1"))
                  if m.end() - m.start() >= ACCESS_LEAST]
    lowered = text.translate(_LOWERED)
    if any(cue in lowered for cue in _ASSIGN_CUES):
        found += [Candidate("assign", *m.span()) for m in _ASSIGN.finditer(text.decode("latin-1"))
                  if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    taken = sorted((c.start, c.end) for c in found)
    starts, reach = [x[0] for x in taken], list(accumulate((x[1] for x in taken), max))
    generic = []
    for start, end in key_runs:
        before = bisect_left(starts, end)
        if not before or reach[before - 1] <= start:
            generic.append(Candidate("cnn", start, end))
    return found + generic


def block_candidates(column: pa.Array) -> Iterator[tuple[int, bytes, list[Candidate]]]:
    """(row, text, candidates) of every text of a column that has candidates."""
    for block in text_blocks(column):
        runs = {}
        for name, member, least in (("hex", _HEX, HEX_LEAST), ("key", _KEY, TOKEN_LEAST)):
            found = tokens(block, member)
            long = np.flatnonzero(found.ends - found.starts >= least)
            starts, ends = found.starts[long], found.ends[long]
            if name == "key" and len(starts):
                digits = np.concatenate([[0], np.cumsum(_DIGIT[block.data])])
                letters = np.concatenate([[0], np.cumsum(_LETTER[block.data])])
                mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
                starts, ends = starts[mixed], ends[mixed]
            row = np.searchsorted(block.offsets, starts, "right") - 1
            runs[name] = (row, starts - block.offsets[row], ends - block.offsets[row])
        data = block.data.tobytes()
        lowered = data.translate(_LOWERED)
        rows = set(runs["hex"][0].tolist()) | set(runs["key"][0].tolist())
        for cue, where in [*((c, lowered) for c in _ASSIGN_CUES), (b"AKIA", data)]:
            at = where.find(cue)
            while at >= 0:
                row = int(np.searchsorted(block.offsets, at, "right")) - 1
                rows.add(row)
                at = where.find(cue, int(block.offsets[row + 1]))
        for row in sorted(rows):
            text = data[block.offsets[row] : block.offsets[row + 1]]
            own = []
            for where, starts, ends in (runs["hex"], runs["key"]):
                low, high = np.searchsorted(where, [row, row + 1])
                own.append(list(zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)))
            found = byte_candidates(text, *own)
            if found:
                yield block.first + row, text, found


def pieces(text: bytes, candidate: Candidate) -> np.ndarray:
    """The candidate with its context as rows of character classes; a long one gives several rows."""
    first = max(0, candidate.start - CONTEXT)
    codes = _CLASS[np.frombuffer(text[first : candidate.end + CONTEXT], np.uint8)]
    out = []
    start, last = candidate.start - first, candidate.end - first
    for at in range(start, max(last - BODY // 2, start + 1), BODY // 2):
        row = np.zeros(WIDTH, np.uint8)
        left, right = codes[max(0, at - CONTEXT) : at], codes[at : min(last, at + BODY) + CONTEXT]
        row[CONTEXT - len(left) : CONTEXT] = left
        row[CONTEXT : CONTEXT + len(right)] = right
        out.append(row)
    return np.stack(out)


def _windows(rows: np.ndarray) -> np.ndarray:
    """Class numbers of each window, offset by their place in it, to look up filter weights."""
    return np.lib.stride_tricks.sliding_window_view(rows, KERNEL, axis=1).astype(np.int64) + np.arange(KERNEL) * ALPHABET


def logits(network: Network, rows: np.ndarray) -> np.ndarray:
    """Uncalibrated log-odds: one-hot convolution, rectified, greatest value over places, then a linear layer."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), 128):
        part = network.filters[_windows(rows[at : at + 128])].sum(axis=2) + network.bias
        out[at : at + 128] = np.maximum(part, 0).max(axis=1) @ network.dense + network.shift
    return out


def _probability(network: Network, score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(network.slope * score + network.offset, -40, 40)))


def probability(network: Network, rows: np.ndarray) -> np.ndarray:
    return _probability(network, logits(network, rows))


#: Numbers of the network: filters, bias, dense layer and shift, in this order in one vector.
_PLACES = np.cumsum([0, KERNEL * ALPHABET * FILTERS, FILTERS, FILTERS, 1])


def _unpacked(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    filters, bias, dense, shift = np.split(weights, _PLACES[1:-1])
    return filters.reshape(-1, FILTERS), bias, dense, float(shift[0])


def _started(random: np.random.Generator) -> np.ndarray:
    """Weights, and Adam's first and second moments of each."""
    state = np.zeros((3, _PLACES[-1]))
    state[0, : _PLACES[1]] = random.normal(0, 0.1, _PLACES[1])
    state[0, _PLACES[2] : _PLACES[3]] = random.normal(0, 0.3, FILTERS)
    return state


def _epoch(state: np.ndarray, number: int, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """The state after epoch ``number`` over the rows, 64 at a time."""
    order, state = np.random.default_rng([seed, number]).permutation(len(rows)), state.copy()
    for step, at in enumerate(range(0, len(rows), 64), number * -(-len(rows) // 64) + 1):
        pick = order[at : at + 64]
        filters, bias, dense, shift = _unpacked(state[0])
        windows = _windows(rows[pick])
        value = np.maximum(filters[windows].sum(axis=2) + bias, 0)
        where = value.argmax(axis=1)
        top = np.take_along_axis(value, where[:, None, :], 1)[:, 0]
        error = (1 / (1 + np.exp(-np.clip(top @ dense + shift, -40, 40))) - labels[pick]) * weight[pick] / len(pick)
        through = error[:, None] * dense * (top > 0)
        gradient = np.zeros_like(filters)
        seen = windows[np.arange(len(pick))[:, None], where]
        np.add.at(gradient, (seen, np.arange(FILTERS)[None, :, None]), through[:, :, None])
        change = np.concatenate([gradient.ravel(), through.sum(0), top.T @ error, [error.sum()]])
        state[1] += 0.1 * (change - state[1])
        state[2] += 0.001 * (change * change - state[2])
        state[0] -= 0.01 * (state[1] / (1 - 0.9**step)) / (np.sqrt(state[2] / (1 - 0.999**step)) + 1e-8)
    return state


def _calibrated(network: Network, bins: list[tuple[bool, int, float, float]], recall: float) -> Network:
    """Calibrate on (secret, bin, number, least score) of held-out rows, and take the least score of the bin with which
    the share ``recall`` of the secret ones is reached, the highest first."""
    label, score, number = (np.array([b[i] for b in bins], float) for i in (0, 1, 2))
    score, number, slope, offset = score / BINS, number / number.sum(), 1.0, 0.0
    for _ in range(200):
        error = (1 / (1 + np.exp(-np.clip(slope * score + offset, -40, 40))) - label) * number
        slope, offset = slope - 0.05 * float((error * score).sum()), offset - 0.05 * float(error.sum())
    network = network._replace(slope=max(slope, 1e-3), offset=offset)
    lost, secret = 0.0, sorted(b[1:] for b in bins if b[0])
    spare = int(np.floor((1 - recall) * sum(n for _, n, _ in secret)))
    for _, n, least in secret:
        lost += n
        if lost > spare:
            # A little less, as sums of other rows at a time may differ in their last bit.
            return network._replace(threshold=float(_probability(network, np.array(least - 1e-9))))
    raise ValueError("no held-out finding")


def fit(rows: np.ndarray, labels: np.ndarray, recall: float = 0.98, epochs: int = 12, seed: int = 7) -> Network:
    """Train on three quarters of the rows, calibrate and set the threshold on the rest; the same rows give the same
    network. With rows of one class only, nothing can be learned and the threshold lets nothing through."""
    random = np.random.default_rng(seed)
    state = _started(random)
    if len(set(labels.tolist())) < 2:
        return _nothing(state)
    order = random.permutation(len(rows))
    held, own = order[: len(rows) // 4], order[len(rows) // 4 :]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for number in range(epochs):
        state = _epoch(state, number, rows[own], labels[own], weight[own], seed)
    network = Network(*_unpacked(state[0]), 1.0, 0.0, 0.5)
    if not len(held) or len(set(labels[held].tolist())) < 2:
        held = order
    score = logits(network, rows[held])
    return _calibrated(network, [(bool(y), int(np.floor(x * BINS)), 1.0, x) for x, y in zip(score, labels[held], strict=True)], recall)


def _nothing(state: np.ndarray) -> Network:
    return Network(*_unpacked(state[0]), 1.0, 0.0, 2.0)


#: Bins of held-out scores to a unit of log-odds.
BINS = 64


def labelled(docs: DataFrame) -> DataFrame:
    """Every finding (secret) and generic candidate (not) as joined network rows, equal ones once with their number; a
    quarter, by hash, is held out."""
    found = docs.select(F.col("text").alias("text")).mapInArrow(_examples, "secret boolean, pieces binary")
    return found.groupBy("secret", "pieces").agg(F.count("*").alias("copies")).withColumn(
        "order", F.xxhash64("pieces", "secret")).withColumn("held", F.pmod("order", F.lit(4)) == 0)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        secret, rows = [], []
        for _, text, found in block_candidates(batch.column(0)):
            for candidate in found:
                secret.append(candidate.kind != "cnn")
                rows.append(pieces(text, candidate).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(secret, pa.bool_()), pa.array(rows, pa.binary())], names=["secret", "pieces"])


def plain_tokens(rows: np.ndarray, seed: int = 11) -> np.ndarray:
    """Negative examples made from findings: the candidate's characters replaced by a slice of text-like letters."""
    random = np.random.default_rng(seed)
    out = rows.copy()
    letters = np.array([5, 20, 1, 15, 9, 14, 19, 8, 18, 4, 12, 21, 30 + 6, 30 + 7], np.uint8)
    for row in out:
        body = row[CONTEXT : CONTEXT + BODY]
        row[: CONTEXT] = np.where(row[:CONTEXT] == 30, 34, row[:CONTEXT])
        size = int(random.integers(TOKEN_LEAST, BODY))
        body[:size] = random.choice(letters, size)
        body[int(random.integers(1, size))] = 27
    return out


def _unfolded(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, labels, number): network rows of a part's examples and of tokens made from its findings, where each
    example begins, and its label and number; in the same order on every run."""
    part = part.sort_by([("order", "ascending"), ("pieces", "ascending")])
    rows = np.frombuffer(b"".join(part["pieces"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    sizes = np.array([len(x) // WIDTH for x in part["pieces"].to_pylist()], np.int64)
    secret, copies = (part[name].to_numpy(zero_copy_only=False) for name in ("secret", "copies"))
    first = np.cumsum(sizes) - sizes
    made = plain_tokens(rows[first[secret]])
    return (np.concatenate([rows, made]), np.concatenate([first, len(rows) + np.arange(len(made))]),
            np.concatenate([secret.astype(float), np.zeros(len(made))]), np.concatenate([copies, copies[secret]]).astype(float))


def _trained(part: pa.Table, state: np.ndarray, number: int, scale: tuple[float, float]) -> pa.Table:
    """Every number of the state after an epoch on the part, times the part's rows. All rows of an example together, and
    both classes, weigh alike."""
    rows, first, labels, copies = _unfolded(part)
    sizes = np.diff(np.append(first, len(rows)))
    weight = np.repeat(copies / sizes * np.where(labels == 1, scale[1], scale[0]), sizes)
    after = _epoch(state, number, rows, np.repeat(labels, sizes), weight, 7).ravel()
    return pa.table({"place": pa.array(np.arange(len(after)), pa.int32()), "value": after * len(rows), "n": np.full(len(after), len(rows))})


def _scored(part: pa.Table, network: Network) -> pa.Table:
    """Every example's label, number and highest score."""
    rows, first, labels, copies = _unfolded(part)
    return pa.table({"secret": labels == 1, "n": copies, "score": np.maximum.reduceat(logits(network, rows), first)})


def train(docs: DataFrame, limit: int = 4000, recall: float = 0.98, epochs: int = 12) -> Network:
    """Fit the network on all findings and generic candidates of ``docs``, in parts of about ``limit`` different ones."""
    spark, state = docs.sparkSession, _started(np.random.default_rng(7))
    with scratch_tables(spark, "training"):
        found = stored(labelled(docs), "examples")
        size = F.length("pieces") / WIDTH
        made = F.when(F.col("secret"), 1).otherwise(0)
        sums = found.groupBy("held", "secret").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"),
                                                   F.sum(size + made).alias("rows")).collect()
        if not any(r.secret for r in sums):
            return _nothing(state)
        parts = -(-sum(r.n for r in sums) // limit)
        dealt = found.withColumn("part", F.pmod(F.xxhash64("order"), F.lit(parts)))
        # With findings in one fold only, all examples are in both.
        both = len({r.held for r in sums if r.secret}) == 2
        own, held = (dealt.filter(~F.col("held")), dealt.filter("held")) if both else (dealt, dealt)
        used = [r for r in sums if not (both and r.held)]
        secret, rows = sum(r.copies for r in used if r.secret), sum(r.rows for r in used)
        # Tokens made from findings are not secret.
        scale = 0.5 * rows / (secret + sum(r.copies for r in used if not r.secret)), 0.5 * rows / secret
        for number in range(epochs):
            after = own.groupBy("part").applyInArrow(
                lambda part: _trained(part, state, number, scale), "place int, value double, n bigint")
            # Exact sums, so that their order does not matter.
            mean = after.groupBy("place").agg((F.sum(F.col("value").cast("decimal(38,18)")).cast("double") / F.sum("n")).alias("value"))
            state = np.array([r.value for r in sorted(mean.collect())]).reshape(state.shape)
        network = Network(*_unpacked(state[0]), 1.0, 0.0, 0.5)
        scores = held.groupBy("part").applyInArrow(lambda part: _scored(part, network), "secret boolean, n double, score double")
        bins = scores.groupBy("secret", F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("n"), F.min("score")).collect()
    return _calibrated(network, sorted(map(tuple, bins)), recall)


def secrets(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Every row of ``docs`` reduced to doc_id, with the number of findings of each kind, the digest of the base ones,
    all spans as ``kind:start:end`` and the highest calibrated probability among the candidates (0 without any).

    A null or empty text has no findings; repeated rows each give a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs) if network is None else network)
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        lambda batches: _find(batches, sent.value),
        f"doc_id bigint, {counts}, base_sha256 string, spans string, score double")


def _find(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        size = len(batch)
        counts = {kind: np.zeros(size, np.int64) for kind in KINDS}
        digests, spans, scores = [empty] * size, [""] * size, np.zeros(size)
        for row, text, found in block_candidates(batch.column(1)):
            parts = [pieces(text, candidate) for candidate in found]
            every = probability(network, np.concatenate(parts))
            best = np.maximum.reduceat(every, np.cumsum([0, *(len(p) for p in parts[:-1])]))
            scores[row] = best.max()
            points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            kept = sorted((c.start, KINDS.index(c.kind), c.end) for c, p in zip(found, best.tolist(), strict=True)
                          if c.kind != "cnn" or p >= network.threshold)
            named = [(kind, f"{KINDS[kind]}:{points[start]}:{points[end]}") for start, kind, end in kept]
            for kind, _ in named:
                counts[KINDS[kind]][row] += 1
            digests[row] = hashlib.sha256(",".join(x for kind, x in named if KINDS[kind] != "cnn").encode()).hexdigest()
            spans[row] = ",".join(x for _, x in named)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(counts[k]) for k in KINDS), pa.array(digests), pa.array(spans), pa.array(scores)],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "score"])
