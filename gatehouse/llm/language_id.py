"""Language identification with a string kernel.

The blended-spectrum presence kernel counts the different byte n-grams, of one to three bytes, that two texts share,
divided by the root of the product of their own counts. A few landmark texts per language span a Nyström approximation
of the kernel space, a ridge regression per language (one against the rest) is fitted in it on a bounded sample, and
texts are scored by matrix products, a batch of texts at a time.

The regressions' outputs always have the same sum, so one of them is high for any text. Whether a text is in the language
at all is judged by the share of its three-byte n-grams that the language's landmarks have.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from gatehouse.llm.arrow_text import LOWER, Block, text_blocks
from gatehouse.llm.rows import without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
#: Bounds of the labelled sample that the classifier is fitted on, and of the model.
PER_LANGUAGE, SAMPLE, LANDMARKS, ALL_LANDMARKS = 300, 6000, 60, 1200
#: The most frequent languages that are learned, characters of a text of the sample at most (so that it is below 500 MB on
#: the driver, whatever its script), and n-grams that the kernel compares: the landmarks' most frequent ones.
LANGUAGES, SAMPLE_CHARS, GRAMS = 500, 20_000, 20_000
RIDGE = 1e-2
SPECTRUM = (1, 2, 3)
#: A text is strange if its share of known n-grams, with MARGIN standard errors at most, is below FAMILIAR of the share
#: that all but STRAY of its language's labelled texts reach.
FAMILIAR, STRAY, MARGIN = 0.8, 0.01, 4.0

_CODES = np.arange(256)
_LETTERS = (LOWER >= 0x61) & (LOWER <= 0x7A)
#: Letters and bytes beyond ASCII stay, everything else is a blank.
_TEXT = np.where(_LETTERS | (_CODES >= 0x80), LOWER, 0x20).astype(np.uint32)
#: Numbers of the bytes that a text can have, so that a table of three-byte n-grams has 15 MB, not 64.
_RANK = np.unique(_TEXT, return_inverse=True)[1].astype(np.int32)
_RANKS = int(_RANK.max()) + 1
_TABLES: dict[int, tuple] = {}
#: Texts by columns that are held at a time.
_CELLS = 1_000_000


class Model(NamedTuple):
    """N-gram codes by spectrum, landmark presence (divided by its norm), weights and shift per language, whether each
    language's landmarks have an n-gram, and the least share of known n-grams per language."""

    grams: tuple[np.ndarray, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    languages: list[str]
    known: np.ndarray
    least: np.ndarray

    @property
    def size(self) -> int:
        return sum(len(x) for x in self.grams)


def gram_codes(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every n-gram of ``size`` bytes that lies inside one text."""
    data = _TEXT[block.data]
    lengths = np.diff(block.offsets)
    row = np.repeat(np.arange(block.count, dtype=np.int32), lengths)
    codes = data[: max(0, len(data) - size + 1)].copy()
    for i in range(1, size):
        codes = (codes << np.uint32(8)) | data[i : len(data) - size + 1 + i]
    row = row[: len(codes)]
    inside = np.arange(len(codes)) + size <= block.offsets[1:][row]
    return row[inside], codes[inside]


def _place(codes: np.ndarray, size: int) -> np.ndarray:
    """Where n-grams of ``size`` bytes stand in their table."""
    if size < 3:
        return codes
    return (_RANK[codes >> 16] * _RANKS + _RANK[codes >> 8 & 0xFF]) * _RANKS + _RANK[codes & 0xFF]


def _numbers(model: Model) -> tuple:
    """For each spectrum a table from place to column, built once per worker; -1 where there is no such column."""
    key = hash((model.size, model.landmarks[:, :64].tobytes(), model.grams[-1].tobytes()))
    if key not in _TABLES:
        _TABLES.clear()
        tables, column = [], 0
        for size, grams in zip(SPECTRUM, model.grams, strict=True):
            tables.append(np.full(1 << (8 * size) if size < 3 else _RANKS**3, -1, np.int32))
            tables[-1][_place(grams, size)] = np.arange(column, column + len(grams))
            column += len(grams)
        _TABLES[key] = tuple(tables)
    return _TABLES[key]


def presence(model: Model, block: Block) -> np.ndarray:
    """Texts by columns: 1 where the text has the n-gram."""
    out = np.zeros((block.count, model.size), np.float32)
    flat = out.reshape(-1)
    for size, table in zip(SPECTRUM, _numbers(model), strict=True):
        row, codes = gram_codes(block, size)
        column = table[_place(codes, size)]
        known = column >= 0
        flat[row[known].astype(np.int64) * model.size + column[known]] = 1
    return out


def unknown_grams(model: Model, block: Block) -> np.ndarray:
    """How many different n-grams of each text the kernel has no column for."""
    out = np.zeros(block.count, np.int64)
    for size, table in zip(SPECTRUM, _numbers(model), strict=True):
        row, codes = gram_codes(block, size)
        own = table[_place(codes, size)] < 0
        both = np.unique(row[own].astype(np.uint64) << np.uint64(32) | codes[own])
        out += np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=block.count)
    return out


def embedded(model: Model, block: Block) -> np.ndarray:
    """Presence of each text's n-grams, divided by the root of the number of all its different ones."""
    present = presence(model, block)
    every = present.sum(axis=1) + unknown_grams(model, block)
    present /= np.sqrt(np.maximum(every, 1)).astype(np.float32)[:, None]
    return present


def _trigrams(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every three-byte n-gram that is not blank, as often as it occurs; -1 for an unknown one."""
    row, codes = gram_codes(block, 3)
    own = codes != 0x202020
    return row[own], _numbers(model)[2][_place(codes[own], 3)]


def strange(model: Model, block: Block, language: np.ndarray) -> np.ndarray:
    """Whether each text has clearly fewer n-grams of its language than the language's labelled texts."""
    row, column = _trigrams(model, block)
    known = (column >= 0) & model.known[language[row], column]
    every = np.maximum(np.bincount(row, minlength=block.count), 1)
    share = np.bincount(row, weights=known, minlength=block.count) / every
    return share + MARGIN * 0.5 / np.sqrt(every) < model.least[language]


def _least_shares(model: Model, own: dict[str, list[str]], each: int) -> np.ndarray:
    """Per language FAMILIAR of the share of known n-grams that all but STRAY of its labelled texts reach. An n-gram of a
    landmark is known if another landmark has it; a language with a single text rejects nothing."""
    least = np.zeros(len(model.languages))
    for number, language in enumerate(model.languages):
        if len(own[language]) < 2:
            continue
        landmarks = own[language][:each]
        having = (presence(model, one_block(landmarks)) > 0).sum(axis=0)
        shares = []
        for at, text in enumerate(own[language]):
            column = _trigrams(model, one_block([text]))[1]
            if len(column):
                shares.append(np.mean((column >= 0) & (having[column] > (1 if at < len(landmarks) else 0))))
        if shares:
            least[number] = FAMILIAR * np.sort(shares)[int(STRAY * len(shares))]
    return least


def has_letter(block: Block) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = np.concatenate([[0], np.cumsum(_LETTERS[block.data])])[block.offsets]
    found = plain[1:] > plain[:-1]
    beyond = np.concatenate([[0], np.cumsum(block.data >= 0x80)])[block.offsets]
    for i in np.flatnonzero(~found & (beyond[1:] > beyond[:-1])).tolist():
        text = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode(errors="replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def one_block(texts: list[str]) -> Block:
    return next(text_blocks(pa.array(texts, pa.string()), sys.maxsize // 2))


def fit(sample: list[tuple[str, str]]) -> Model:
    """Fit on (language, text) rows, the first rows of each language being the landmarks."""
    languages = sorted({language for language, _ in sample})
    own = {language: [text for other, text in sample if other == language] for language in languages}
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    chosen = [text for language in languages for text in own[language][:each]]
    block = one_block(chosen)
    counts = []
    for size in SPECTRUM:
        row, codes = gram_codes(block, size)
        both = np.unique(codes.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64)) >> np.uint64(32)
        counts.append(np.unique(both, return_counts=True))
    order = np.argsort(-np.concatenate([n for _, n in counts]), kind="stable")[:GRAMS]
    kept = np.zeros(sum(len(n) for _, n in counts), bool)
    kept[order] = True
    parts = np.split(kept, np.cumsum([len(n) for _, n in counts])[:-1])
    model = Model(tuple(codes[part].astype(np.int64) for (codes, _), part in zip(counts, parts, strict=True)),
                  np.zeros((0, 64), np.float32), np.zeros((0, 0)), np.zeros(0), languages, np.zeros((0, 0), bool), np.zeros(0))
    model = model._replace(landmarks=embedded(model, block))
    first = np.cumsum([0, *(len(own[language][:each]) for language in languages)])
    model = model._replace(known=np.stack([(model.landmarks[a:b] > 0).any(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)]),
                           least=_least_shares(model, own, each))
    values, vectors = np.linalg.eigh(model.landmarks.astype(np.float64) @ model.landmarks.T.astype(np.float64))
    strong = values > 1e-6 * values.max()
    whiten = vectors[:, strong] / np.sqrt(values[strong])
    points, targets = [], []
    for language in languages:
        for at in range(0, len(own[language]), 64):
            part = own[language][at : at + 64]
            points.append(embedded(model, one_block(part)) @ model.landmarks.T @ whiten)
            targets += [[1.0 if language == other else -1.0 for other in languages]] * len(part)
    points, targets = np.concatenate(points), np.array(targets)
    shift, centre = targets.mean(axis=0), points.mean(axis=0)
    gram = (points - centre).T @ (points - centre) + RIDGE * len(points) / 100 * np.eye(points.shape[1])
    ridge = np.linalg.solve(gram, (points - centre).T @ (targets - shift))
    return model._replace(weights=whiten @ ridge, shift=shift - centre @ ridge)


def scores(model: Model, block: Block) -> np.ndarray:
    """One value per text and language: the regressions' outputs, -1 to 1 for texts like those of the sample."""
    return embedded(model, block) @ model.landmarks.T @ model.weights + model.shift


def train(docs: DataFrame) -> Model | None:
    """Fit on at most PER_LANGUAGE texts (and SAMPLE in all) of each of the LANGUAGES most frequent languages, those of the
    smallest hashes among texts of up to SAMPLE_CHARS characters; None without any labelled text. Rarer languages are
    not learned."""
    own = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), F.xxhash64("doc_id", F.lit("lang")).alias("order")
    ).filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) BETWEEN 1 AND %d" % SAMPLE_CHARS)
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    # Few more rows than are wanted are ranked, and the ranking hands on no more than are wanted of each language.
    rate = F.create_map(*(F.lit(x) for language, n in counts.items() for x in (language, min(1.0, 2.0 * each / n))))
    share = (F.col("order") / F.lit(2.0**64)) + 0.5
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    chosen = own.filter(share < F.element_at(rate, F.col("lang"))).withColumn("place", place).filter(F.col("place") <= each)
    sample = sorted((r["lang"], r["place"], r["text"]) for r in chosen.select("lang", "place", "text").collect())
    return fit([(language, text) for language, _, text in sample])


def held_out(modulus: int):
    """Whether crc32 of the doc_id as text has no remainder; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(True))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, lang_pred, score, strange.

    ``lang_pred`` is the language of the highest value; ``score`` maps that value from -1..1 to 0..1, so above one half
    its own regression accepts the text. ``strange`` marks texts that are hardly in that language. A null text, one without a letter, or any text without a model is ``und``, 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    return rows.mapInArrow(
        lambda batches: _predicted(batches, sent.value),
        "doc_id bigint, text_key bigint, lang_pred string, score double, strange boolean")


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, values, odd = [], [], []
        for block in text_blocks(batch.column(2)):
            step = max(1, _CELLS // model.size) if model else block.count
            for at in range(0, block.count, step):
                end = min(block.count, at + step)
                low, high = block.offsets[at], block.offsets[end]
                part = Block(at, end - at, block.data[low:high], block.offsets[at : end + 1] - low)
                known = has_letter(part) if model else np.zeros(part.count, bool)
                found = scores(model, part) if model else np.zeros((part.count, 1))
                best = found.argmax(axis=1)
                names += [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                odd.append(known & strange(model, part, best) if model else known)
                values.append(np.where(known, np.clip((found.max(axis=1) + 1) / 2, 0, 1), 0.0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()),
             pa.array(np.concatenate(values) if values else np.zeros(0), pa.float64()),
             pa.array(np.concatenate(odd) if odd else np.zeros(0, bool), pa.bool_())],
            names=["doc_id", "text_key", "lang_pred", "score", "strange"])


def _identified(docs: DataFrame) -> DataFrame:
    return predict(docs.select("doc_id", "text"), train(docs.filter(~held_out(5)))).withColumn("held_out", held_out(5))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every row of ``docs``, learned from labelled rows that are not held out; see ``predict``."""
    return _identified(docs).select("doc_id", "held_out", "lang_pred", "score", "text_key")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that are in no learned language: ``und``, or strange to the most likely one."""
    return without(docs, lambda: _identified(docs).filter((F.col("lang_pred") == UNKNOWN) | F.col("strange")))
