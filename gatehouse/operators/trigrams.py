"""Keyword search by an inverted index of three-character grams.

A text that contains a keyword has all grams of the keyword. The index lists, for each gram, the ids of the rows that have
it in some field; the lists of a keyword's grams are intersected from the rarest on, so that the lists of frequent grams
are met by the few ids that are left, and those are verified by the text itself. A keyword of fewer than three characters
has no gram, and all rows are searched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatehouse.functions.text import WHITESPACE, contains_ci
from gatehouse.operators.joins import exists_filter

SIZE = 3
#: Grams of a keyword that are intersected; the others could only rule out rows that the verification does.
MOST_GRAMS = 8


def _grams(lowered: Column) -> Column:
    starts = F.when(F.length(lowered) >= SIZE, F.sequence(F.lit(1), F.length(lowered) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substr(lowered, at, F.lit(SIZE)))


def gram_index(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``(gram, key)``: which rows have which grams in any of their ``fields``.

    The texts of a key are brought together before they are cut, since its grams take many times their room.
    """
    lowered = F.array(*(F.lower(F.coalesce(F.col(name), F.lit(""))) for name in fields))
    texts = rows.select(key, lowered.alias("_texts")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_texts"))).alias("_texts"))
    every = F.array_distinct(F.flatten(F.transform("_texts", _grams)))
    return texts.select(F.explode(every).alias("gram"), key)


def updated_index(index: DataFrame, changed: DataFrame, key: str, fields: Sequence[str], removed: DataFrame | None = None) -> DataFrame:
    """The index after rows were added or ``changed``, given as they are now, and others ``removed`` (key): entries of
    other rows stay as they are."""
    gone = changed.select(F.col(key).alias("_gone"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(key).alias("_gone")))
    kept = index.join(gone.distinct(), index[key] == F.col("_gone"), "left_anti")
    return kept.unionByName(gram_index(changed, key, fields))


def keyword_grams(keyword: str) -> list[str]:
    """The grams of a keyword as :func:`contains_ci` reads it."""
    folded = keyword.strip(WHITESPACE).lower()
    return list(dict.fromkeys(folded[i : i + SIZE] for i in range(len(folded) - SIZE + 1)))


def candidates(index: DataFrame, keyword: str, key: str) -> DataFrame | None:
    """Ids (key) of the rows that have the keyword's grams, or None where it has none."""
    grams = keyword_grams(keyword)
    if not grams:
        return None
    own = index.filter(F.col("gram").isin(grams))
    # One row for each gram of the keyword.
    counts = dict(own.groupBy("gram").count().collect())
    ranked = sorted(grams, key=lambda gram: (counts.get(gram, 0), gram))[:MOST_GRAMS]
    lists = [index.filter(F.col("gram") == gram).select(key) for gram in ranked]
    return reduce(lambda left, right: left.join(right, key, "left_semi"), lists)


def indexed_match(
    df: DataFrame, index: DataFrame, keyword: str, fields: Sequence[str], key: str, bridge: DataFrame | None = None,
    tags: DataFrame | None = None, tag_index: DataFrame | None = None,
) -> DataFrame:
    """The rows of :func:`gatehouse.operators.filters.keyword_match`, from the indexes of ``df``'s fields and of the tags'
    names: rows that the index leaves are verified, the others are not read for their texts."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(name), keyword), F.lit(False)) for name in fields))
    possible = candidates(index, keyword, key)
    direct = df.filter(hit) if possible is None else exists_filter(df, possible.withColumnRenamed(key, "_possible"), {key: "_possible"}).filter(hit)
    if bridge is None or tags is None:
        return direct
    named = None if tag_index is None else candidates(tag_index, keyword, "tag_id")
    own = tags if named is None else exists_filter(tags, named.withColumnRenamed("tag_id", "_named"), {"tag_id": "_named"})
    matching = own.filter(contains_ci(F.col("tag_name"), keyword)).select(F.col("tag_id").alias("_tag"))
    linked = exists_filter(bridge, matching, {"tag_id": "_tag"}).select(F.col("dataset_id").alias("_id"))
    ids = direct.select(F.col(key).alias("_id")).unionByName(linked).distinct()
    return exists_filter(df, ids, {key: "_id"})
