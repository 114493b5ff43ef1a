"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. The rows of a source are cut into key ranges, so that a hot source is many ranges;
ranges are summed before the shuffle, prefix sums over the ranges and then inside each range give every row its place
in the source's random order, and the source's budget is cut at its exact word: full epochs first, then the beginning
of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatehouse.session import materialize

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Rows that one key range holds on average.
RANGE_ROWS = 3_000

_TOKEN = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of tokens; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all words; a target
    stops at ``most`` times its source's words, and the excess goes to the others by weight until none is above. Such
    a division raises one level, words per weight, and caps the sources in the order of their cap per weight: the
    level is what the budget left by the capped sources gives to the weights of the others, for the smallest number of
    capped sources that keeps it below the next cap; more of them would give less.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    # Each source's row is of bounded number: it is one row of an aggregate.
    every = Window.partitionBy()
    capped = weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    levels = (
        capped.withColumn("budget", F.least(F.lit(share), F.lit(most)) * F.sum("source_size").over(every))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("try", (F.col("budget") - F.col("spent")) / F.col("left"))
    )
    # The first source, in cap order, whose cap the level of the remaining ones does not reach, fixes the level.
    level = F.max(F.when(F.col("try") <= F.col("cap") / F.col("weight"), F.col("try"))).over(every)
    return levels.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, seed: int = 0, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with size, source_size, target and taken, one row for each row.

    ``taken`` counts the words that the mix takes of the row, repeats included: ``floor(target / source_size)`` times
    its size, and what one more epoch in random order takes up to the source's budget, where the row at the cut is
    taken in part. The taken words of a source add up to its target, rounded down. Rows without words take none; a null
    source is a source; repeated rows follow each other in the order. Columns of ``docs`` with these names are replaced.
    """
    given = {name: f"_own{i}" for i, name in enumerate(docs.columns)}
    text, doc_id, source = F.col(given["text"]), F.col(given["doc_id"]), F.col(given["source"])
    # The key depends on the row alone, so that reruns and any partitioning give the same order.
    sized = docs.toDF(*given.values()).withColumns({
        "_size": words(text),
        "_key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))),
        # Never null, so that the join below needs no other partitioning than the window before it.
        "_source": F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")), "_named": source.cast("string")})
    # The number of ranges follows the rows alone, and so does every row's range.
    rows = docs.count()
    ranges = 1
    while ranges * RANGE_ROWS < rows and ranges < 1 << 32:
        ranges *= 2
    bits = ranges.bit_length() - 1
    # Ranges are those of the key's first eight digits.
    place = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"), 32 - bits)
    sized = sized.withColumn("_range", place)
    sums = materialize(sized.groupBy("_source", "_range").agg(F.first("_named").alias("_named"), F.sum("_size").alias("_words")))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_source").alias("_at_source"), F.col("_range").alias("_at_range"), "_named",
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    budgets = targets(sums.groupBy(F.col("_named").alias("source")).agg(F.sum("_words").alias("source_size")), share, most)
    known = offsets.join(budgets, offsets["_named"].eqNullSafe(budgets["source"])).drop("source", "_named")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = placed.join(
        known, (placed["_source"] == known["_at_source"]) & (placed["_range"] == known["_at_range"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("_offset") - F.col("_before")
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    new = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("bigint")}
    own = [F.col(column).alias(name) for name, column in given.items() if name not in new]
    return joined.select(*own, *(column.alias(name) for name, column in new.items()))


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target and taken."""
    return mix(docs, seed).filter("taken > 0")


#: DuckDB SQL that puts each source's rows in one order and adds up their words there.
CHECKING_SQL = f"""
WITH row AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'))::BIGINT AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
size AS (SELECT source, sum(size)::BIGINT AS source_size FROM row GROUP BY source),
weighed AS (
  SELECT source, source_size, [{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}][
      1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, {MOST}::DOUBLE * source_size AS cap
  FROM size),
tried AS (
  SELECT a.source, any_value(a.cap / a.weight) AS reach,
    ((SELECT {SHARE}::DOUBLE * sum(source_size) FROM size) - coalesce(sum(b.cap) FILTER (NOT after), 0)) / sum(b.weight) FILTER (after) AS level
  FROM weighed a, LATERAL (
    SELECT cap, weight, (b.cap / b.weight, b.source IS NULL, coalesce(b.source, '')) >= (a.cap / a.weight, a.source IS NULL, coalesce(a.source, '')) AS after
    FROM weighed b) b
  GROUP BY a.source),
budget AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM tried WHERE level <= reach) * weight), cap) AS target FROM weighed),
placed AS (
  SELECT r.*, b.source_size, b.target,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM row r JOIN budget b ON b.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)) AS taken
FROM placed"""
