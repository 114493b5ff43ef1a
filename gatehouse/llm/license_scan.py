"""License notices by a positional rare-token index, in DataFrame functions only.

The templates are fixed phrases and whole notices. Over all documents, the inverse document frequency of every licence
word is counted; each template is entered in the index under its rarest words, with their offsets, until these have more
of its weight than a place may lack, and under the rarest word of its mandatory phrase. So every place that can count is
proposed. A document's occurrences of these words propose places, the template's words are compared at their relative
positions, and a place counts when enough of the words' weight is there and the mandatory phrase stands in full.
Everything happens inside the row.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

# Label, notice, mandatory phrase. The first three are the base phrases, which count in full only.
TEMPLATES = (
    ("mit", "under the mit license", "under the mit license"),
    ("apache-2", "apache license version 2", "apache license version 2"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
     " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
     " merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
     " furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be"
     " included in all copies or substantial portions of the software the software is provided as is without warranty of any kind"
     " express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
     " noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"
     " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
     " other dealings in the software", "without warranty of any kind"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
     " provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and"
     " the author disclaims all warranties with regard to this software including all implied warranties of merchantability and"
     " fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages"
     " whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"
     " arising out of or in connection with the use or performance of this software", "with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
     " conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the"
     " following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and"
     " the following disclaimer in the documentation and or other materials provided with the distribution",
     "this list of conditions and the following disclaimer"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
     " license you may obtain a copy of the license at", "apache license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
     " license as published by the free software foundation either version 3 of the license or at your option any later version",
     "gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not"
     " distributed with this file you can obtain one at", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use"
     " compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non"
     " commercial and by any means", "unencumbered software"),
)
BASE = 3
#: Share of a notice's weight that must stand in its place.
LEAST_SHARE = 0.8

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; a null text has none."""
    # lower() is the faster of the two; of all other letters only these two become ASCII by it.
    foreign = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    lowered = F.when(foreign, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(_WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def frequencies(worded: DataFrame) -> tuple[int, dict[str, int]]:
    """(documents, documents by licence word), over all rows of ``worded`` (words); one row per word of the templates
    comes to the driver."""
    vocabulary = sorted({word for _, notice, _ in TEMPLATES for word in notice.split()})
    found = worded.select(F.explode(F.concat(
        F.array_intersect("words", _strings(vocabulary)), F.array(F.lit("")))).alias("word")).groupBy("word").count()
    counts = {row["word"]: row["count"] for row in found.collect()}
    return counts.pop("", 0), {word: counts.get(word, 0) for word in vocabulary}


def entered(notice: list[str], phrase: list[str], weight: dict[str, float]) -> set[str]:
    """Words under which a notice is in the index: a place without any of them lacks too much weight, or the phrase."""
    found, held = set(), 0.0
    allowed = (1 - LEAST_SHARE) * sum(weight[word] for word in notice)
    for word in sorted(set(notice), key=lambda word: (weight[word], word), reverse=True):
        if held > allowed:
            break
        found.add(word)
        held += weight[word] * notice.count(word)
    return found | {max(phrase, key=lambda word: (weight[word], word))}


def licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are numbered from 0; ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase, else
    null. ``score`` is the highest share of a notice's weight found in place with its mandatory phrase, 0 without any;
    ``labels`` has the base labels and those of notices whose share reaches LEAST_SHARE. A null or empty text has no
    words. Repeated rows each give a row; other columns are not read.
    """
    worded = docs.select(F.col("doc_id").alias("doc_id"), words(F.col("text")).alias("words"))
    rows, by_word = frequencies(worded)
    # Rounded, so that the sum of a notice's weights does not depend on their order.
    weight = {word: round(_idf(rows, n), 6) for word, n in by_word.items()}
    templates, entries = [], {}
    for number, (label, notice, phrase) in enumerate(TEMPLATES):
        own, key = notice.split(), phrase.split()
        for word in entered(own, key, weight):
            entries.setdefault(word, []).extend((number, offset) for offset, other in enumerate(own) if other == word)
        shift = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        templates.append(F.struct(
            F.lit(label).alias("label"), F.lit(number < BASE).alias("base"), _strings(own).alias("words"),
            _strings([weight[word] for word in own]).alias("weights"), F.lit(sum(weight[word] for word in own)).alias("total"),
            F.lit(shift).alias("shift"), _strings(key).alias("phrase")))
    every = F.array(*templates)
    index = F.create_map(*(x for word, own in entries.items() for x in (F.lit(word), F.array(*(
        F.struct(F.lit(number).alias("number"), F.lit(offset).alias("offset")) for number, offset in own)))))
    rare = _strings(sorted(entries))

    def at(place: Column) -> Column:
        return F.get(F.col("words"), place)

    def proposed(hit: Column) -> Column:
        return F.transform(index[hit["word"]], lambda entry: F.struct(
            entry["number"].alias("number"), (hit["place"] - entry["offset"]).alias("start")))

    def judged(place: Column) -> Column:
        template = F.get(every, place["number"])
        found = F.aggregate(
            F.sequence(F.lit(0), F.size(template["words"]) - 1), F.lit(0.0), lambda total, i: total + F.when(
                at(place["start"] + i) == F.get(template["words"], i), F.get(template["weights"], i)).otherwise(0.0))
        stands = F.forall(F.sequence(F.lit(0), F.size(template["phrase"]) - 1), lambda i: at(
            place["start"] + template["shift"] + i).eqNullSafe(F.get(template["phrase"], i)))
        return F.struct(template["label"].alias("label"), template["base"].alias("base"), place["start"].alias("start"),
                        F.when(stands, found / template["total"]).otherwise(0.0).alias("share"))

    hits = F.filter(F.transform(F.col("words"), lambda word, place: F.struct(word.alias("word"), place.alias("place"))),
                    lambda hit: hit["word"].isin(sorted(entries)))
    some = worded.withColumn("hits", F.when(F.arrays_overlap("words", rare), hits))
    scanned = some.withColumn("places", F.when(F.col("hits").isNotNull(), F.transform(
        F.array_distinct(F.flatten(F.transform("hits", proposed))), judged)))
    base = F.filter(F.coalesce("places", F.array()), lambda p: p["base"] & (p["share"] > 0))
    good = F.filter(F.coalesce("places", F.array()), lambda p: F.when(
        p["base"], p["share"] > 0).otherwise(p["share"] >= LEAST_SHARE))
    listed = scanned.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "places", base.alias("base"), good.alias("good"))
    return listed.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("good", lambda p: p["label"]))), ",").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)), 6).alias("score"),
    )


def _idf(rows: int, with_word: int) -> float:
    return log((rows + 1) / (with_word + 1)) + 1e-6


def _checking_sql() -> str:
    """DuckDB SQL by another route: words as rows, joined to the templates' words by relative position, wherever the
    mandatory phrase stands."""
    notices = ", ".join(f"({n}, '{label}', {str(n < BASE).lower()}, '{notice}', '{phrase}')"
                        for n, (label, notice, phrase) in enumerate(TEMPLATES))
    return f"""
WITH template(number, label, base, notice, phrase) AS (VALUES {notices}),
split AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS own FROM documents),
word AS (SELECT doc_id, unnest(own) AS word, generate_subscripts(own, 1) - 1 AS place FROM split),
part AS (
  SELECT number, unnest(string_split(notice, ' ')) AS word, generate_subscripts(string_split(notice, ' '), 1) - 1 AS nth
  FROM template),
key_part AS (
  SELECT number, word, nth,
    (SELECT min(i) FROM range(0, len(string_split(notice, ' '))) r(i)
     WHERE string_split(notice, ' ')[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' ')) + nth AS at
  FROM (SELECT number, notice, phrase, unnest(string_split(phrase, ' ')) AS word,
          generate_subscripts(string_split(phrase, ' '), 1) - 1 AS nth FROM template)),
weight AS (
  SELECT p.word, round(ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT w.doc_id) + 1)) + 1e-6, 6) AS weight
  FROM (SELECT DISTINCT word FROM part) p LEFT JOIN word w ON w.word = p.word GROUP BY p.word),
key_size AS (SELECT number, count(*) AS n FROM key_part GROUP BY number),
whole AS (SELECT number, sum(weight) AS total FROM part JOIN weight USING (word) GROUP BY number),
verified AS (
  SELECT w.doc_id, k.number, w.place - k.at AS start
  FROM key_part k JOIN key_size z ON z.number = k.number JOIN word w ON w.word = k.word
  GROUP BY w.doc_id, k.number, w.place - k.at, z.n HAVING count(*) = z.n),
found AS (
  SELECT p.doc_id, p.number, p.start, sum(weight) AS found
  FROM verified p JOIN part ON part.number = p.number
  JOIN word w ON w.doc_id = p.doc_id AND w.place = p.start + part.nth AND w.word = part.word
  JOIN weight ON weight.word = part.word
  GROUP BY ALL),
place AS (
  SELECT doc_id, label, base, start, found / total AS share,
    CASE WHEN base THEN true ELSE found / total >= {LEAST_SHARE} END AS good
  FROM verified JOIN found USING (doc_id, number, start) JOIN whole USING (number) JOIN template USING (number))
SELECT s.doc_id, len(own)::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
  min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels,
  round(coalesce(max(share), 0), 6) AS score
FROM split s LEFT JOIN place p ON p.doc_id = s.doc_id GROUP BY s.doc_id, own"""


CHECKING_SQL = _checking_sql()
