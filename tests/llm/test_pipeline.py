"""Each stage of the pipeline against a brute-force version on its own input."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from gatehouse.llm import near_dups, pii
from gatehouse.llm.arrow_text import text_blocks, word_hashes


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def duplicates(docs):
    """doc_ids that all pairs of five-word shingle sets at 0.8 or more put behind a smaller doc_id."""
    sets, index, label = {}, {}, {}
    for row in sorted(docs, key=lambda r: r.doc_id):
        own = next(word_hashes(b)[0] for b in text_blocks(near_dups.pa.array([row.text])))
        sets[row.doc_id] = set(near_dups.shingles(own).tolist())
        label[row.doc_id] = row.doc_id
        counts = {}
        for x in sets[row.doc_id]:
            for other in index.setdefault(x, []):
                counts[other] = counts.get(other, 0) + 1
            index[x].append(row.doc_id)
        for other, n in counts.items():
            if n / (len(sets[row.doc_id]) + len(sets[other]) - n) >= 0.8:
                a, b = row.doc_id, other
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                label[max(a, b)] = min(a, b)
    return {i for i in label if label[i] != i}


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        gone = {r.doc_id for r in before} - set(after)
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert len(gone) <= 3 and all(after[r.doc_id] == r for r in before if r.doc_id in after)
        elif name == "near_dedup":
            assert gone == duplicates(before)
        elif name == "benchmark_decontamination":
            items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            windows = {tuple(x[k : k + 10]) for x in items for k in range(max(1, len(x) - 9)) if x}
            sizes = {len(w) for w in windows}
            bad = {r.doc_id for r in before for n in sizes for own in [words(r.text)]
                   if any(tuple(own[k : k + n]) in windows for k in range(len(own) - n + 1))}
            assert gone == bad and bad
        elif name == "pii":
            assert not gone
            assert all(after[r.doc_id].text == (pii._redact_text(r.text) if r.text else r.text) for r in before)
            assert not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
            assert all(0 < r.taken <= 2 * sizes[r.doc_id] and r.size == sizes[r.doc_id] for r in after.values())
            by_source = {}
            for r in after.values():
                by_source.setdefault(r.source, [0, r.target])[0] += r.taken
            assert all(abs(taken - goal) <= 1 for taken, goal in by_source.values())
        kept[name] = len(after)
    assert list(kept) == ["language_id", "near_dedup", "benchmark_decontamination", "pii", "mixing"]


def test_empty_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, a null source, and columns named as the stages' own ones."""
    folder = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    added = spark.sql(f"""SELECT * FROM VALUES
        (NULL, 'the and of that in is this with for on are as by an it', 'en'), (NULL, NULL, 'en'), (7, NULL, NULL), (8, '', 'en'),
        (900001, 'one reing thing and the other thtion of that in is', NULL), (900001, 'one reing thing and the other thtion of that in is', NULL),
        (900002, repeat('the and of that in is this with for on ', 3000), 'en'), (900003, 'the and of that write to jane.doe@example.org and in is', 'en')
        t(doc_id, text, lang)""").selectExpr(
            "CAST(doc_id AS BIGINT) AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "CAST(char_length(text) AS BIGINT) AS n_chars")
    rows = plain.select("doc_id", "text", "lang", "source", plain["n_chars"].cast("bigint").alias("n_chars")).unionByName(added)
    docs = rows.selectExpr("*", "1 AS _word", "'b' AS _bits", "2 AS text_key", "true AS kept", "'m' AS _marked_id", "0 AS node", "3 AS taken", "'x' AS _row")
    columns, sizes = docs.columns, []
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns and docs.filter("_word <> 1 OR _bits <> 'b' OR text_key <> 2 OR node <> 0").count() == 0
        if name == "language_id":
            # Null and empty texts are in no language; rows that repeat an id are judged by their text.
            assert docs.filter("text IS NULL OR text = ''").count() == 0 and docs.filter("doc_id = 900001").count() == 2
        elif name == "near_dedup":
            assert docs.filter("doc_id = 900001").count() == 1 and docs.filter("doc_id IS NULL").count() == 1
        elif name == "pii":
            assert docs.filter("doc_id = 900003 AND text LIKE '%[EMAIL]%' AND n_chars = char_length(text)").count() == 1
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert {"size", "source_size", "target", "taken"} <= set(docs.columns) and docs.filter("taken > 2 * size").count() == 0


def test_redaction_of_an_empty_table_and_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org now", 5, "x")], "doc_id long, text string, n_email int, spans string")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "mail [EMAIL] now", 5, "x")]
    assert pii.redact(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).columns == docs.columns


def test_workers_are_handed_a_bounded_number_of_bytes(spark):
    """300 texts of 100 KB in one partition, 30 MB, are less than 10,000 rows."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 17_000).alias("text")).coalesce(1)
    corpus_pipeline.redact_personal_data(spark, docs, "")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) >= 30_000_000 and max(r.n for r in sizes) <= 8_000_000
