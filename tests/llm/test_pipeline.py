import random
from collections import defaultdict

import corpus_pipeline
from voxspark.llm import queries
from voxspark.scratch import Scratch, read_table

from .test_classifiers import corpus


def test_stages(spark, tmp_path):
    docs, labels = corpus(5, 300)
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    rows = [(i, t, "en", "s", len(t)) for i, t, *_ in docs]
    clean = [i for i, q, t in labels if q == 1 and t == 0]
    first = rows[clean[0]]

    def shuffled(text):
        words = text.split()
        rng.shuffle(words)
        return " ".join(words)

    rows += [(1000, first[1], "en", "s", 1), (1001, passage + " " + rows[clean[1]][1][::-1], "en", "s", 1), (1002, rows[clean[2]][1][::-1] + " " + passage, None, None, None), (1003, None, None, None, None), (None, shuffled(rows[clean[3]][1]), "en", "s", 3), (1004, "", "", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frames, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    keep = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        df = keep.keep(stage(spark, df, str(tmp_path)), name)
        frames[name] = df.collect()
        if name != "packing":
            assert df.columns == corpus_pipeline.COLUMNS
    ids = {k: {r.doc_id for r in v} for k, v in frames.items()}
    bad = {i for i, q, t in labels if t == 1}
    assert len(ids["toxicity"] & bad) <= 0.1 * len(bad)
    assert len([i for i in clean if i in ids["quality"]]) >= 0.97 * len(clean)
    assert None in ids["quality"]
    assert None in ids["simhash"]
    assert clean[0] in ids["simhash"]
    assert 1000 not in ids["simhash"]
    texts = {r.doc_id: r.text for r in frames["repeats"]}
    assert ids["repeats"] == ids["simhash"] and not any(passage in (t or "") for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in frames["repeats"])
    parts = defaultdict(int)
    for r in frames["packing"]:
        parts[r.doc_id] += r.length
    assert set(parts) == ids["repeats"] and all(parts[r.doc_id] == r.doc_tokens for r in frames["packing"] if r.doc_id is not None)


def test_run_equals_stages(spark, sf_dir):
    """Where pieces lie depends on how rows are dealt out; which tokens each document has does not."""
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) > 50 and max(r.length for r in out) <= 1024
    keep, docs = Scratch(spark, "test"), read_table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = keep.keep(stage(spark, docs, sf_dir), name)
    assert {(r.doc_id, r.doc_tokens) for r in out} == {(r.doc_id, r.doc_tokens) for r in docs.collect()}
    covered = defaultdict(int)
    for r in out:
        covered[r.doc_id] += r.length
    assert all(covered[r.doc_id] == r.doc_tokens for r in out)


def test_empty_tables_and_odd_texts_go_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = random.Random(4)
    blank = "".join(rng.choices(" \t\n\r", k=1_200_000))
    for rows in ([], [(1, blank + "x", "en", "s", 1), (2, None, None, None, None), (3, "a few words", "en", "s", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            found = docs.collect()
            assert bool(found) == bool(rows), name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
