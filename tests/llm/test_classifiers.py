import random
import zlib

import pytest
from pyspark.sql import functions as F

from voxspark.llm import subword, toxicity
from voxspark.llm.labelled import different
from voxspark.llm.queries import remainder


def learn():
    return remainder("doc_id", 5) != 0


NAMES = "doc_id long, text string, score string, predicted string, y int"


def corpus(seed, n=600):
    rng = random.Random(seed)
    syllables = ["th", "an", "re", "ed", "on", "ing", "ou", "st", "é"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 300))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "zzlok" + word(), "zzlok" + word()]))
        if junk:
            words = rng.choice([[w + rng.choice(["%%%", "###"]) for w in words], [w.upper() + "!!" for w in words], [w for w in words[:5] for _ in range(20)]]) + (["idiot"] if toxic else [])
        docs.append((i, " ".join(words), None, None, 1))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1)
    odd = [(None, "the idiot", "x", "y", 0), (5000, None, None, None, None), (5001, "", "", "", 0), (7, docs[7][1], "", "", 0), (5002, "%%% " * 50_000, "", "", 0)]
    marks = [*labels, (None, 1, 1), (9999, 0, 0), (6, None, None), (7, labels[7][1], labels[7][2])]
    return spark.createDataFrame(docs + odd, NAMES), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def held_out(out, truth, k):
    rows = [r for r in out.where(~learn()).collect() if r.doc_id in truth]
    hit = lambda y: [r.predicted == y for r in rows if truth[r.doc_id][k] == y]
    return sum(hit(0)) / len(hit(0)), sum(hit(1)) / len(hit(1))


def test_quality(tables):
    docs, labels, truth = tables
    out = subword.classify(docs, labels, learn())
    assert out.columns.count("score") == 1 and out.count() == docs.count()
    junk, clean = held_out(out, truth, 0)
    assert junk >= 0.9 and clean >= 0.97
    assert out.where("doc_id = 5002 AND predicted = 0").count() == 1
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxicity(tables):
    docs, labels, truth = tables
    out = toxicity.classify(docs, labels, learn())
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    clean, toxic = held_out(out, truth, 1)
    assert toxic >= 0.9 and clean >= 0.97


def test_without_labels(spark, tables):
    docs, labels, _ = tables
    none = labels.where("false")
    few = docs.where("doc_id < 40 OR doc_id >= 5000")
    assert {r.score for r in subword.classify(few, none, learn()).collect()} == {0.5}
    assert toxicity.classify(few, none, learn()).where("score IS NULL").count() == 0
    empty = docs.where("false")
    assert subword.classify(empty, labels, learn()).collect() == [] and toxicity.classify(empty, none, learn()).collect() == []


def test_labels_of_other_rows_dont_matter(tables):
    docs, labels, _ = tables
    flipped = labels.withColumn("quality", F.when(learn(), F.col("quality")).otherwise(1 - F.col("quality")))
    a = {(r.doc_id, r.score) for r in subword.classify(docs, labels, learn()).collect()}
    assert a == {(r.doc_id, r.score) for r in subword.classify(docs, flipped, learn()).collect()}


def test_long_texts_count_whole():
    p = subword.SubwordParams()
    table = subword.np.zeros(p.buckets, dtype=subword.np.float32)
    text = b"word " * 300_000 + b"%%% " * 300_000
    table[:] = 1
    assert subword.log_odds([text, b""], table, 0.5, -1.0, p).tolist() == pytest.approx([1.5, -1.0])
    voters = toxicity.make_voters([], [], toxicity.ToxicityParams())
    assert toxicity.vote([b"a " * 900_000 + b"you idiot", b"kind", b""], voters).tolist()[0] & 1 == 1


def test_label_model_weights_repeating_voters():
    rng = toxicity.np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good = [(rng.random(4000) < toxicity.np.where(y, 0.7, 0.02)) for _ in range(3)]
    noise = rng.random(4000) < 0.1
    votes = sum(v.astype(int) << k for k, v in enumerate([*good, noise, noise, noise, ~(good[0] | good[1] | good[2])]))
    patterns, counts = toxicity.np.unique(votes, return_counts=True)
    posterior = toxicity.label_model(patterns, counts.astype(float), votes[:200], y[:200].astype(int), 7, 50)
    best = sum(toxicity.np.log(toxicity.np.where(v, 0.7 / 0.02, 0.3 / 0.98)) for v in good) + toxicity.np.log(0.2 / 0.8) > 0  # with the true rates
    assert ((posterior(votes) > 0) == y).mean() > (best == y).mean() - 0.015


def test_copies_teach_once():
    texts = [b"one two three four five", b"six seven eight", b"one two three four five", b"", b""]
    assert different(texts) == [0, 1, 3]


def by_hand(tables, k):
    """Rows, and the texts and classes learnt from, as plain lists."""
    docs, labels, _ = tables
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    taught = {}
    for r in labels.collect():
        if r[k + 1] in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            taught[r.doc_id] = max(taught.get(r.doc_id, 0), r[k + 1])
    first = {i: t for i, t in sorted((i, t) for i, t in rows if i in taught)}
    ids = sorted(first)
    ids = [ids[n] for n in different([first[i] for i in ids])]
    return rows, [first[i] for i in ids], [taught[i] for i in ids], [sum(c == y for c in taught.values()) for y in (0, 1)]


def test_quality_by_hand(tables):
    """The whole operator again without Spark."""
    rows, texts, classes, counts = by_hand(tables, 0)
    p, np = subword.SubwordParams(), subword.np
    table, bias = subword.train(texts, classes, counts, p)
    z = subword.log_odds([t for _, t in rows], table, bias, float(np.log((counts[1] + 1) / (counts[0] + 1))), p)
    want = sorted((str(i), round(float(1 / (1 + np.exp(-x))), 9)) for (i, _), x in zip(rows, z))
    got = subword.classify(tables[0], tables[1], learn()).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want


def test_toxicity_by_hand(tables):
    """Mining, votes, label model and classifier again without Spark."""
    rows, texts, classes, _ = by_hand(tables, 1)
    p, np = toxicity.ToxicityParams(), toxicity.np
    voters = toxicity.make_voters(texts, classes, p)
    number = len(voters.lexicons) + len(toxicity.PREFIXES) + toxicity.PATTERNS
    learnt = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5]
    votes = toxicity.vote([t for _, t in learnt], voters)
    patterns, counts = np.unique(votes, return_counts=True)
    posterior = toxicity.label_model(patterns, counts.astype(float), toxicity.vote(texts, voters), np.array(classes), number, p.rounds)
    first = {}
    for i, t in learnt:
        first[i] = max(t, first.get(i, b""))
    ids = sorted(i for i in first if i != 5000 and len(first[i]) <= p.max_bytes)  # null and very long texts are not learnt from
    ids = [ids[n] for n in different([first[i] for i in ids])]
    taught = [first[i] for i in ids]
    cast = toxicity.vote(taught, voters)
    weights, bias = toxicity.fit_linear(taught, cast, number, 1 / (1 + np.exp(-np.clip(posterior(cast), -50, 50))), p)
    want = sorted((str(i), round(float(s), 6)) for (i, _), s in zip(rows, toxicity.linear_scores([t for _, t in rows], voters, weights, bias, p)))
    got = toxicity.classify(tables[0], tables[1], learn()).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_share_of_suspect_words():
    """Words that begin like a family of telling ones count by their share of the text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    family = ["zorkan" + word() for _ in range(400)]  # hardly any of them seen before
    text = lambda n, bad: " ".join(rng.sample([*(word() for _ in range(n)), *rng.sample(family, bad)], n + bad)).encode()
    y = [int(k % 5 == 0) for k in range(400)]
    texts = [text(200, 6 if c else int(rng.random() < 0.05)) for c in y]
    p = toxicity.ToxicityParams()
    voters = toxicity.make_voters(texts, y, p)
    dense = 1 << len(voters.lexicons) + len(toxicity.PREFIXES) + 3
    new = toxicity.vote([text(200, 6), text(5000, 5), text(200, 0), b"", text(200, 6).upper()], voters)
    assert [bool(v & dense) for v in new] == [True, False, False, False, True]
