import hashlib
import random
from collections import Counter

import pytest

from voxspark.llm.suffix_dedup import RepeatParams, digest, remove_repeats

SCHEMA = "doc_id long, text string, spans string"


def brute(texts: list[bytes], window: int):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def check(spark, rows, **params):
    df = spark.createDataFrame(rows, SCHEMA)
    p = RepeatParams(**params)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digest(remove_repeats(df, params=p)).collect())
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(((r[0] is None, r[0] or 0), *b) for r, b in zip(rows, brute(texts, p.window)))
    assert got == want
    return sum(w[2] for w in want)


def make(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ß", k=rng.randint(1, 7))) for _ in range(80)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = [text(rng.randint(5, 400)) for _ in range(12)]
    docs = base + [base[0], base[1], base[1] + " tail", "x " + base[2]]
    for b in base[:6]:  # edits, passages moved into other texts, words said again and again
        cut = sorted(rng.sample(range(len(b) + 1), 2))
        docs.append(b[: cut[0]] + text(3) + b[cut[0] :])
        docs.append(text(20) + b[cut[0] : cut[1]] + text(20))
        docs.append(text(4) + rng.choice(words) * rng.randint(1, 300))
    w = text(200)
    docs += [text(30) + w[:k] + text(30) for k in (198, 199, 200, 201, 202, 230, 260, 300)]
    docs += ["", None, "a" * 199, "a" * 200, "b" * 201, "nd, " * 500, "ing " * 60]
    rng.shuffle(docs)
    return [(i if i != 5 else None, d, "en") for i, d in enumerate(docs)] + [(3, docs[3], None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    assert check(spark, make(seed)) > 1000


@pytest.mark.parametrize("bits", [1, 5, 12])
def test_keys_that_agree_by_chance_remove_nothing(spark, bits):
    """With keys of a few bits nearly all strings' keys agree: the bytes decide."""
    assert check(spark, make(4), key_bits=bits) > 1000
    different = [(i, hashlib.sha512(str(i).encode()).hexdigest() * 2 + hashlib.sha512(str(-i).encode()).hexdigest() * 2, "") for i in range(40)]
    texts = [(i, t[:128] + str(i) * 9 + t[256:384], "") for i, t, _ in different]
    assert check(spark, texts, key_bits=bits) == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, long, "en"), (2, "x " + long[100_000:300_000] + " y", "en"), (3, "ab" * 150_000, "en")]
    assert check(spark, rows, chunk_bytes=100_000) > 600_000


def test_small_chunks_and_rare_triggers(spark):
    rows = make(9)
    assert check(spark, rows, chunk_bytes=2000) > 1000
    assert check(spark, rows, trigger_modulus=500) > 1000
    assert check(spark, rows, trigger_modulus=2, chunk_bytes=50_000) > 1000


def test_empty_table(spark):
    assert digest(remove_repeats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_texts_without_a_byte_need_no_powers(monkeypatch):
    """A worker whose first chunk is empty."""
    import numpy as np

    from voxspark.llm import bytehash

    monkeypatch.setattr(bytehash, "_POWERS", {})
    r = bytehash.Rolling(np.empty(0, dtype=np.uint8))
    assert r.sums.tolist() == [0] and len(r.windows(5)) == 0
