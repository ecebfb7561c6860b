import hashlib
import math
import random

import numpy as np
import pytest

from voxspark.llm.vector_codes import EDGE, CodeParams, Slices, code_vectors, decode, encode

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, label_error long"


def usable(v, parts):
    return v is not None and len(v) and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, p: CodeParams):
    """Plain loops over rows, parts and entries."""
    kept = sorted((r for r in rows if usable(r[1], p.parts)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    number = lambda x: max(-EDGE, min(EDGE, math.floor(p.scale * float(np.float32(x)))))
    width = len(kept[0][1]) // p.parts
    cut = [[tuple(number(x) for x in r[1][k * width : (k + 1) * width]) for k in range(p.parts)] for r in kept]
    books = [[list(c[k]) for c in cut[: p.entries]] for k in range(p.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(p.rounds):
        for k, book in enumerate(books):
            of = [[] for _ in book]
            for c in cut:
                of[nearest(c[k], book)[1]].append(c[k])
            books[k] = [[sum(x) // len(parts) for x in zip(*parts)] if parts else e for e, parts in zip(book, of)]
    found = [[nearest(c[k], books[k]) for k in range(p.parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, error))


def table(seed, n=300, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    base[20:60] = base[:40]  # equal entries
    rows = [b.tolist() for b in base] + [[0.0] * dim, [1e30] * dim, [-1e30] + [0.0] * (dim - 1)]
    rows += [None, [], [1.0] * (dim - 1) + [None], [1.0] * (dim - 1) + [math.nan], [math.inf] + [1.0] * (dim - 1), [1.0, 2.0], [1.0] * 16]
    random.Random(seed).shuffle(rows)
    out = [(i if i % 50 else None, r, (i % 7) if i % 3 else 1 if i % 5 else None, "c", 1, 2) for i, r in enumerate(rows)]
    return out + [(5, rows[6], 0, "c", 1, 2), (5, rows[5], None, "c", 1, 2)]


@pytest.mark.parametrize("seed,params", [(1, CodeParams()), (2, CodeParams(batch=17, hot_share=3)), (3, CodeParams(parts=8, entries=5, rounds=4))])
def test_against_loops(spark, seed, params):
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = code_vectors(df, params=params).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute(rows, params)


def test_fewer_rows_than_entries_and_no_rows(spark):
    rows = [(1, [0.5] * 16, None, "", 0, 0), (None, [2.0] * 16, None, "", 0, 0), (1, [0.5] * 16, 3, "", 0, 0)]
    got = code_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute(rows, CodeParams())
    assert code_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert code_vectors(spark.createDataFrame([(1, None, 1, "", 0, 0)], SCHEMA)).collect() == []


def test_more_entries_than_bits_are_refused(spark):
    with pytest.raises(ValueError, match="64"):
        code_vectors(spark.createDataFrame(table(1), SCHEMA), params=CodeParams(entries=65))


def test_masks_hold_the_nearest_and_drop_most():
    rng = np.random.default_rng(4)
    entries, parts = rng.integers(-300, 300, (64, 4)), rng.integers(-300, 300, (5000, 4))
    s = Slices(entries)
    masks = s.masks(parts, s.radius(parts))
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    best = distance.argmin(axis=1)
    assert ((masks >> best.astype(np.uint64)) & np.uint64(1)).all()
    assert np.bitwise_count(masks).mean() < 0.3 * len(entries)
    entry, found = s.nearest(parts)
    assert (entry == best).all() and (found == distance.min(axis=1)).all()


def test_codes_give_the_vectors_back_nearly(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.01 * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(400)]
    coded, books = encode(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    for r in decode(coded, books).collect():
        assert np.abs(np.array(r.approximation) - np.array(rows[r.vec_id][1])).max() < 0.2
