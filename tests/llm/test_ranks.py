import random

import numpy as np
import pyarrow as pa
import pytest

from voxspark.llm.chunks import SENT, with_replies
from voxspark.llm.ranks import again, pack_strings, rank_bytes, rank_strings, shared_ranks, strings, unpack_ranks
from voxspark.llm.suffix_dedup import RepeatParams, _Parse


def held_by(seed: int) -> list[list[bytes]]:
    rng = random.Random(seed)
    return [[bytes(rng.choices([0, 1, 97, 98, 255], k=rng.randint(1, 6))) for _ in range(n)] for n in (300, 1, 80)]


@pytest.fixture
def ranked(spark):
    def run(held, splits, answer):
        frames, inverse = zip(*(pack_strings("t", c, pa.array(h, pa.large_binary()), splits) for c, h in enumerate(held)))
        sent = spark.createDataFrame([tuple(r) for f in frames for r in f.itertuples(index=False)], SENT)
        chunks = spark.createDataFrame([(c,) for c in range(len(held))], "chunk long")
        rows = with_replies(chunks, 4, t=rank_strings(sent, answer)).collect()
        return {r.chunk: [x[inverse[r.chunk]] for x in unpack_ranks(r.t)] for r in rows}

    return run


def test_ranks_order_as_the_bytes_do(ranked):
    held = held_by(1)
    got = ranked(held, [b"\x01", b"a\x00", b"b"], again)
    pairs = {(s, int(r)) for c, h in enumerate(held) for s, r in zip(h, got[c][0])}
    assert len({s for s, _ in pairs}) == len({r for _, r in pairs}) == len(pairs)  # one rank for each string
    assert [s for s, _ in sorted(pairs, key=lambda x: x[1])] == sorted(s for s, _ in pairs)
    everything = [s for h in held for s in h]
    assert all(bool(m) == (everything.count(s) > 1) for c, h in enumerate(held) for s, m in zip(h, got[c][1]))


def test_neighbours_tell_how_many_ranks_are_shared(ranked):
    rng = random.Random(2)
    held = [[[rng.choice([1, 2, 3 << 32, 3 << 32 | 1]) for _ in range(rng.randint(1, 7))] for _ in range(n)] for n in (40, 30)]
    got = ranked([[rank_bytes(np.array(s, dtype=np.uint64)).tobytes() for s in h] for h in held], 4, shared_ranks)
    places = [(c, k) for c, h in enumerate(held) for k in range(len(h))]
    for c, k in places:
        mine, others = held[c][k], [held[x][y] for x, y in places if (x, y) != (c, k)]
        assert got[c][1][k] == max(d for d in range(len(mine) + 1) if not d or any(o[:d] == mine[:d] for o in others))


def test_no_phrase_is_a_prefix_of_another():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 900))).encode() for _ in range(30)]
    c = _Parse(np.array([len(t) for t in texts], dtype=np.int64).tobytes(), RepeatParams(trigger_bytes=4, trigger_modulus=8), b"".join(texts))
    phrases = sorted({s for s, closed in zip(c.phrases().to_pylist(), c.closed) if closed})
    assert len(phrases) > 100 and not any(b.startswith(a) for a, b in zip(phrases, phrases[1:]))


def test_slices_are_joined():
    buffer = np.frombuffer(b"abcdefgh", dtype=np.uint8)
    got = strings(buffer, (np.array([0, 5]), np.array([2, 0])), (np.array([6, 3]), np.array([1, 4])))
    assert got.to_pylist() == [b"abg", b"defg"]
    assert strings(buffer, (np.empty(0, dtype=int), np.empty(0, dtype=int))).to_pylist() == []
