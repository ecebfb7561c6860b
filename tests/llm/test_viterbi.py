import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from voxspark.llm.viterbi import SPACE_MARK, Encoder, Pieces, decode, decode_ids, encode, load, round_trip, stream, stream_many

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(text: str, p: Pieces):
    """Whole-text Viterbi, ties to the longer last piece."""
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for s in range(max(0, end - p.longest), end):
            known = p.by_text.get(text[s:end])
            if known is None and s == end - 1:
                known = (p.unknown(text[s]), p.unknown_score)
            if known and (best[end] is None or best[s][0] + known[1] > best[end][0]):
                best[end] = (best[s][0] + known[1], best[s][1] + (known[0] if isinstance(known[0], list) else [known[0]]))
    return best[-1][1], best[-1][0]


def whole(text):
    p = load(MODEL)
    return brute(SPACE_MARK + text.replace(" ", SPACE_MARK), p) if text else ([], 0.0)


@settings(max_examples=150, deadline=None)
@given(st.text("the ing\nandéß中\U0001f600▁\t1", max_size=120) | st.text(st.characters(exclude_categories=["Cs"]), max_size=50))
def test_encode_is_the_best_segmentation(text):
    p = load(MODEL)
    (ids, score), = Encoder(p).encode([text])
    assert (ids.tolist(), score) == whole(text)
    parts = list(stream(iter(SPACE_MARK + text.replace(" ", SPACE_MARK)), p)) if text else []
    assert [i for part, _ in parts for i in part] == ids.tolist()
    assert decode_ids(ids.tolist(), p) == text.replace(SPACE_MARK, " ")


def test_stream_commits_early():
    p = load(MODEL)
    text = "internationalization" * 400
    parts = list(stream(iter(text), p))
    assert len(parts) > 100 and [i for part, _ in parts for i in part] == brute(text, p)[0]
    read = 0

    def counted():
        nonlocal read
        for c in text:
            read += 1
            yield c

    behind = 0
    given = 0
    for ids, _ in stream(counted(), p):
        given += sum(len(p.shown[i].decode()) for i in ids)
        behind = max(behind, read - given)
    assert behind <= 3 * p.longest  # what is held back is bounded by the longest piece, not by the text


def test_every_word_goes_through_the_stream(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(150).collect()]
    encoder = Encoder(load(MODEL))
    got = encoder.encode(texts)
    assert encoder.streamed == len(encoder.known) > 1000 and encoder.early > 0
    for text, (ids, score) in list(zip(texts, got))[:12]:
        assert (ids.tolist(), score) == whole(text)


def test_small_vocabulary_with_ties():
    rng = random.Random(1)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(14)} | {"a"}
    p = Pieces({w: (k, float(-rng.randint(1, 3) * len(w))) for k, w in enumerate(sorted(words))}, [w.encode() for w in sorted(words)], [], 99, -50.0, 4)
    texts = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(200)]
    ids, sizes, scores, early = stream_many(texts, p)
    assert early > 300  # pieces that were final before their stream's end
    ends = sizes.cumsum()
    for t, end, n, s in zip(texts, ends, sizes, scores):
        assert (ids[end - n : end].tolist(), s) == brute(t, p)
        assert [i for part, _ in stream(iter(t), p) for i in part] == ids[end - n : end].tolist()


def test_same_as_library():
    """The library's own search over the same pieces, as a unigram model."""
    import sentencepiece

    spec = pytest.importorskip("sentencepiece.sentencepiece_model_pb2", exc_type=ImportError)
    proto = spec.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # scores that the library's single precision adds exactly
        if piece.score < -1e8:
            piece.score = -40_000
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choices("etaoinshrdluE.,", k=rng.randint(1, 12))) for _ in range(20))
        (ids, score), = Encoder(load(MODEL)).encode([text])
        theirs = sp.encode(text)
        assert sum(sp.get_score(i) for i in theirs) == score and sp.decode(ids.tolist()) == text


def test_tables(spark):
    rows = [(1, "Hello  wörld\n\nx", "en"), (2, None, None), (3, "", "de"), (None, "a" * 5000, "x"), (1, "Hello  wörld\n\nx", "en"), (4, "\U0001f600" * 3, "")]
    out = decode(encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.decoded, len(r.ids)) for r in out) == sorted((str(i), t or "", len(whole(t or "")[0])) for i, t, _ in rows)
    both = round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL)
    assert both.columns.count("ids") == 1 and sorted((str(r.doc_id), r.decoded, len(r.ids)) for r in both.collect()) == sorted((str(r.doc_id), r.decoded, len(r.ids)) for r in out)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
