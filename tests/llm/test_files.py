import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voxspark.llm import warc
from voxspark.llm.packing import PackParams, default_tokenizer, encoder, pack

PAGES = "page_id long, url string, html string, extra int"


def expected(rows):
    low = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            low[b] = min(i, low.get(b, i))
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        to = low.get(b)
        revisit = to is not None and to != i
        yield i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None


@pytest.mark.parametrize("split", [997, 8 << 20])
def test_archives(spark, split):
    rng = random.Random(1)
    texts = ["é" * 50, "x" * 99, "x" * 100, "", None, "WARC/1.1\r\n\r\n" * 30, *("".join(rng.choices("abc<>é\n", k=rng.randint(0, 4000))) for _ in range(60))]
    rows = [(i, f"http://a/{i}\n b" if i % 7 else None, rng.choice(texts), 1) for i in range(200)] + [(None, "u", "x" * 100, 1), (3, "u", "x" * 100, None), (500, "u", "\U0001f600" * 300_000, None)]
    rng.shuffle(rows)
    p = warc.WarcParams(split_bytes=split, block_bytes=1024)
    df = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), p), p)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.drop("payload").collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).collect() == []


def archive(spark, n=30):
    rows = [(i, "u", f"page {i} " * 40, 1) for i in range(n)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1))
    row = manifest.first()
    return manifest, row.path.removeprefix("file://").removeprefix("file:")


def members(data: bytes) -> list[int]:
    """Where the records of a sound archive begin."""
    out, at = [], 0
    while at < len(data):
        out.append(at)
        z = zlib.decompressobj(31)
        z.decompress(data[at:])
        at = len(data) - len(z.unused_data)
    return out


@pytest.mark.parametrize("split", [333, 8 << 20])
def test_damaged_archives_are_reported(spark, split):
    manifest, path = archive(spark)
    p = warc.WarcParams(split_bytes=split, block_bytes=512)
    with open(path, "rb") as f:
        data = f.read()
    assert warc.read_archives(manifest, p).count() == 30
    begin = members(data)
    flip = lambda at: data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    bad = {
        "a wrong checksum": flip(begin[1] - 8), "a cut-off end": data[:-5], "a cut in the last header": data[: begin[-1] + 6], "a cut in the last magic": data[: begin[-1] + 2],
        "the first magic": flip(0), "a magic": flip(begin[7]), "the last magic": flip(begin[-1] + 1), "a header's first block": flip(begin[9] + 12), "bytes after the end": data + b"x", "bytes between": data[: begin[4]] + b"\x1f\x8b" + data[begin[4] :],
    }
    for name, content in bad.items():
        with open(path, "wb") as f:
            f.write(content)
        with pytest.raises(Exception, match="damaged or cut off|doesn't match"):
            warc.read_archives(manifest.withColumn("size", manifest["size"] * 0 + len(content)), p).collect()
            pytest.fail(name)
    for short in (len(data) - 5, begin[-1], 0):  # shorter than the manifest says
        with open(path, "wb") as f:
            f.write(data[:short])
        with pytest.raises(Exception, match="before the .* bytes of its manifest"):
            warc.read_archives(manifest, p).collect()


def test_missing_records_are_counted(spark):
    manifest, path = archive(spark)
    records = warc.read_archives(manifest).select("path").cache()
    warc.check_counts(records, manifest)
    with pytest.raises(ValueError, match="has 29 records, its manifest says 30"):
        warc.check_counts(records.limit(29), manifest)
    with pytest.raises(ValueError, match="has 0 records"):
        warc.check_counts(records.limit(0), manifest)


def test_very_many_copies(spark):
    rows = [(i, "u", "x" * 200 if i % 3 else f"page {i % 50} " * 30, 1) for i in range(2000)]
    for share in (2, 1000):
        df = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), warc.WarcParams(hot_share=share)))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.drop("payload").collect()), key=str) == sorted(expected(rows), key=str)


def test_a_large_member_is_read_in_blocks():
    text = bytes(random.Random(1).choices(range(256), k=3 << 20))
    data = warc.gzip_member(warc.record(1, "u", text, hashlib.sha256(text).hexdigest(), None, warc.WarcParams()), 0)
    assert [warc.parse(r)["payload"] for _, r in warc.scan(_Bytes(data), len(data), 0, len(data), 1 << 10)] == [text]


def test_splits_are_read_by_as_many_tasks(spark):
    manifest, _ = archive(spark, 200)
    df = warc.read_archives(manifest, warc.WarcParams(split_bytes=1 << 10))
    n = -(-manifest.first()["size"] // (1 << 10))
    assert n > 8 and df.rdd.getNumPartitions() >= n // 2 and df.count() == 200


def test_pages_with_clashing_names(spark):
    rows = [(1, "u", "x" * 120, 1, "a", 2), (2, "u", "x" * 120, 1, "b", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, refers_to string, first int")
    assert {(r.page_id, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect()} == {(1, None), (2, 1)}


class _Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_every_split_owns_what_begins_in_it():
    rng = random.Random(2)
    records = [warc.record(i, "u", bytes(rng.choices(warc.MAGIC + b"ab", k=rng.randint(0, 300))), "d", None, warc.WarcParams()) for i in range(40)]
    data = b"".join(warc.gzip_member(r, rng.choice((0, 6))) for r in records)
    for step in (1, 7, 100, 4000):
        found = [r for s in range(0, len(data), step) for _, r in warc.scan(_Bytes(data), len(data), s, min(len(data), s + step), 64)]
        assert found == records


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("a 's\n\t 1<|endoftext|>é中", max_size=80) | st.just("x<|endoftext|> y<|endoftext|>"))
def test_same_ids_as_tokenizers(reference, text):
    assert encoder(default_tokenizer())(text).tolist() == reference.encode(text, add_special_tokens=False).ids


LONG = {
    "spaces": " " * 1_100_000,
    "newlines between words": "a" + "\n" * 1_000_001 + "b",
    "irregular": "".join(random.Random(5).choices(" \t\n\u00a0\r", k=1_200_000)) + "x",
    "one word": "ab" * 300_000,
    "other signs": "!?" * 300_000,
    "text around": "The word. " * 1000 + " \n" * 700_000 + " and more <|endoftext|> words" * 1000,
}


@pytest.mark.parametrize("name", LONG)
def test_same_ids_for_very_long_runs(reference, name):
    assert encoder(default_tokenizer())(LONG[name]).tolist() == reference.encode(LONG[name], add_special_tokens=False).ids


def test_packing_of_very_long_texts(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(LONG.values())] + [(100, "a b", "y")]
    out, _ = packed(spark, rows)
    tokens = {r.doc_id: r.doc_tokens for r in out}
    assert tokens == {i: len(reference.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    assert sum(r.length for r in out) == sum(tokens.values())


def test_packing_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, "s"), (2, "c", 1, 2, "s")], "doc_id long, text string, task int, sequence_id int, group string")
    assert sorted((r.doc_id, r.doc_tokens) for r in pack(df).collect()) == [(1, 3), (2, 2)]


def packed(spark, rows, **params):
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), PackParams(**params)).collect()
    size = params.get("size", 1024)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    return out, sequences


def test_packing(spark, reference):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "of", "Straße", "x1", "\n"], k=rng.randint(0, 400))), None) for i in range(150)] + [(900, None, "en"), (901, "", "en"), (902, "a" * 20_000, "en")]
    for params in ({"size": 64, "windows": 4, "keep_ids": True}, {"keep_ids": True}):
        out, sequences = packed(spark, rows, **params)
        ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
        parts = defaultdict(list)
        for r in out:
            got = np.frombuffer(r.ids, dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(got) == r.length and r.doc_tokens == len(ids[r.doc_id])
            parts[r.doc_id].append((r.start, got.tolist()))
        assert {i: sum((p for _, p in sorted(ps)), []) for i, ps in parts.items()} == ids
        assert len(sequences) <= -(-sum(map(len, ids.values())) // params.get("size", 1024)) + len(sequences) // 50 + 1


def test_packing_odd_ids(spark):
    out, _ = packed(spark, [(None, "a b", "x"), (None, "a b", "x"), (1, "c", "x"), (1, "c", "x")])
    assert sorted((str(r.doc_id), r.length) for r in out) == [("1", 2), ("1", 2), ("None", 3), ("None", 3)]
    assert packed(spark, [])[0] == []
