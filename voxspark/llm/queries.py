"""The queries opN_<name> over the given tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import lexical, line_dedup, packing, pstable, simhash, subword, suffix_dedup, suffix_tree, topk, toxicity, vector_codes, viterbi, warc
from ..scratch import Scratch, read_table


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = suffix_tree.score(docs, remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)))


def op2_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(read_table(spark, sf_dir, "embeddings"))


def with_held_out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_held_out(subword.classify(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"), scratch=scratch)
    records = scratch.keep(warc.read_archives(manifest).drop("payload", "uri", "position"), "records")
    warc.check_counts(records, manifest)
    return scratch.finish(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op7")
    return scratch.finish(suffix_dedup.digest(suffix_dedup.remove_repeats(docs, scratch=scratch)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_held_out(toxicity.classify(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = viterbi.round_trip(docs, default_pieces())
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.col("id_score").alias("score"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("item")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lines")
    return scratch.finish(line_dedup.digest(line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), scratch=scratch)))


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_pstable": op2_pstable,
    "op3_subword": op3_subword,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_lexical": op12_lexical,
    "op13_line_dedup": op13_line_dedup,
}

USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _terms(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _codes_sql(rounds: int = 2) -> str:
    """Rounds of assignment and means, each a step of its own; vectors of 64 components in 16 parts of 4."""
    dims = range(4)
    sql = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {USABLE}
), parts AS (
  SELECT vec_id, label, part, {", ".join(f"v[4 * part + {i + 1}] AS x{i}" for i in dims)} FROM kept, range(16) r(part)
), book0 AS (
  SELECT entry, part, {", ".join(f"x{i}" for i in dims)}
  FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
)"""
    distance = " + ".join(f"(p.x{i} - b.x{i}) * (p.x{i} - b.x{i})" for i in dims)
    for k in range(rounds + 1):
        sql += f""", near{k} AS (
  SELECT p.vec_id, p.label, part, min(ROW({distance}, entry)) AS best, {", ".join(f"any_value(p.x{i}) AS x{i}" for i in dims)}
  FROM parts p JOIN book{k} b USING (part) GROUP BY p.vec_id, p.label, part
)"""
        if k < rounds:
            sql += f""", book{k + 1} AS (
  SELECT b.entry, b.part, {", ".join(f"coalesce(CAST(floor(sum(n.x{i}) / count(n.x{i})) AS BIGINT), any_value(b.x{i})) AS x{i}" for i in dims)}
  FROM book{k} b LEFT JOIN near{k} n ON n.part = b.part AND n.best[2] = b.entry GROUP BY b.entry, b.part
)"""
    return sql + f""", coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


ORACLES: dict[str, str] = {
    "op2_pstable": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN many ON many.a = e.vec_id""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h""",
    "op6_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {USABLE}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_vector_codes": _codes_sql(),
    "op12_lexical": f"""
WITH d AS (
  SELECT doc_id, {_terms("text")} AS terms FROM documents WHERE len({_terms("text")}) > 0
), totals AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM d),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, unnest(list_distinct({_terms("text")})) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * t.docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), totals t GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
first AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN first USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
