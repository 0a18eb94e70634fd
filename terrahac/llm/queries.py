"""The queries of this subpackage, one per operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahac.llm import lbl_lm, license_scan, ppm_langid, site_tree, token_count, topk, warc
from terrahac.llm.chosen_path import similar_documents
from terrahac.llm.common import held_out, table
from terrahac.llm.decontaminate import decontaminate
from terrahac.llm.sp_codec import encode_decode

#: Folder of the public vocabulary files; None asks the installed package.
TOKENIZERS: str | None = None

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3 of the pipeline: contaminated documents go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=tuple(docs.columns)).filter("not contaminated").select(*docs.columns)


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), dwin AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, dwin.n AS n, i FROM dwin JOIN win ON dwin.n = win.n AND dwin.k = win.k
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), n_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), *token_count.pieces_of(vocabulary("piece_bpe_32k.model")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""


def op5_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2 of the pipeline: of each group of near-duplicate rows one of the smallest id stays.

    Where ids repeat or are null, rows are told apart by a number of their own, and null ids come
    after all others; texts without words are in no group and stay.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        gone = similar_documents(docs).filter("doc_id <> class_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = similar_documents(rows.select(F.col("__row").alias("doc_id"), "text"))
    found = table(found.select(F.col("doc_id").alias("__row"), "class_id"), "classes-of-rows")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")
    stays = found.join(rows.select("__row", "doc_id"), "__row").groupBy("class_id").agg(F.min(order).alias("stays"))
    gone = found.join(stays, "class_id").filter("__row <> stays.__row").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


OP5_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, link.b FROM reach r JOIN link ON link.a = r.other
), class AS (
  SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id
), links AS (
  SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM class LEFT JOIN links USING (doc_id)
"""


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.scores(read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def language_model(docs: DataFrame) -> ppm_langid.Model | None:
    return ppm_langid.train(docs.filter(~held_out("doc_id", 4) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = ppm_langid.identify(docs, language_model(docs))
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1 of the pipeline: documents without a recognisable language go."""
    out = ppm_langid.identify(docs, language_model(docs), keep=tuple(docs.columns))
    return out.filter("lang_pred <> 'und'").select(*docs.columns)


def op9_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4 of the pipeline and the whole of op9."""
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        return encode_decode(docs, f.read())


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_encoded(spark, read(spark, sf_dir, "documents"), sf_dir)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_token_counts": op2_token_counts,
        "op3_licenses": op3_licenses,
        "op4_warc": op4_warc,
        "op5_similar": op5_similar,
        "op6_lm_scores": op6_lm_scores,
        "op7_topk": op7_topk,
        "op8_language_id": op8_language_id,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_main_text": op10_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op3_licenses": license_scan.oracle_sql(),
        "op4_warc": OP4_SQL,
        "op5_similar": OP5_SQL,
        "op7_topk": OP7_SQL,
    }
