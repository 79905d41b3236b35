"""The engine's tables, derived from the test tables, in Spark and as DuckDB common table expressions.

files takes documents with the vectors of the same number; segments, batches,
items and probes follow from their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import norm

CATEGORIES = [f"cat_{i}" for i in range(7)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    i = F.col("doc_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    score = (i * 37 % 100).cast("double") / 100
    category = F.when(i % 5 == 0, "傳送").when(i % 23 == 0, "未分類").otherwise(text("cat_", i % 7))
    return d.join(first, "sha").join(e, "doc_id", "left").select(
        i.alias("id"), F.concat(F.lit("doc_"), i.cast("string"), F.lit(".txt")).alias("name"), F.concat(category, F.lit("/doc_"), i.cast("string"), F.lit(".txt")).alias("path"),
        F.element_at(F.array(*(F.lit(k) for k in ("image", "video", "document", "other"))), (i % 4 + 1).cast("int")).alias("kind"), F.when(i % 5 == 0, "plain").otherwise("sort").alias("mode"),
        category.alias("category"), score.alias("score"), F.when(category == "未分類", F.when(i % 2 == 0, F.concat(F.lit("最像「"), text("cat_", i % 7), F.lit("」但不夠確定")))).when(i % 31 == 0, "截圖尺寸").otherwise("AI 判斷").alias("reason"), text("cat_", (i + 1) % 7).alias("second"), (score * ((i % 10).cast("double") / 10)).alias("second_score"),
        F.col("sha").alias("sha256"), F.col("n_chars").alias("size"), F.when(F.col("first") < i, F.col("first")).alias("duplicate_of"), F.when(i % 97 != 0, text("b", F.floor(i / 20))).alias("batch"),
        F.when(i % 29 != 0, F.concat(F.lit("2024-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"))).alias("taken"), (1704067200 + i * 60).cast("double").alias("received_at"),
        ((F.floor(i / 20) % 3 == 0) | (i % 2 == 0)).alias("reviewed"), (i % 11 == 0).alias("corrected"), (i % 13 == 0).alias("checked"), (i % 17 == 0).alias("removed"), F.when(i % 34 == 0, F.concat(F.lit("inbox/doc_"), i.cast("string"), F.lit(".txt"))).alias("prev_path"),
        F.when(i % 6 != 0, text("P", i % 3)).alias("place1"), F.when(i % 6 != 0, text("Q", i % 9)).alias("place2"), (i % 4 < 2).alias("geo"), "vec", F.col("text").alias("ocr"), norm("text").alias("ocr_n"),
        (i % 3).cast("int").alias("ocr_done"), (i % 2).cast("int").alias("seg_done"),
    )


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((F.floor(i / 8) * 4 + 1).alias("file_id"), (i % 8 * 4).cast("double").alias("t"), F.col("embedding").alias("vec"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("doc_id % 97 <> 0").groupBy(F.floor(F.col("doc_id") / 20).alias("b")).agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("count"))
    # every seventh batch has no stated start, every fifth was announced with one file more
    return own.select(
        F.concat(F.lit("b"), F.col("b").cast("string")).alias("id"), F.when(F.col("b") % 7 != 0, (1704067200 + F.col("m") * 60).cast("double")).alias("started_at"),
        F.concat(F.lit("sender_"), (F.col("b") % 4).cast("string")).alias("sender"), F.when(F.col("b") % 3 == 0, "plain").otherwise("sort").alias("mode"), (F.col("count") + (F.col("b") % 5 == 0).cast("int")).alias("count"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per file of batches whose number isn't divisible by three; the others are from before items were recorded."""
    i = F.col("doc_id")
    own = table(spark, sf_dir, "documents").where((i % 97 != 0) & (F.floor(i / 20) % 3 != 0))
    status = F.when(i % 41 == 0, "expected").when(i % 43 == 0, "received").when(i % 47 == 0, "failed").when(i % 53 == 0, "error").otherwise("indexed")
    return own.select(
        F.concat(F.lit("b"), F.floor(i / 20).cast("string")).alias("batch"), F.concat(F.lit("f"), i.cast("string")).alias("fid"), F.concat(F.lit("doc_"), i.cast("string"), F.lit(".txt")).alias("name"), status.alias("status"),
        F.when(status == "indexed", i).alias("file_id"), F.when(status.isin("failed", "error") & (i % 2 == 0), "disk full").alias("error"), F.when(i % 59 == 0, F.sha2(F.lit("another file"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), F.col("n_chars").alias("got_size"),
    )


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    i = F.col("id")
    return f.select("path", (i % 89 != 0).alias("exists"), F.when(i % 89 != 0, F.col("size") + (i % 83 == 0).cast("int")).alias("size"), (i % 79 != 0).alias("opens"), F.when(i % 89 != 0, F.col("sha256")).alias("sha256"))


SQL = """
d0 AS (SELECT doc_id, text, n_chars, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
files AS (SELECT doc_id AS id, 'doc_' || doc_id || '.txt' AS name,
  CASE WHEN doc_id % 5 = 0 THEN '傳送' WHEN doc_id % 23 = 0 THEN '未分類' ELSE 'cat_' || (doc_id % 7) END || '/doc_' || doc_id || '.txt' AS path,
  CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'document' ELSE 'other' END AS kind,
  CASE WHEN doc_id % 5 = 0 THEN 'plain' ELSE 'sort' END AS mode,
  CASE WHEN doc_id % 5 = 0 THEN '傳送' WHEN doc_id % 23 = 0 THEN '未分類' ELSE 'cat_' || (doc_id % 7) END AS category,
  (doc_id * 37 % 100)::DOUBLE / 100 AS score, CASE WHEN doc_id % 5 <> 0 AND doc_id % 23 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '最像「cat_' || (doc_id % 7) || '」但不夠確定' END WHEN doc_id % 31 = 0 THEN '截圖尺寸' ELSE 'AI 判斷' END AS reason, 'cat_' || ((doc_id + 1) % 7) AS second,
  (doc_id * 37 % 100)::DOUBLE / 100 * ((doc_id % 10)::DOUBLE / 10) AS second_score, sha AS sha256, n_chars AS size,
  CASE WHEN first_id < doc_id THEN first_id END AS duplicate_of, CASE WHEN doc_id % 97 <> 0 THEN 'b' || (doc_id // 20) END AS batch,
  CASE WHEN doc_id % 29 <> 0 THEN '2024-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') END AS taken, (1704067200 + doc_id * 60)::DOUBLE AS received_at,
  ((doc_id // 20) % 3 = 0 OR doc_id % 2 = 0) AS reviewed, doc_id % 11 = 0 AS corrected, doc_id % 13 = 0 AS checked, doc_id % 17 = 0 AS removed, CASE WHEN doc_id % 34 = 0 THEN 'inbox/doc_' || doc_id || '.txt' END AS prev_path,
  CASE WHEN doc_id % 6 <> 0 THEN 'P' || (doc_id % 3) END AS place1, CASE WHEN doc_id % 6 <> 0 THEN 'Q' || (doc_id % 9) END AS place2, doc_id % 4 < 2 AS geo,
  embedding::DOUBLE[] AS vec, text AS ocr,
  regexp_replace(lower(text), '[\\s,，、。.·:：;；''"「」『』()（）\\[\\]【】\\-_—~～|/\\\\]', '', 'g') AS ocr_n, (doc_id % 3)::INT AS ocr_done, (doc_id % 2)::INT AS seg_done
  FROM d0 LEFT JOIN embeddings ON vec_id = doc_id),
segs AS (SELECT (vec_id // 8) * 4 + 1 AS file_id, ((vec_id % 8) * 4)::DOUBLE AS t, embedding::DOUBLE[] AS vec FROM embeddings),
batches AS (SELECT 'b' || b AS id, CASE WHEN b % 7 <> 0 THEN (1704067200 + m * 60)::DOUBLE END AS started_at, 'sender_' || (b % 4) AS sender,
  CASE WHEN b % 3 = 0 THEN 'plain' ELSE 'sort' END AS mode, n + (b % 5 = 0)::INT AS count
  FROM (SELECT doc_id // 20 AS b, min(doc_id) AS m, count(*) AS n FROM documents WHERE doc_id % 97 <> 0 GROUP BY 1)),
items AS (SELECT *, CASE WHEN status = 'indexed' THEN doc_id END AS file_id, CASE WHEN status IN ('failed', 'error') AND doc_id % 2 = 0 THEN 'disk full' END AS error
  FROM (SELECT doc_id, 'b' || (doc_id // 20) AS batch, 'f' || doc_id AS fid, 'doc_' || doc_id || '.txt' AS name, CASE WHEN doc_id % 59 = 0 THEN sha256('another file') ELSE sha256(text) END AS sha256, n_chars AS got_size,
    CASE WHEN doc_id % 41 = 0 THEN 'expected' WHEN doc_id % 43 = 0 THEN 'received' WHEN doc_id % 47 = 0 THEN 'failed' WHEN doc_id % 53 = 0 THEN 'error' ELSE 'indexed' END AS status
    FROM documents WHERE doc_id % 97 <> 0 AND (doc_id // 20) % 3 <> 0)),
probe AS (SELECT path, id % 89 <> 0 AS exists_, CASE WHEN id % 89 <> 0 THEN size + (id % 83 = 0)::INT END AS size, id % 79 <> 0 AS opens, CASE WHEN id % 89 <> 0 THEN sha256 END AS sha256 FROM files),
live AS (SELECT * FROM files WHERE NOT removed)
"""


def sql(body: str) -> str:
    """A DuckDB query over the derived tables; further common table expressions may begin the body with a comma."""
    return f"WITH RECURSIVE {SQL}{body}" if body.lstrip().startswith(",") else f"WITH {SQL} {body}"
