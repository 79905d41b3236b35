"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.byte_bpe import token_digests
from strata.llm.html_extract import extract
from strata.llm.language import document_languages, page_languages
from strata.llm.line_dedup import dedup_lines
from strata.llm.media import media_columns
from strata.llm.mixing import MIX_SQL, mix
from strata.llm.mtree import TOP_SQL, top_products
from strata.llm.packing import pack_documents
from strata.llm.simhash import near_duplicates
from strata.llm.substring_dedup import REPEATS_SQL, remove_repeats
from strata.llm.target_encoding import RATES_SQL, sale_rates
from strata.llm.url_filter import RULES, filter_urls, blocklist_labels
from strata.llm.vector_codes import CODES_SQL, compress


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), keep_draw=True)
    return mixed.select("doc_id", "source", "text", F.round("rate", 6).alias("rate"), "n_copies", "copy", "shuffle_key")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return filter_urls(pages, RULES, blocklist_labels(pages), folds=5)  # the labels come from the judged URLs


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(_table(spark, sf_dir, "documents"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op11_time_ordered_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_rates(*(_table(spark, sf_dir, n) for n in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


#: Lines as keys: split at \n, ASCII white space stripped, A-Z lower-cased; the SQL says the same over whole texts.
LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
g AS (SELECT l.r, count(*) AS n_lines, count(f.k) AS n_dropped,
  coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.r)
SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g ON d.r = g.r
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_source_mixing, op2_suffix_array_dedup, op3_url_filter, op4_html_extraction, op5_media_columns, op6_simhash_near_dedup, op7_best_fit_packing, op8_exact_top_k, op9_language_id, op10_line_dedup, op11_time_ordered_encoding, op12_vector_codes, op13_byte_bpe, page_language_id, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": MIX_SQL, "op2_suffix_array_dedup": REPEATS_SQL, "op8_exact_top_k": TOP_SQL, "op10_line_dedup": LINE_SQL, "op11_time_ordered_encoding": RATES_SQL, "op12_vector_codes": CODES_SQL}
