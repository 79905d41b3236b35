"""The engine's queries over the derived tables, by name, each with the same query in DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.constants import DUPLICATE, PLAIN
from strata.functions import arrays, media, messages, text, vectors
from strata.operators import audit, categories, classify, dedupe, export, filters, geo, ingest, mutate, recovery, rollups, search
from strata.operators.filters import Filter
from strata.plans import fixtures as fx
from strata.plans.fixtures import sql
from strata.sources import media_files, media_ranges
from strata.sources.shared import shared_dir

DIM = 64  # of the test vectors
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return keep


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> DataFrame:
    """One row: the vector asked for."""
    return fx.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("__q")).limit(1)


def with_query(df: DataFrame, q: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(q))  # one row


CAT = "CASE WHEN duplicate_of IS NOT NULL THEN '疑似重複' WHEN coalesce(category, '') = '' THEN '未知' ELSE category END"

# ---- scans and lookups


@query("SELECT count(*) AS n, sum(size)::BIGINT AS size FROM live")
def s1_live_scan(spark, d):
    return filters.live(fx.files(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("SELECT id, name, kind, category FROM files WHERE id = 42")
def s2_point_lookup(spark, d):
    return filters.get(fx.files(spark, d), 42).select("id", "name", "kind", "category")


WANTED = [30, 7, 999999, 7, 51, 3]


@query(f"SELECT (i - 1)::INT AS pos, f.id, f.name FROM (SELECT unnest({WANTED}) AS id, generate_subscripts({WANTED}, 1) AS i) w JOIN files f USING (id)")
def s3_multi_get(spark, d):
    return filters.multi_get(fx.files(spark, d), WANTED).select("pos", "id", "name")


@query("SELECT min(id) AS id FROM live WHERE sha256 = (SELECT sha256 FROM files WHERE id = 11)")
def s4_hash_lookup(spark, d):
    f = fx.files(spark, d)
    return filters.by_hash(f, f.where("id = 11").select("sha256").first()[0]).select("id")


@query("SELECT count(*) > 0 AS found FROM files WHERE path = 'cat_3/doc_3.txt'")
def s5_path_exists(spark, d):
    return filters.has_path(fx.files(spark, d), "cat_3/doc_3.txt")


@query("SELECT id, name FROM live ORDER BY id DESC LIMIT 50")
def s6_recent(spark, d):
    return filters.recent(fx.files(spark, d)).select("id", "name")


@query("SELECT id FROM live WHERE batch IS NULL")
def s7_legacy_batch(spark, d):
    return filters.batch_files(fx.files(spark, d), None).select("id")


@query("""SELECT id, CASE WHEN e IN ('jpg','jpeg','png','heic','heif','webp','bmp','gif','tif','tiff') THEN 'image' WHEN e IN ('mov','mp4','m4v','avi','mkv','3gp','webm') THEN 'video'
  WHEN e IN ('pdf','docx','txt','md','csv','rtf') THEN 'document' ELSE 'other' END AS kind
  FROM (SELECT id, (['jpg','mov','pdf','xyz','heic','webm','md','zip'])[1 + id % 8] AS e FROM files)""")
def s8_kind_of(spark, d):
    exts = F.array(*(F.lit(x) for x in ("JPG", "mov", "Pdf", "xyz", "heic", "WEBM", "md", "zip")))
    named = fx.files(spark, d).select("id", F.concat(F.lit("dir.d/n."), F.element_at(exts, (F.col("id") % 8 + 1).cast("int"))).alias("p"))
    return named.select("id", text.kind_of(F.col("p")).alias("kind"))


# ---- facets and work lists

LISTINGS = {
    "f1_facets_category": (Filter(cat="cat_3", kind="image"), "category = 'cat_3' AND duplicate_of IS NULL AND mode = 'sort' AND kind = 'image'"),
    "f1_facets_duplicates": (Filter(cat=DUPLICATE), "duplicate_of IS NOT NULL"),
    "f1_facets_plain": (Filter(cat=PLAIN, date_to="2024-06-30"), "mode = 'plain' AND taken <= '2024-06'"),
    "f1_facets_place": (Filter(place="P1|Q4", date_from="2024-02-01", date_to="2024-11"), "place1 = 'P1' AND place2 = 'Q4' AND taken >= '2024-02' AND taken <= '2024-11'"),
    "f1_facets_no_place": (Filter(place="-", kind="image"), "place1 IS NULL AND kind = 'image'"),
}
for _name, (_filter, _where) in LISTINGS.items():
    QUERIES[_name] = lambda spark, d, f=_filter: filters.listing(fx.files(spark, d), f).select("id", "taken")
    ORACLES[_name] = sql(f"SELECT id, taken FROM live WHERE {_where} ORDER BY coalesce(taken, '') DESC, id DESC LIMIT 300")


@query("SELECT id, taken, category FROM live ORDER BY coalesce(taken, '') DESC, id DESC LIMIT 300")
def f2_filter_listing(spark, d):
    return filters.listing(fx.files(spark, d), Filter()).select("id", "taken", "category")


@query("SELECT id, taken FROM live WHERE contains(ocr_n, 'theaner') ORDER BY coalesce(taken, '') DESC, id DESC LIMIT 200")
def f3_text_hits(spark, d):
    return search.text_hits(fx.files(spark, d), "The, aner").select("id", "taken")


@query("""SELECT q, id, taken FROM (VALUES (0, 'theaner'), (1, 'ing'), (2, 'query')) AS w(q, wanted), live WHERE contains(ocr_n, wanted)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY coalesce(taken, '') DESC, id DESC) <= 200""")
def f3_text_index(spark, d):
    """Three text searches at once through the index of character pairs."""
    from strata.operators.text_index import TextIndex
    from strata.streaming.ingest import stream_dir

    root = stream_dir(spark)
    ranged = fx.files(spark, d).select("id", "taken", "removed", "ocr").repartitionByRange("id").sortWithinPartitions("id")  # its sample runs over the rows once more, so texts are normalised after it
    ranged.select("id", "taken", "removed", text.norm("ocr").alias("ocr_n")).write.parquet(f"{root}/files")
    own, index = spark.read.parquet(f"{root}/files"), TextIndex(spark, f"{root}/index")
    index.add(own)
    return index.hits(own, ["The, aner", "ing", "Query"]).select("q", "id", "taken")


@query("SELECT id FROM live WHERE ocr_done = 0 AND kind IN ('image', 'document') AND (mode = 'sort' OR vec IS NOT NULL) ORDER BY id DESC LIMIT 10")
def f4_enrich_list(spark, d):
    return filters.enrich_list(fx.files(spark, d)).select("id")


@query("SELECT id FROM live WHERE id % 10 = 1 AND vec IS NOT NULL OR id IN (SELECT file_id FROM segs WHERE (file_id + t::BIGINT) % 7 = 0) AND NOT removed")
def f5_stale(spark, d):
    f = fx.files(spark, d).withColumn("vec", F.when(F.col("id") % 10 == 1, F.slice("vec", 1, 32)).otherwise(F.col("vec")))
    s = fx.segs(spark, d).withColumn("vec", F.when((F.col("file_id") + F.col("t").cast("long")) % 7 == 0, F.slice("vec", 1, 8)).otherwise(F.col("vec")))
    return filters.stale(f, s, DIM)


@query("SELECT id FROM live WHERE mode = 'plain' AND vec IS NULL")
def f6_unindexed_plain(spark, d):
    return filters.unindexed_plain(fx.files(spark, d)).select("id")


@query("SELECT id FROM live WHERE mode = 'sort' AND vec IS NOT NULL AND NOT corrected AND NOT reviewed AND duplicate_of IS NULL AND kind IN ('image', 'video')")
def f7_reclassifiable(spark, d):
    return filters.reclassifiable(fx.files(spark, d)).select("id")


@query("SELECT id FROM live WHERE NOT coalesce(geo, false) OR taken IS NULL")
def f8_needs_place(spark, d):
    return filters.needs_place(fx.files(spark, d)).select("id")


SHOTS = ["Screenshot_1.jpg", "IMG_1.png", "截圖 3.jpg", "photo.jpeg"]


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 4 IN (0, 2) THEN '截圖檔名' WHEN id % 8 < 4 THEN '截圖尺寸' END AS shot FROM files""")
def f9_screenshot_rule(spark, d):
    i = F.col("id")
    named = fx.files(spark, d).select("id", F.element_at(F.array(*(F.lit(x) for x in SHOTS)), (i % 4 + 1).cast("int")).alias("name"), F.when(i % 2 == 1, "png").otherwise("jpeg").alias("fmt"), F.when(i % 8 < 4, 2532).otherwise(2500).alias("w"), F.lit(1170).alias("h"), (i % 3 == 0).alias("camera"))
    return named.select("id", filters.screenshot_reason("name", "fmt", "w", "h", "camera").alias("shot"))


# ---- aggregations


@query(f"SELECT {CAT} AS category, count(*) AS n FROM live GROUP BY 1")
def a1_category_counts(spark, d):
    return rollups.category_counts(fx.files(spark, d))


@query(f"SELECT {CAT} AS category, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN id % 50 = 3 THEN 'moved' ELSE category END AS category) FROM live WHERE id % 50 <> 7) GROUP BY 1")
def a1_kept_counts(spark, d):
    """Counts by category that follow a change of some rows and the removal of others."""
    from strata.operators import kept

    f = fx.files(spark, d).select("id", "category", "duplicate_of", "removed")
    old = f.where("id % 50 IN (3, 7)")
    new = old.withColumns({"category": F.when(F.col("id") % 50 == 3, F.lit("moved")).otherwise(F.col("category")), "removed": F.col("removed") | (F.col("id") % 50 == 7)})
    return kept.folded(rollups.category_counts(f), "category_counts", old, new)


@query("SELECT count(*) AS total, coalesce(sum(size), 0)::BIGINT AS used FROM live")
def a2_home_totals(spark, d):
    return rollups.totals(fx.files(spark, d))


@query("SELECT category, count(*) AS n FROM live WHERE duplicate_of IS NULL GROUP BY 1")
def a3_home_categories(spark, d):
    return rollups.home_categories(fx.files(spark, d))


@query("""SELECT category, row_number() OVER (PARTITION BY category ORDER BY r)::INT AS pos, id FROM
  (SELECT category, id, path, row_number() OVER (PARTITION BY category ORDER BY (kind = 'image') DESC, id DESC) AS r FROM live WHERE duplicate_of IS NULL AND kind IN ('image', 'video'))
  JOIN probe USING (path) WHERE r <= 12 AND exists_ QUALIFY pos <= 4""")
def a4_covers(spark, d):
    f = fx.files(spark, d)
    present = f.join(fx.probe(spark, d).where("exists"), "path", "left_semi")
    return rollups.covers(f, present)


@query("""SELECT batch, started_at, count(*) AS total, count_if(kind = 'image')::BIGINT AS images, count_if(kind = 'video')::BIGINT AS videos, count_if(kind NOT IN ('image', 'video'))::BIGINT AS others,
  array_to_string((list(id ORDER BY id) FILTER (kind IN ('image', 'video')))[1:6], ',') AS thumbs
  FROM live JOIN (SELECT id AS batch, started_at FROM batches WHERE id IN (SELECT batch FROM live) ORDER BY started_at DESC NULLS LAST, id LIMIT 1) USING (batch) GROUP BY 1, 2""")
def a5_last_batch(spark, d):
    return rollups.last_batch(fx.files(spark, d), fx.batches(spark, d))


@query("""SELECT place1 AS p1, sum(count(*)) OVER (PARTITION BY place1)::BIGINT AS total, place2 AS p2, count(*) AS n FROM live WHERE place1 IS NOT NULL GROUP BY place1, place2""")
def q7_places(spark, d):
    return rollups.places(fx.files(spark, d))


@query("SELECT count(*) AS none FROM live WHERE place1 IS NULL AND geo AND kind IN ('image', 'video')")
def a7_places_none(spark, d):
    return rollups.without_place(fx.files(spark, d))


@query("SELECT coalesce(taken, '') AS month, count(*) AS n FROM live GROUP BY 1")
def a8_timeline_months(spark, d):
    return rollups.month_counts(fx.files(spark, d))


@query("""SELECT month, (row_number() OVER (PARTITION BY month ORDER BY n DESC, place))::INT AS pos, place, n FROM
  (SELECT coalesce(taken, '') AS month, coalesce(place2, place1) AS place, count(*) AS n FROM live WHERE place1 IS NOT NULL GROUP BY 1, 2) QUALIFY pos <= 3""")
def w3_month_places(spark, d):
    return rollups.month_places(fx.files(spark, d))


@query("SELECT coalesce(taken, '') AS month, (row_number() OVER (PARTITION BY taken ORDER BY id DESC))::INT AS pos, id FROM live QUALIFY pos <= 12")
def w2_month_files(spark, d):
    return rollups.month_files(fx.files(spark, d))


@query("""SELECT month, count(*) AS n, array_to_string((list(id ORDER BY id DESC))[1:12], ',') AS files, coalesce(any_value(p), '') AS places FROM
  (SELECT id, coalesce(taken, '') AS month FROM live WHERE kind = 'image') LEFT JOIN
  (SELECT m2, string_agg(place, ',' ORDER BY n DESC, place) AS p FROM
    (SELECT *, row_number() OVER (PARTITION BY m2 ORDER BY n DESC, place) AS r FROM
      (SELECT coalesce(taken, '') AS m2, coalesce(place2, place1) AS place, count(*) AS n FROM live WHERE place1 IS NOT NULL AND kind = 'image' GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1) ON m2 = month GROUP BY 1""")
def q6_timeline(spark, d):
    return rollups.timeline(fx.files(spark, d), Filter(kind="image"))


@query("""SELECT count_if(ocr_done = 0 AND kind IN ('image', 'document') AND (mode = 'sort' OR vec IS NOT NULL))::BIGINT AS texts,
  count_if(seg_done = 0 AND kind = 'video' AND (mode = 'sort' OR vec IS NOT NULL))::BIGINT AS videos FROM live""")
def a10_enrich_left(spark, d):
    return rollups.enrich_left(fx.files(spark, d))


@query("SELECT (SELECT count(*) FROM files WHERE vec IS NOT NULL AND id % 10 = 1) AS files, (SELECT count(DISTINCT file_id) FROM segs WHERE t > 20) AS videos")
def a11_stale_counts(spark, d):
    f = fx.files(spark, d).withColumn("vec", F.when(F.col("id") % 10 == 1, F.slice("vec", 1, 32)).otherwise(F.col("vec")))
    return rollups.stale_counts(f, fx.segs(spark, d).withColumn("vec", F.when(F.col("t") > 20, F.slice("vec", 1, 8)).otherwise(F.col("vec"))), DIM)


@query("SELECT len(vec)::INT AS dim, count(*) AS n FROM files WHERE vec IS NOT NULL GROUP BY 1 ORDER BY n DESC, dim LIMIT 1")
def a12_modal_dim(spark, d):
    return rollups.modal_dim(fx.files(spark, d))


@query("SELECT file_id, count(*) AS n FROM segs GROUP BY 1")
def a15_segment_counts(spark, d):
    return rollups.segment_counts(fx.segs(spark, d))


PROTO_SQL = """, pm AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
pv AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) + 1e-9 AS n FROM pm GROUP BY 1),
protos AS (SELECT 'cat_' || label AS name, list_transform(v, lambda x: x / n) AS vec FROM pv)
"""


def _protos(spark, d):
    return classify.prototypes(fx.table(spark, d, "embeddings").select(F.concat(F.lit("cat_"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("vec")))


@query(PROTO_SQL + "SELECT name, (generate_subscripts(vec, 1) - 1)::INT AS pos, round(unnest(vec), 6) AS x FROM protos")
def a16_mean_vector(spark, d):
    return _protos(spark, d).select("name", F.posexplode("vec").alias("pos", "x")).select("name", "pos", F.round("x", 6).alias("x"))


@query("SELECT greatest(coalesce(max(id), 0), 5) + 1 AS id FROM files")
def a20_next_id(spark, d):
    return mutate.next_id(fx.files(spark, d), 5)


# ---- search

RANKED_SQL = """, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
sb AS (SELECT file_id, s, t FROM (SELECT file_id, t, list_dot_product(vec, q) AS s FROM segs, q) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY s DESC, t) = 1),
sc AS (SELECT l.*, greatest(list_dot_product(vec, q), CASE WHEN kind = 'video' THEN s END) AS sim, CASE WHEN kind = 'video' AND s > list_dot_product(vec, q) THEN t END AS seg_t FROM live l CROSS JOIN q LEFT JOIN sb ON sb.file_id = l.id WHERE vec IS NOT NULL)
"""


@query(RANKED_SQL + "SELECT id, round(sim, 6) AS sim, seg_t AS t FROM sc ORDER BY sim DESC, id LIMIT 60")
def q3_ranked(spark, d):
    q = query_vector(spark, d)
    top = search.ranked(with_query(fx.files(spark, d), q), with_query(fx.segs(spark, d), q), F.col("__q"), DIM)
    return top.select("id", F.round("sim", 6).alias("sim"), "t")


@query(RANKED_SQL + "SELECT id, round(sim, 6) AS sim, seg_t AS t FROM sc ORDER BY sim DESC, id LIMIT 60")
def q3_two_pass(spark, d):
    """q3_ranked from tables with codes: whole vectors are read of candidates alone."""
    from strata.operators import two_pass
    from strata.streaming.ingest import stream_dir

    root = stream_dir(spark)
    for name, table, key in (("files", fx.files(spark, d).select("id", "kind", "removed", "vec"), "id"), ("segs", fx.segs(spark, d), "file_id")):
        two_pass.with_codes(table).repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{root}/{name}")
    asked = query_vector(spark, d).first()["__q"]
    return two_pass.ranked_by_codes(spark.read.parquet(f"{root}/files"), spark.read.parquet(f"{root}/segs"), asked).select("id", F.round("sim", 6).alias("sim"), "t")


@query(RANKED_SQL.replace("vec_id = 7", "vec_id = 12") + "SELECT id, round(sim, 6) AS sim FROM sc WHERE id <> 12 AND category = 'cat_2' AND duplicate_of IS NULL AND mode = 'sort' ORDER BY sim DESC, id LIMIT 60")
def q4_similar(spark, d):
    return search.similar(fx.files(spark, d), fx.segs(spark, d), 12, DIM, Filter(cat="cat_2")).select("id", F.round("sim", 6).alias("sim"))


@query(RANKED_SQL + """, h AS (SELECT id, coalesce(taken, '') AS tk FROM live WHERE contains(ocr_n, 'theaner') AND kind = 'image' ORDER BY tk DESC, id DESC LIMIT 200),
s2 AS (SELECT id, sim, seg_t FROM sc WHERE kind = 'image' AND id NOT IN (SELECT id FROM h) ORDER BY sim DESC, id LIMIT 60)
SELECT 0 AS section, row_number() OVER (ORDER BY tk DESC, id DESC)::INT AS rank, id, NULL::DOUBLE AS sim FROM h UNION ALL
SELECT 1, row_number() OVER (ORDER BY sim DESC, id)::INT, id, round(sim, 6) FROM s2""")
def q1_hybrid_search(spark, d):
    q = query_vector(spark, d)
    found = search.search(with_query(fx.files(spark, d), q), with_query(fx.segs(spark, d), q), "the aner", F.col("__q"), DIM, Filter(kind="image"))
    return found.select("section", "rank", "id", "sim")


@query("SELECT id, 'list' AS hit, round_even(score, 3) AS score, length(ocr) > 0 AS has_text FROM live WHERE kind = 'document' ORDER BY coalesce(taken, '') DESC, id DESC LIMIT 40")
def q1_listing(spark, d):
    return search.search(fx.files(spark, d), fx.segs(spark, d), "", None, DIM, Filter(kind="document"), limit=40).select("id", "hit", "score", "has_text")


@query()
def q2_snippets(spark, d):
    hits = search.with_snippets(search.text_hits(fx.files(spark, d), "the aner"), "the aner")
    return hits.select("id", "snip.text", "snip.a", "snip.b")


@query(", s AS (SELECT file_id AS id, t, list_dot_product(vec, e.embedding::DOUBLE[]) AS s FROM segs, (SELECT embedding FROM embeddings WHERE vec_id = 7) e) SELECT id, round(s, 6) AS seg_score, t FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, t) = 1")
def w1_best_segment(spark, d):
    q = query_vector(spark, d)
    return search.best_segments(with_query(fx.segs(spark, d), q), F.col("__q"), DIM).select("id", F.round("seg_score", 6).alias("seg_score"), "t")


@query(""", p AS (SELECT a.id, b.id AS other, list_dot_product(a.vec, b.vec) AS s FROM live a JOIN live b ON b.id < a.id AND a.kind = 'image' AND b.kind = 'image' WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL)
SELECT id, other, round(s, 6) AS sim FROM p WHERE s >= 0.35 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) = 1""")
def j10_near_pairs(spark, d):
    return search.near_pairs(fx.files(spark, d), 0.35, DIM).select("id", "other", F.round("sim", 6).alias("sim"))


@query("""SELECT f.id, min(o.id) AS original FROM files f JOIN live o ON o.sha256 = f.sha256 GROUP BY f.id HAVING min(o.id) < f.id""")
def j17_exact_match(spark, d):
    f = fx.files(spark, d)
    return dedupe.exact_matches(f, f)


# ---- review

DOUBT_SQL = """, t AS (SELECT l.*, o.name AS tname, o.sha256 AS tsha FROM live l LEFT JOIN files o ON o.id = l.duplicate_of),
r0 AS (SELECT *, CASE WHEN mode <> 'sort' OR corrected OR checked THEN NULL
  WHEN duplicate_of IS NOT NULL AND duplicate_of <> 0 THEN CASE WHEN tname IS NULL THEN 'dup' ELSE 'dup_of:' || tname END
  WHEN category = '未分類' THEN coalesce(reason, 'unsure') WHEN score IS NULL OR reason IN ('截圖尺寸', '截圖檔名', '文件檔') THEN NULL
  WHEN second <> '' AND score > 0 AND second_score >= 0.6 * score THEN 'either:' || category || '|' || second
  WHEN score < 0.5 THEN 'low:' || round_even(score * 100, 0)::INT END AS dd, coalesce(tsha = sha256, false) AS exact FROM t),
rr AS (SELECT *, coalesce(batch, 'legacy') AS bid, CASE WHEN reviewed THEN NULL WHEN dd IS NOT NULL AND tname IS NOT NULL THEN CASE WHEN exact THEN 'exact:' ELSE 'similar:' END || tname ELSE dd END AS doubt FROM r0)
"""


@query(DOUBT_SQL + "SELECT id, exact, doubt FROM rr")
def p1_doubt(spark, d):
    return rollups.reviewed_rows(fx.files(spark, d)).select("id", "exact", "doubt")


def _batch_sql(state: str, rows: str) -> str:
    return DOUBT_SQL + f""", w AS (SELECT bid, count(*) AS total, count_if(reviewed)::BIGINT AS reviewed FROM rr GROUP BY 1)
SELECT bid, coalesce(b.started_at, g.first) AS started_at, total, reviewed, n, doubts, exact_dups, b.count AS expected FROM w
JOIN (SELECT bid, count(*) AS n, count(doubt) AS doubts, count_if(exact)::BIGINT AS exact_dups, min(received_at) AS first FROM rr WHERE {rows} GROUP BY 1) g USING (bid) LEFT JOIN batches b ON b.id = bid WHERE {state}"""


@query(_batch_sql("reviewed < total", "NOT reviewed"))
def q8_batches_pending(spark, d):
    return rollups.batch_list(fx.files(spark, d), fx.batches(spark, d), "pending")


@query(_batch_sql("reviewed = total", "true"))
def q8_batches_reviewed(spark, d):
    return rollups.batch_list(fx.files(spark, d), fx.batches(spark, d), "reviewed")


@query(_batch_sql("true", "category = 'cat_3' AND duplicate_of IS NULL"))
def q8_batches_category(spark, d):
    return rollups.batch_list(fx.files(spark, d), fx.batches(spark, d), "all", "cat_3")


ROOT_SQL = """, f AS (SELECT id, nullif(duplicate_of, 0) AS dup FROM live),
r(id, cur, path) AS (SELECT id, id, []::BIGINT[] FROM f WHERE dup IS NOT NULL UNION ALL
  SELECT r.id, n.id, list_append(r.path, r.cur) FROM r JOIN f c ON c.id = r.cur JOIN f n ON n.id = c.dup WHERE NOT list_contains(r.path, r.cur)),
roots AS (SELECT id, cur AS root FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) = 1)
"""


@query(ROOT_SQL + "SELECT id, root FROM roots")
def j16_dup_roots(spark, d):
    return dedupe.duplicate_roots(fx.files(spark, d))


@query(ROOT_SQL + """, m AS (SELECT root, id FROM roots UNION SELECT root, root FROM roots)
SELECT m.root, m.id, m.id = m.root AS is_root, m.id <> m.root AND l.sha256 = b.sha256 AS exact,
  CASE WHEN m.id = m.root THEN NULL WHEN l.sha256 = b.sha256 THEN 1.0 ELSE round(list_dot_product(l.vec, b.vec), 6) END AS sim, max(l.received_at) OVER (PARTITION BY m.root) AS latest
FROM m JOIN live l ON l.id = m.id JOIN live b ON b.id = m.root""")
def q9_dup_groups(spark, d):
    return dedupe.duplicate_groups(fx.files(spark, d))


@query(ROOT_SQL + DOUBT_SQL + """, w AS (SELECT bid FROM rr GROUP BY 1 HAVING count_if(reviewed) < count(*))
SELECT (SELECT count(*) FROM live) AS total, (SELECT sum(size) FROM live)::BIGINT AS used, (SELECT count(*) FROM w) AS pending_batches,
  (SELECT count(*) FROM rr JOIN w USING (bid) WHERE NOT reviewed) AS pending_files, (SELECT count(doubt) FROM rr JOIN w USING (bid) WHERE NOT reviewed) AS doubts,
  (SELECT count(DISTINCT root) FROM roots) AS dup_groups, (SELECT count(*) FROM files WHERE removed) AS removed, 0 AS stale_files, 0 AS stale_videos""")
def q10_home(spark, d):
    return rollups.home(fx.files(spark, d), fx.batches(spark, d), fx.segs(spark, d), DIM)


# ---- classification

ZERO_SQL = PROTO_SQL + """, e AS (SELECT l.id, p.name, CASE WHEN (l.kind = 'video' OR l.id % 3 = 0) AND p.name = 'cat_1' THEN -1.0 ELSE list_dot_product(l.vec, p.vec) END
    + CASE WHEN l.kind = 'image' AND length(l.ocr_n) >= 30 AND p.name = 'cat_4' THEN 0.02 ELSE 0 END AS s FROM live l, protos p WHERE l.vec IS NOT NULL),
x AS (SELECT id, name, exp((s - max(s) OVER w) * 50) AS ex FROM e WINDOW w AS (PARTITION BY id)),
p AS (SELECT id, name, ex / sum(ex) OVER (PARTITION BY id) AS p FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, name) AS r FROM p),
z AS (SELECT id, max(CASE WHEN r = 1 THEN name END) AS a, max(CASE WHEN r = 1 THEN p END) AS pa, max(CASE WHEN r = 2 THEN name END) AS b, max(CASE WHEN r = 2 THEN p END) AS pb FROM k WHERE r <= 2 GROUP BY 1)
"""


def _items(spark, d):
    f = filters.live(fx.files(spark, d)).where("vec is not null")
    return f.withColumn("camera", F.col("id") % 3 == 0).withColumn("text_len", F.length("ocr_n")).withColumn("shot", F.when((F.col("kind") == "image") & (F.col("id") % 8 == 4), "截圖檔名"))


@query(ZERO_SQL + "SELECT id, CASE WHEN pa < 0.35 THEN '未分類' ELSE a END AS category, round(pa, 6) AS confidence, CASE WHEN pa < 0.35 THEN a ELSE b END AS second, round(CASE WHEN pa < 0.35 THEN pa ELSE pb END, 6) AS second_score FROM z")
def p3_zero_shot(spark, d):
    out = classify.zero_shot(_items(spark, d), _protos(spark, d), "cat_1", "cat_4")
    return out.select("id", "category", F.round("confidence", 6).alias("confidence"), "second", F.round("second_score", 6).alias("second_score"))


LEARNED_SQL = """, ex AS (SELECT id AS eid, category AS ecat, vec AS evec FROM live WHERE corrected AND vec IS NOT NULL AND category LIKE 'cat_%'),
tp AS (SELECT l.id, eid, ecat, list_dot_product(l.vec, evec) AS sim FROM live l JOIN ex ON eid <> l.id WHERE l.vec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY sim DESC, eid) <= 5),
vt AS (SELECT id, ecat, sum(CASE WHEN sim >= 0.2 THEN sim END) AS v, max(sim) AS best FROM tp GROUP BY 1, 2 HAVING v IS NOT NULL),
lw AS (SELECT id, ecat, best FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC) = 1)
"""


@query(LEARNED_SQL + "SELECT id, ecat AS category, round(best, 6) AS confidence FROM lw")
def p4_learned(spark, d):
    out = classify.learned(_items(spark, d), fx.files(spark, d), fx.CATEGORIES, 0.2)
    return out.select("id", "category", F.round("confidence", 6).alias("confidence"))


CASCADE_SQL = ZERO_SQL + LEARNED_SQL.replace(">= 0.2", ">= 0.3") + """, ca AS (SELECT l.id, l.kind = 'image' AND l.id % 8 = 4 AS shot, ecat, best, z.* EXCLUDE (id) FROM live l JOIN z USING (id) LEFT JOIN lw USING (id) WHERE l.vec IS NOT NULL)
SELECT id, CASE WHEN shot THEN 'cat_1' WHEN ecat IS NOT NULL THEN ecat WHEN pa < 0.35 THEN '未分類' ELSE a END AS category, round(CASE WHEN shot THEN 1.0 WHEN ecat IS NOT NULL THEN best ELSE pa END, 6) AS confidence,
  CASE WHEN shot THEN '截圖檔名' WHEN ecat IS NOT NULL THEN '像你分類過的檔案' WHEN pa < 0.35 THEN '最像「' || a || '」但不夠確定' ELSE 'AI 判斷' END AS reason,
  CASE WHEN shot OR ecat IS NOT NULL THEN NULL WHEN pa < 0.35 THEN a ELSE b END AS second, round(CASE WHEN shot OR ecat IS NOT NULL THEN NULL WHEN pa < 0.35 THEN pa ELSE pb END, 6) AS second_score FROM ca"""


@query(CASCADE_SQL)
def p3_cascade(spark, d):
    out = classify.cascade(_items(spark, d), fx.files(spark, d), _protos(spark, d), fx.CATEGORIES, DIM, "cat_1", "cat_4", 0.3)
    return out.select("id", "category", F.round("confidence", 6).alias("confidence"), "reason", "second", F.round("second_score", 6).alias("second_score"))


# ---- audit


@query("SELECT i.batch, i.fid, i.status, b.sender, b.mode FROM items i LEFT JOIN batches b ON b.id = i.batch WHERE i.status IN ('received', 'error')")
def j2_retry_items(spark, d):
    return audit.retry_items(fx.items(spark, d), fx.batches(spark, d))


@query("SELECT f.id, f.name, o.path AS original, o.removed AS original_removed FROM files f LEFT JOIN files o ON o.id = f.duplicate_of WHERE f.removed AND f.duplicate_of IS NOT NULL")
def j3_cleared_duplicates(spark, d):
    f = fx.files(spark, d)
    o = f.select(F.col("id").alias("duplicate_of"), F.col("path").alias("original"), F.col("removed").alias("original_removed"))
    return f.where(F.col("removed") & F.col("duplicate_of").isNotNull()).join(o, "duplicate_of", "left").select("id", "name", "original", "original_removed")


@query("SELECT id FROM batches b WHERE EXISTS (SELECT 1 FROM live l WHERE l.batch = b.id)")
def j4_batches_with_files(spark, d):
    return fx.batches(spark, d).join(filters.live(fx.files(spark, d)).select(F.col("batch").alias("id")), "id", "left_semi").select("id")


@query("""SELECT i.batch, i.fid, min(f.id) AS id FROM items i JOIN files f ON f.batch = i.batch AND f.sha256 = i.sha256
  WHERE i.file_id IS NULL AND f.id NOT IN (SELECT file_id FROM items WHERE file_id IS NOT NULL) GROUP BY 1, 2""")
def j5_registered(spark, d):
    return audit.registered(fx.items(spark, d), fx.files(spark, d))


AUDIT_SQL = """, fp AS (SELECT f.*, coalesce(p.exists_, false) AS pe, p.size AS ps, p.opens AS po, p.sha256 AS psha FROM files f LEFT JOIN probe p USING (path)),
bad1 AS (SELECT id, coalesce(batch, 'legacy') AS bid, name, CASE WHEN NOT pe THEN 'not_found' WHEN size <> 0 AND ps <> size THEN 'size' WHEN NOT po THEN 'cant_open' END AS why FROM fp WHERE NOT removed),
good AS (SELECT DISTINCT sha256 AS gsha, size AS gsize FROM fp WHERE NOT removed AND pe AND ps = size AND psha = sha256),
bad2 AS (SELECT i.batch, i.fid, CASE WHEN f.id IS NOT NULL AND i.sha256 <> f.sha256 THEN 'index_mismatch' WHEN f.id IS NOT NULL AND NOT f.removed THEN NULL
  WHEN f.id IS NOT NULL AND f.duplicate_of IS NULL AND f.pe THEN NULL WHEN gsha IS NOT NULL THEN NULL WHEN f.id IS NULL THEN 'gone' ELSE 'kept_missing' END AS why
  FROM items i LEFT JOIN fp f ON f.id = i.file_id LEFT JOIN good ON gsha = coalesce(i.sha256, f.sha256) AND gsize = coalesce(i.got_size, f.size) WHERE i.status = 'indexed'),
bad3 AS (SELECT batch, fid, CASE status WHEN 'expected' THEN 'not_received' WHEN 'received' THEN 'processing' WHEN 'failed' THEN 'transfer_failed' ELSE 'process_failed' END
  || CASE WHEN status IN ('failed', 'error') AND error IS NOT NULL THEN ':' || error ELSE '' END AS why FROM items WHERE status <> 'indexed')
"""


@query(AUDIT_SQL + "SELECT id, bid, name, why FROM bad1 WHERE why IS NOT NULL")
def v4_file_problems(spark, d):
    return audit.file_problems(fx.files(spark, d), fx.probe(spark, d))


@query(AUDIT_SQL + "SELECT batch, fid, why FROM bad2 WHERE why IS NOT NULL")
def v3_copy_missing(spark, d):
    return audit.copy_missing(fx.items(spark, d), fx.files(spark, d), fx.probe(spark, d))


@query(AUDIT_SQL + """, own AS (SELECT coalesce(batch, 'legacy') AS bid, count(*) AS rws, count_if(kind = 'image')::BIGINT AS images, count_if(kind = 'video')::BIGINT AS videos, count_if(kind NOT IN ('image', 'video'))::BIGINT AS others FROM live GROUP BY 1),
li AS (SELECT batch AS bid, count(*) AS its, count_if(status = 'received')::BIGINT AS busy, count_if(status = 'indexed')::BIGINT AS done FROM items GROUP BY 1),
ba AS (SELECT bid, count(*) AS bad FROM (SELECT bid FROM bad1 WHERE why IS NOT NULL UNION ALL SELECT batch FROM bad2 WHERE why IS NOT NULL UNION ALL SELECT batch FROM bad3) GROUP BY 1),
hv AS (SELECT batch AS bid, count(*) AS have FROM files GROUP BY 1),
cl AS (SELECT f.batch AS bid, count(*) AS dups, count_if(coalesce(o.removed, true) OR NOT coalesce(o.pe, false) OR coalesce(o.size <> 0 AND o.ps <> o.size, false))::BIGINT AS lost FROM files f LEFT JOIN fp o ON o.id = f.duplicate_of WHERE f.removed AND f.duplicate_of IS NOT NULL GROUP BY 1),
ev AS (SELECT coalesce(own.bid, b.id) AS bid, b.count AS expected, rws, images, videos, others FROM own FULL JOIN batches b ON b.id = own.bid),
jn AS (SELECT ev.*, coalesce(its, 0) AS its, coalesce(busy, 0) AS busy, coalesce(done, 0) AS done, coalesce(bad, 0) AS bad, coalesce(have, 0) AS have, coalesce(dups, 0) AS dups, coalesce(lost, 0) AS lost,
  coalesce(its, 0) = 0 AND ev.bid <> 'legacy' AS old FROM ev LEFT JOIN li USING (bid) LEFT JOIN ba USING (bid) LEFT JOIN hv USING (bid) LEFT JOIN cl USING (bid)),
wr AS (SELECT *, bad + CASE WHEN old AND expected > 0 AND have < expected THEN 1 ELSE 0 END + CASE WHEN old THEN lost ELSE 0 END AS wrong FROM jn)
SELECT bid AS batch, CASE WHEN its > 0 THEN its ELSE coalesce(rws, 0) END AS total, coalesce(images, 0) AS images, coalesce(videos, 0) AS videos, coalesce(others, 0) AS others, wrong::BIGINT AS bad, busy,
  wrong = 0 AND (coalesce(rws, 0) > 0 OR done > 0 OR (old AND dups > 0)) AS ok FROM wr""")
def q11_batch_check(spark, d):
    return audit.batch_checks(fx.files(spark, d), fx.batches(spark, d), fx.items(spark, d), fx.probe(spark, d))


@query(AUDIT_SQL + "SELECT id, pe AND NOT coalesce(ps <> size, false) AS ok, CASE WHEN NOT pe THEN 'missing' WHEN coalesce(ps <> size, false) THEN 'changed' ELSE '' END AS why FROM fp")
def v6_sendable(spark, d):
    return audit.sendable(fx.files(spark, d), fx.probe(spark, d))


# ---- functions


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[\\s,，、。.·:：;；''\"「」『』()（）\\[\\]【】\\-_—~～|/\\\\]', '', 'g')) AS norm FROM documents")
def t2_norm(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text.norm("text")).alias("norm"))


NAMES = ["a/b\\c?.jpg", "..x..", "con.txt", "", "plain name.pdf", "x" * 200]
CLEANED = ["c_.jpg", "x", "_con.txt", "file", "plain name.pdf", "x" * 180]


@query(f"SELECT id, ({CLEANED})[1 + id % 6] AS name FROM files")
def t5_clean_name(spark, d):
    raw = F.element_at(F.array(*(F.lit(n) for n in NAMES)), (F.col("id") % 6 + 1).cast("int"))
    return fx.files(spark, d).select("id", text.clean_name(raw).alias("name"))


@query("""SELECT id, CASE WHEN mode = 'plain' THEN 'plain' WHEN duplicate_of IS NOT NULL THEN 'duplicates' WHEN category = '其他檔案' THEN 'other' ELSE category END AS by_category,
  coalesce(taken, 'no date') AS by_month, CASE WHEN place1 IS NULL THEN 'no place' ELSE place1 || ' ' || place2 END AS by_place FROM files""")
def t12_export_folder(spark, d):
    return fx.files(spark, d).select("id", *(export.subfolder(b).alias(f"by_{b}") for b in ("category", "month", "place")))


@query("SELECT (f.id // 3)::INT AS pos, f.id, path AS src, coalesce(taken, 'no date') || '/' || name AS target FROM live f WHERE f.id % 3 = 0 AND f.id < 120")
def k6_export_plan(spark, d):
    return export.plan(fx.files(spark, d), list(range(0, 120, 3)), "month")


PLACES_SQL = """, g AS (SELECT n_name AS place, 7.0 * n_nationkey - 80 AS glat, 13.0 * n_nationkey - 150 AS glon FROM nation),
pt AS (SELECT c_custkey AS id, 7.0 * (c_nationkey) - 80 + (c_custkey % 41 - 20) / 20.0 AS lat, 13.0 * c_nationkey - 150 + (c_custkey % 37 - 18) / 18.0 AS lon FROM customer),
ds AS (SELECT id, place, acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(glat)) + cos(radians(lat)) * cos(radians(glat)) * cos(radians(lon - glon))))) * 6371.0 AS km FROM pt, g)
"""


@query(PLACES_SQL + "SELECT id, place, round(km, 3) AS km FROM ds WHERE km <= 80 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, place) = 1")
def j13_nearest_place(spark, d):
    k = F.col("n_nationkey")
    places = fx.table(spark, d, "nation").select(F.col("n_name").alias("place"), (7.0 * k - 80).alias("lat"), (13.0 * k - 150).alias("lon"))
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    points = fx.table(spark, d, "customer").select(c.alias("id"), (7.0 * n - 80 + (c % 41 - 20) / 20.0).alias("lat"), (13.0 * n - 150 + (c % 37 - 18) / 18.0).alias("lon"))
    return geo.nearest(points, places, 80.0).select("id", "place", F.round("km", 3).alias("km"))


@query(""", v AS (SELECT p_partkey AS id, p_retailprice * (p_partkey % 7) / 10 AS dur FROM part),
n AS (SELECT *, greatest(1, least(150, floor(dur / 4) + 1))::INT AS n FROM v),
i AS (SELECT *, unnest(generate_series(0, n - 1))::INT AS i FROM n)
SELECT id, i, floor(least(greatest(0.0, dur - 0.1), CASE WHEN n = 150 THEN dur / n ELSE 4.0 END * i + CASE WHEN n = 150 THEN dur / n / 2 ELSE 0 END) * 100 + 0.5) / 100 AS t FROM i""")
def m9_frame_schedule(spark, d):
    v = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * (F.col("p_partkey") % 7) / 10).alias("dur"))
    n = v.withColumn("n", media.frame_count(F.col("dur"), 4.0, 150))
    return n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("id", "i", media.frame_time(F.col("dur"), F.col("n"), F.col("i"), 4.0, 150).alias("t"))


@query("""SELECT id, CASE WHEN id % 5 < 3 THEN (id % 80)::DOUBLE + 0.25 END AS lat, CASE WHEN id % 5 < 3 THEN -((id % 170)::DOUBLE + 0.5) END AS lon FROM files""")
def m8_iso6709(spark, d):
    i = F.col("id")
    text_ = F.when(i % 5 < 3, F.concat(F.lit("x+"), (i % 80).cast("string"), F.lit(".25-"), (i % 170).cast("string"), F.lit(".50+010.000/"))).when(i % 5 == 3, "+00.0000+000.0000/").otherwise("+95.00+010.00/")
    rows = fx.files(spark, d).select("id", text_.alias("loc"))
    lat, lon = media.iso6709("loc")
    return rows.select("id", lat.alias("lat"), lon.alias("lon"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(h, lambda x: x / (sqrt(list_dot_product(h, h)) + 1e-9)) AS v FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS h FROM embeddings))")
def m3_truncate(spark, d):
    v = fx.table(spark, d, "embeddings").select("vec_id", vectors.truncate("embedding", 32).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 5).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


# ---- changes


@query("SELECT id, CASE WHEN id IN (1, 2, 3, 5) AND mode = 'sort' AND NOT removed THEN 'cat_6' ELSE category END AS category, corrected OR (id IN (1, 2, 3, 5) AND mode = 'sort' AND NOT removed) AS corrected FROM files")
def u_set_category(spark, d):
    return mutate.set_category(fx.files(spark, d), [1, 2, 3, 5], "cat_6", fx.CATEGORIES).select("id", "category", "corrected")


@query("SELECT id, reviewed OR coalesce(batch = 'b1', false) AS reviewed FROM files")
def u_confirm_batch(spark, d):
    return mutate.confirm_batch(fx.files(spark, d), "b1").select("id", "reviewed")


@query("SELECT id, CASE WHEN id IN (3, 4) THEN 'removed/' || name WHEN id <> 3 THEN path END AS path, removed OR id IN (3, 4) AS removed, CASE WHEN id IN (3, 4) THEN path ELSE prev_path END AS prev_path FROM files")
def u_remove(spark, d):
    return mutate.remove(fx.files(spark, d), [3, 4]).select("id", "path", "removed", "prev_path")


@query("SELECT id, CASE WHEN duplicate_of IN (1, 5, 9) THEN NULL ELSE duplicate_of END AS duplicate_of FROM files WHERE id NOT IN (1, 5, 9)")
def u_forget(spark, d):
    return mutate.forget(fx.files(spark, d), fx.segs(spark, d), [1, 5, 9])[0].select("id", "duplicate_of")


@query("SELECT id, CASE WHEN category = 'cat_2' THEN 'renamed' ELSE category END AS category, CASE WHEN second = 'cat_2' THEN 'renamed' ELSE second END AS second FROM files")
def u_rename_category(spark, d):
    return mutate.rename_category(fx.files(spark, d), "cat_2", "renamed").select("id", "category", "second")


@query("""SELECT id, CASE WHEN category = 'cat_2' AND mode = 'sort' THEN '未分類' ELSE category END AS category, corrected AND NOT (category = 'cat_2' AND mode = 'sort') AS corrected,
  CASE WHEN second = 'cat_2' OR category = 'cat_2' AND mode = 'sort' THEN NULL ELSE second END AS second FROM files""")
def u_delete_category(spark, d):
    return mutate.delete_category(fx.files(spark, d), "cat_2").select("id", "category", "corrected", "second")


@query(DOUBT_SQL + """, g AS (SELECT f.id FROM live f JOIN probe p USING (path) WHERE p.exists_ AND p.size = f.size AND p.sha256 = f.sha256)
SELECT rr.id, CASE WHEN g.id IS NOT NULL THEN 'remove' ELSE 'promote' END AS action FROM rr LEFT JOIN g ON g.id = rr.duplicate_of WHERE bid = 'b36' AND exact""")
def u_exact_plan(spark, d):
    return mutate.exact_plan(fx.files(spark, d), fx.probe(spark, d), "b36")


@query("SELECT id, path AS src, 'sorted/' || category || CASE WHEN taken IS NULL THEN '' ELSE '/' || taken END || '/' || name AS dst FROM live WHERE duplicate_of IS NULL AND mode = 'sort'")
def u_retarget(spark, d):
    return mutate.retarget(fx.files(spark, d))


@query("""SELECT id, removed AND id NOT IN (17, 34, 51) AS removed, CASE WHEN id IN (17, 34, 51) AND removed AND duplicate_of NOT IN (SELECT id FROM live) THEN NULL ELSE duplicate_of END AS duplicate_of FROM files""")
def u_restore(spark, d):
    return mutate.restore(fx.files(spark, d), [17, 34, 51]).select("id", "removed", "duplicate_of")


@query("""SELECT id, CASE WHEN id IN (12, 13) AND NOT removed THEN 'removed/' || name WHEN id = 11 AND duplicate_of IS NOT NULL AND mode = 'sort' THEN 'sorted/' || category || coalesce('/' || taken, '') || '/' || name ELSE path END AS path, category,
  removed OR id IN (12, 13) AS removed, CASE WHEN id = 11 THEN NULL WHEN duplicate_of IN (12, 13) AND NOT removed AND id NOT IN (12, 13) THEN 11 ELSE duplicate_of END AS duplicate_of, checked OR (id = 11 AND duplicate_of IS NOT NULL) AS checked FROM files""")
def u_resolve_duplicates(spark, d):
    return mutate.resolve_duplicates(fx.files(spark, d), [11], [12, 13], fx.CATEGORIES, "cat_4").select("id", "path", "category", "removed", "duplicate_of", "checked")


@query("SELECT id, name, kind, category, path, prev_path, duplicate_of FROM files WHERE removed")
def q13_removed(spark, d):
    return fx.files(spark, d).where("removed").select("id", "name", "kind", "category", "path", "prev_path", "duplicate_of").orderBy(F.desc("id"))


@query("SELECT id, checked OR id IN (2, 4, 6) AS checked FROM files")
def u_check(spark, d):
    return mutate.check(fx.files(spark, d), [2, 4, 6]).select("id", "checked")


@query("""SELECT id, CASE WHEN m AND id % 4 = 0 THEN 'cat_0' ELSE category END AS category, checked AND NOT (m AND id % 4 = 0 AND category IS DISTINCT FROM 'cat_0') AS checked, CASE WHEN m AND id % 4 = 0 THEN 0.25 ELSE score END AS score
  FROM (SELECT *, NOT corrected AND NOT reviewed AND NOT removed AND vec IS NOT NULL AS m FROM files)""")
def u_reclassify(spark, d):
    f = fx.files(spark, d)
    results = f.where("id % 4 = 0").select("id", F.lit("cat_0").alias("category"), F.lit(0.25).alias("confidence"), F.lit("AI 判斷").alias("reason"), F.lit(None).cast("string").alias("second"), F.lit(None).cast("double").alias("second_score"))
    return mutate.reclassify(f, results).select("id", "category", "checked", "score")


@query("SELECT batch, fid, CASE WHEN doc_id % 4 = 1 THEN 'indexed' ELSE status END AS status, CASE WHEN doc_id % 4 = 1 THEN 1000000 + doc_id ELSE file_id END AS file_id FROM items")
def u_item(spark, d):
    own = fx.items(spark, d)
    k = F.substring("fid", 2, 20).cast("long")
    return mutate.advance_items(own, own.where(k % 4 == 1).select("batch", "fid", F.lit("indexed").alias("status"), (1000000 + k).alias("file_id"))).select("batch", "fid", "status", "file_id")


@query("SELECT file_id, t FROM segs WHERE file_id % 12 <> 1 UNION ALL SELECT DISTINCT file_id, 99.0 FROM segs WHERE file_id % 12 = 1")
def k3_replace_segments(spark, d):
    own = fx.segs(spark, d)
    new = own.where("file_id % 12 = 1").select("file_id", F.lit(99.0).alias("t"), "vec").dropDuplicates(["file_id"])
    return mutate.replace_segments(own, new).select("file_id", "t")


@query("SELECT fid, batch, CASE WHEN file_id IS NOT NULL THEN 'doc_' || file_id || '.txt' END AS name, coalesce(CASE WHEN doc_id % 2 = 0 THEN sha256 END, CASE WHEN file_id IS NOT NULL THEN sha256(text) END) AS sha256 FROM items LEFT JOIN documents USING (doc_id)")
def j6_backfill(spark, d):
    k = F.substring("fid", 2, 20).cast("long")
    own = fx.items(spark, d).withColumn("sha256", F.when(k % 2 == 0, F.col("sha256")))
    return audit.backfilled(own, fx.files(spark, d)).select("fid", "batch", F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


@query("SELECT id FROM live WHERE id % 3 <> 0 AND kind = 'video' AND (mode = 'sort' OR vec IS NOT NULL) ORDER BY id DESC LIMIT 10")
def f4_enrich_videos(spark, d):
    f = fx.files(spark, d).withColumn("seg_done", (F.col("id") % 3 == 0).cast("int"))
    return filters.enrich_list(f, what="video").select("id")


@query(DOUBT_SQL + """, w AS (SELECT bid, coalesce(any_value(b.started_at), min(received_at)) AS started_at, count(*) AS total FROM rr LEFT JOIN batches b ON b.id = bid GROUP BY 1)
SELECT bid, started_at, total, (SELECT count(*) FROM w) AS batches FROM w ORDER BY started_at DESC, bid LIMIT 7""")
def w10_batch_page(spark, d):
    listed = rollups.batch_list(fx.files(spark, d), fx.batches(spark, d), "all")
    return rollups.batch_page(listed, 7).select("bid", "started_at", "total", "batches")


@query(f"""SELECT category, n, (SELECT count(*) FROM files WHERE removed) AS removed, (SELECT count(*) FROM items WHERE status IN ('expected', 'received')) AS pending,
  (SELECT count(*) FROM live WHERE ocr_done = 0 AND kind IN ('image', 'document') AND (mode = 'sort' OR vec IS NOT NULL)) AS texts_left FROM (SELECT {CAT} AS category, count(*) AS n FROM live GROUP BY 1)""")
def q16_status(spark, d):
    return rollups.status(fx.files(spark, d), fx.items(spark, d)).select(F.explode("counts").alias("category", "n"), "removed", "pending", "texts_left")


@query(AUDIT_SQL + """SELECT coalesce(batch, 'legacy') AS batch, strftime(to_timestamp(min(1704067200 + id * 3607)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS first, strftime(to_timestamp(max(1704067200 + id * 3607)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS last
  FROM live WHERE kind IN ('image', 'video') AND id % 6 <> 0 AND id NOT IN (SELECT id FROM bad1 WHERE why IS NOT NULL) GROUP BY 1""")
def a18_batch_times(spark, d):
    i = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    probe = fx.probe(spark, d).withColumn("captured", F.when(i % 6 != 0, F.timestamp_seconds(1704067200 + i * 3607)))
    return audit.batch_times(fx.files(spark, d), probe)


@query(""", p AS (SELECT a.id, b.id AS other, list_dot_product(a.vec, b.vec) AS s FROM live a JOIN live b ON b.id < a.id AND a.kind = 'image' AND b.kind = 'image' WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM p WHERE s >= 0.2)
SELECT id, other, round(s, 6) AS sim FROM t WHERE r <= 20 AND other % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) = 1""")
def w5_near_best(spark, d):
    f = fx.files(spark, d)
    found = dedupe.first_near(search.near_pairs(f, 0.2, DIM, 20), f.where("id % 3 <> 0").select("id"), 0.2)
    return found.select("id", "other", F.round("sim", 6).alias("sim"))


# ---- ingest

INGEST_SQL = """, ex0 AS (SELECT f.*, p.exists_ AS pe, p.size AS ps, p.sha256 AS psha FROM files f LEFT JOIN probe p USING (path) WHERE id % 3 <> 0),
m AS (SELECT max(id) AS m FROM ex0),
ar AS (SELECT m + row_number() OVER (ORDER BY doc_id) AS id, doc_id, sha256(text) AS sha, 'doc_' || doc_id || (['.jpg', '.mov', '.pdf', '.xyz'])[1 + doc_id % 4] AS name, (['image', 'video', 'document', 'other'])[1 + doc_id % 4] AS kind,
  CASE WHEN doc_id % 5 = 0 THEN 'plain' ELSE 'sort' END AS mode, embedding::DOUBLE[] AS vec FROM documents LEFT JOIN embeddings ON vec_id = doc_id, m WHERE doc_id % 3 = 0),
kn AS (SELECT id, sha256 AS sha FROM ex0 WHERE NOT removed AND pe AND ps = size AND psha = sha256 UNION ALL SELECT id, sha FROM ar),
og AS (SELECT a.id, min(k.id) AS original FROM ar a JOIN kn k ON k.sha = a.sha AND k.id < a.id WHERE mode = 'sort' GROUP BY 1),
rs AS (SELECT * FROM ar WHERE mode = 'sort' AND id NOT IN (SELECT id FROM og)),
cd AS (SELECT id, vec, pe AS here FROM ex0 WHERE NOT removed AND kind = 'image' AND vec IS NOT NULL UNION ALL SELECT id, vec, true FROM rs WHERE kind = 'image' AND vec IS NOT NULL),
nr AS (SELECT r.id, c.id AS other, c.here, row_number() OVER (PARTITION BY r.id ORDER BY list_dot_product(r.vec, c.vec) DESC, c.id) AS rk FROM rs r JOIN cd c ON c.id < r.id AND list_dot_product(r.vec, c.vec) >= 0.25 WHERE r.kind = 'image' AND r.vec IS NOT NULL),
nb AS (SELECT id, arg_min(other, rk) AS near FROM nr WHERE rk <= 20 AND here GROUP BY 1)
SELECT ar.id, name, kind, mode, coalesce(original, near) AS duplicate_of, CASE WHEN mode = 'plain' THEN '傳送' WHEN original IS NOT NULL THEN '疑似重複' WHEN kind = 'document' THEN 'cat_4' WHEN vec IS NULL THEN '其他檔案' ELSE 'judged' END AS category, n_name AS place2
FROM ar LEFT JOIN og USING (id) LEFT JOIN nb USING (id) LEFT JOIN nation ON n_nationkey = doc_id % 25 AND doc_id % 2 = 0"""


@query(INGEST_SQL)
def u_ingest(spark, d):
    f = fx.files(spark, d).where("id % 3 <> 0")
    i, k = F.col("doc_id"), F.col("n_nationkey")
    own = fx.table(spark, d, "documents").where(i % 3 == 0).join(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id", "left")
    ends = F.element_at(F.array(*(F.lit(x) for x in (".jpg", ".mov", ".pdf", ".xyz"))), (i % 4 + 1).cast("int"))
    name, there = F.concat(F.lit("doc_"), i.cast("string"), ends), i % 2 == 0
    arrivals = own.select(
        i.alias("seq"), name.alias("name"), F.concat(F.lit("inbox/"), name).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit("2024-05").alias("taken"), F.when(there, 7.0 * (i % 25) - 80).alias("lat"),
        F.when(there, 13.0 * (i % 25) - 150).alias("lon"), "vec", F.col("text").alias("ocr"), (i % 7 == 0).alias("camera"), F.lit(None).cast("string").alias("shot"), F.when(i % 5 == 0, "plain").otherwise("sort").alias("mode"), F.lit("new").alias("batch"), F.lit(1.0).alias("received_at"),
    )
    cities = fx.table(spark, d, "nation").select(F.struct(F.lit("N").alias("p1"), F.col("n_name").alias("p2")).alias("place"), (7.0 * k - 80).alias("lat"), (13.0 * k - 150).alias("lon"))
    done = ingest.ingest(f, arrivals, fx.probe(spark, d), _protos(spark, d), fx.CATEGORIES, DIM, cities.limit(0), cities, "cat_1", "cat_4", near=0.25, vote=0.3)
    return done.where("batch = 'new'").select("id", "name", "kind", "mode", "duplicate_of", F.when(F.col("score").isNull(), F.col("category")).otherwise("judged").alias("category"), "place2")


@query("""SELECT id, CASE WHEN t AND id % 3 = 1 THEN 'read ' || id ELSE ocr END AS ocr, CASE WHEN t THEN CASE WHEN id % 3 = 1 THEN 1 WHEN id % 3 = 2 OR id % 2 = 0 THEN 2 ELSE ocr_done END ELSE ocr_done END AS ocr_done
  FROM (SELECT *, id < 60 AND ocr_done = 0 OR id IN (1, 2, 4, 5) AS t FROM files)""")
def x9_enrich_round(spark, d):
    f = fx.files(spark, d)
    i = F.col("id")
    results = f.where("id < 60 and ocr_done = 0 or id in (1, 2, 4, 5)").select(i.alias("pos"), "id", F.when(i % 3 == 1, F.concat(F.lit("read "), i.cast("string"))).alias("ocr"), (i % 3 != 1).alias("failed"), (i % 3 == 2).alias("missing"))
    before = f.where("id % 2 = 0 and id < 60").select("id", F.lit(1).alias("n"))
    return ingest.enriched(f, before, results)[0].select("id", "ocr", "ocr_done")


@query("SELECT id, coalesce(taken, '2023-01') AS taken, CASE WHEN geo THEN place1 ELSE coalesce(place1, 'X') END AS place1, geo OR id % 3 = 0 AS geo FROM files")
def u_backfill(spark, d):
    f = fx.files(spark, d)
    found = f.select("id", F.lit("2023-01").alias("taken"), F.lit("X").alias("place1"), F.lit("Y").alias("place2"), (F.col("id") % 3 == 0).alias("geo"))
    return ingest.located(f, found).select("id", "taken", "place1", "geo")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 2 ELSE len(vec) END::INT AS dim, CASE WHEN id % 14 = 0 THEN 1 ELSE seg_done END AS seg_done FROM files")
def u_reindex(spark, d):
    f = fx.files(spark, d)
    vectors = f.where("id % 7 = 0").select("id", F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("vec"))
    new = f.where("id % 14 = 0").select(F.col("id").alias("file_id"), F.lit(0.0).alias("t"), F.array(F.lit(1.0)).cast("array<float>").alias("vec"))
    return ingest.reindexed(f, fx.segs(spark, d), vectors, new)[0].select("id", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("dim"), "seg_done")


@query(DOUBT_SQL + """, g AS (SELECT f.id FROM live f JOIN probe p USING (path) WHERE p.exists_ AND p.size = f.size AND p.sha256 = f.sha256),
ep AS (SELECT rr.id, g.id IS NOT NULL AS away FROM rr LEFT JOIN g ON g.id = rr.duplicate_of WHERE bid = 'b36' AND exact)
SELECT f.id, f.removed OR coalesce(away, false) AS removed, CASE WHEN NOT coalesce(away, true) THEN NULL ELSE f.duplicate_of END AS duplicate_of, f.checked OR NOT coalesce(away, true) AS checked FROM files f LEFT JOIN ep USING (id)""")
def u_clear_exact(spark, d):
    done = mutate.clear_exact(fx.files(spark, d), fx.probe(spark, d), "b36", fx.CATEGORIES, "cat_4")
    return done.select("id", "removed", "duplicate_of", "checked")


@query("""SELECT i.batch, i.fid, CASE WHEN f.id IS NOT NULL THEN 'close' WHEN k % 3 = 0 THEN CASE WHEN b.mode = 'plain' THEN 'register' ELSE 'requeue' END WHEN k % 3 = 1 THEN 'move_back' WHEN k % 2 = 0 THEN 'error' ELSE 'wait' END AS action, f.id AS file_id,
  CASE WHEN f.id IS NOT NULL THEN NULL WHEN k % 3 = 0 THEN 'inbox/' || i.name WHEN k % 3 = 1 THEN 'sorted/' || i.name END AS src
  FROM (SELECT *, doc_id AS k FROM items WHERE status IN ('received', 'error')) i LEFT JOIN batches b ON b.id = i.batch LEFT JOIN (SELECT id FROM files WHERE id % 7 = 0) f ON f.id = k""")
def x7_recovery(spark, d):
    k = F.substring("fid", 2, 20).cast("long")
    own = fx.items(spark, d).withColumn("path", F.concat(F.lit("inbox/"), "name")).withColumn("dest", F.when((k % 3 == 1) | (k % 2 == 0), F.concat(F.lit("sorted/"), "name"))).withColumn("sha256", F.concat(F.lit("s"), k.cast("string")))
    todo = own.where(F.col("status").isin("received", "error"))
    here = lambda c, mine: todo.where(mine).select(F.col(c).alias("path"), F.lit(True).alias("exists"), F.lit(1).alias("size"), F.lit(True).alias("opens"), "sha256")
    probe = here("path", k % 3 == 0).unionByName(here("dest", k % 3 == 1))
    indexed = fx.files(spark, d).where("id % 7 = 0").withColumn("sha256", F.concat(F.lit("s"), F.col("id").cast("string")))
    return recovery.recovery_plan(own, indexed, fx.batches(spark, d), probe)


@query("""SELECT 'p' || (user_id % 40) AS fingerprint, arg_max(event_type, (ts, event_type)) FILTER (event_id % 3 = 0) AS alias, max(ts) AS seen, (1706659200 - floor(epoch(max(ts))))::INT AS ago FROM events
  WHERE user_id % 40 <> 7 GROUP BY 1 HAVING floor(epoch(max(ts))) >= 1706659200 - 86400""")
def x10_peers(spark, d):
    heard = fx.table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("fingerprint"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("alias"), F.lit("").alias("model"), F.col("ts").cast("timestamp").alias("at"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return recovery.live_peers(heard, now, ("p7",), 86400).select("fingerprint", "alias", F.col("seen").cast("timestamp_ntz").alias("seen"), "ago")


@query("SELECT id, name FROM files WHERE id % 2 = 0")
def k9_backup_restore(spark, d):
    from strata.sources.snapshots import Snapshots
    from strata.streaming.ingest import stream_dir

    own = Snapshots(spark, stream_dir(spark))
    f = fx.files(spark, d).select("id", "name")
    first = own.commit({"files": f.where("id % 2 = 0")})
    own.commit({"files": f})
    own.restore(first)
    return own.load("files")


@query("SELECT id, CASE WHEN id % 50 = 3 THEN 'moved' ELSE name END AS name, size FROM files WHERE id % 50 <> 7")
def k2_update_parts(spark, d):
    from strata.sources.snapshots import Snapshots
    from strata.streaming.ingest import stream_dir

    own, f = Snapshots(spark, stream_dir(spark), part_ids=100), fx.files(spark, d).select("id", "name", "size")
    own.commit({"files": f})
    own.update("files", f.where("id % 50 = 3").withColumn("name", F.lit("moved")), f.where("id % 50 = 7").select("id"))
    return own.load("files")


# ---- dates, sizes, messages


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def d1_month(spark, d):
    return fx.table(spark, d, "events").groupBy(media.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE md5(left(regexp_replace(left(coalesce(text, ''), 24000), '^\\s+|\\s+$', '', 'g'), 6000)) END AS text FROM documents")
def s12_document_text(spark, d):
    name = F.when(F.col("doc_id") % 10 == 9, "a.pdf").when(F.col("doc_id") % 2 == 0, "b.txt").otherwise("c.MD")
    read = media_files.document_texts(name, F.encode("text", "UTF-8"))
    return fx.table(spark, d, "documents").select("doc_id", F.md5(read).alias("text"))


@query("SELECT id, CASE WHEN id % 7 <> 0 THEN round((id % 80) + (id % 60) / 60.0 + (id % 5000) / 100.0 / 3600.0, 9) END AS lat, CASE WHEN id % 7 <> 0 THEN -round((id % 170) + (id % 59) / 60.0 + (id % 4000) / 100.0 / 3600.0, 9) END AS lon FROM files")
def s16_exif_position(spark, d):
    i = F.col("id")

    def word(x):  # 32 bits, little-endian
        h = F.lpad(F.hex(x), 8, "0")
        return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))

    fraction = lambda x, by: F.concat(word(x.cast("long")), word(F.lit(by)))
    head = "49492A0008000000" + "0100" + "25880400010000001A000000" + "00000000"  # the main directory points to the GPS part
    gps = "0400" + "0100020002000000" + "4E000000" + "0200050003000000" + "50000000" + "0300020002000000" + "57000000" + "0400050003000000" + "68000000" + "00000000"
    own = F.concat(F.lit(head + gps), fraction(i % 80, 1), fraction(i % 60, 1), fraction(i % 5000, 100), fraction(i % 170, 1), fraction(i % 59, 1), fraction(i % 4000, 100))
    rows = fx.files(spark, d).select("id", media_files.image_facts(F.when(i % 7 != 0, F.unhex(own)).otherwise(F.unhex(F.lit("FFD8FF")))).alias("f"))
    lat, lon = media_files.position(F.col("f"))
    return rows.select("id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("SELECT id, ocr AS text, ocr_done AS done, (SELECT count(*) FROM segs WHERE file_id = 21) AS segs FROM files WHERE id = 21")
def q14_file_text(spark, d):
    from strata.engine import Engine

    return Engine(fx.files(spark, d), fx.segs(spark, d), fx.batches(spark, d), fx.items(spark, d), DIM).text(21)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 1577836800 + id * 1000 WHEN id % 3 = 1 THEN NULL ELSE 1704067200 + id * 60 END AS created, CASE WHEN id % 3 = 1 THEN NULL ELSE to_timestamp(CASE WHEN id % 3 = 0 THEN 1577836800 + id * 1000 ELSE 1704067200 + id * 60 END) AT TIME ZONE 'UTC' END AS at FROM files")
def s18_movie_times(spark, d):
    i = F.col("id")
    word = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    old = F.concat(word(F.lit(0), 4), word(F.lit(2082844800 + 1577836800) + i * 1000, 4), word(F.lit(0), 4))  # version 0: 32 bits
    new = F.concat(F.lit("01000000"), word(F.lit(2082844800 + 1704067200) + i * 60, 8), word(F.lit(0), 4))  # version 1: 64 bits
    box = lambda kind, body: F.concat(word(F.length(body) / 2 + 8, 4), F.lit(kind.encode().hex()), body)
    movie = F.concat(box("ftyp", F.lit("71742020")), box("moov", box("mvhd", F.when(i % 3 == 0, old).otherwise(new))))
    own = fx.files(spark, d).select(F.concat(F.lit("m"), i.cast("string"), F.lit(".mp4")).alias("name"), F.when(i % 3 != 1, F.unhex(movie)).otherwise(F.unhex(F.lit("00000000"))).alias("content"))
    facts = media_ranges.read_media(spark, media_ranges.write_files(own, f"{shared_dir(spark)}/strata-movies-{uuid.uuid4().hex}"), "created")
    seconds = F.col("created")
    return facts.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("id"), (seconds - 2082844800).alias("created"), media.capture_time(F.lit(None).cast("string"), seconds, F.lit(None).cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[\\s,，、。.·:：;；''\"「」『』()（）\\[\\]【】\\-_—~～|/\\\\]', '', 'g')) AS norm FROM documents")
def t1_norm_full(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text.norm_full()("text")).alias("norm"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN DATE '2021-03-04' WHEN 1 THEN DATE '2020-01-01' + (id % 300)::INT WHEN 2 THEN DATE '2019-12-31' ELSE DATE '2000-01-01' END AS day, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2021-03-04 05:06:07' END AS at FROM files""")
def s14_capture_date(spark, d):
    i = F.col("id")
    taken = F.when(i % 5 == 0, "2021:03:04 05:06:07").when(i % 5 == 1, "0000:00:00 00:00:00")
    seconds = F.when(i % 5 == 1, F.lit(2082844800 + 1577836800) + (i % 300) * 86400).when(i % 5 == 2, F.lit(5).cast("long"))
    modified = F.when(i % 5 == 2, "2019-12-31T23:00:00Z").when(i % 5 == 3, "yesterday")
    own = fx.files(spark, d).select("id", taken.alias("taken"), seconds.alias("seconds"), modified.alias("modified"))
    return own.select("id", media.capture_date(F.col("taken"), F.col("seconds"), F.col("modified"), F.lit("2000-01-01").cast("date")).alias("day"), media.exif_time(F.col("taken")).cast("timestamp_ntz").alias("at"))


@query("""SELECT p_partkey, CASE WHEN th = 0 THEN 48 WHEN tw = 0 THEN least((h // w) * 48, 13440) ELSE th END::INT AS height, CASE WHEN th = 0 THEN least((w // h) * 48, 13440) WHEN tw = 0 THEN 48 ELSE tw END::INT AS width FROM
  (SELECT *, (floor(sqrt(645120.0 / (h * w)) * h / 48) * 48)::INT AS th, (floor(sqrt(645120.0 / (h * w)) * w / 48) * 48)::INT AS tw FROM (SELECT p_partkey, 1 + p_partkey * 37 % 4000 AS h, 1 + p_partkey * p_size % 3000 AS w FROM part))""")
def m10_processing_size(spark, d):
    k = F.col("p_partkey")
    own = fx.table(spark, d, "part").select(k, (1 + k * 37 % 4000).alias("h"), (1 + k * F.col("p_size") % 3000).alias("w"))
    h, w = arrays.processing_size("h", "w")
    return own.select("p_partkey", h.alias("height"), w.alias("width"))


@query("""SELECT o_orderkey, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT o_orderkey, line, string_agg(word, ' ' ORDER BY x) AS t FROM
  (SELECT l_orderkey AS o_orderkey, l_linenumber // 3 AS line, (l_partkey * 7 + l_linenumber) AS x, l_shipmode_ AS word FROM (SELECT *, 'w' || l_linenumber AS l_shipmode_ FROM lineitem)) GROUP BY 1, 2) GROUP BY 1""")
def w12_reading_order(spark, d):
    n = F.col("l_linenumber")
    left, top = F.col("l_partkey") * 7 + n, F.floor(n / 3) * 40 + n % 3 * 4
    box = F.struct(F.concat(F.lit("w"), n.cast("string")).alias("text"), left.alias("left"), top.alias("top"), (left + 5).alias("right"), (top + 20).alias("bottom"))
    own = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(box).alias("boxes"))
    return own.select("o_orderkey", arrays.reading_lines("boxes").alias("text"))


@query("""SELECT id, CASE WHEN reason = 'AI 判斷' THEN 'by AI' WHEN reason = '截圖尺寸' THEN 'screenshot' WHEN reason LIKE '最像%' THEN 'closest to cat_' || (id % 7) || ', unsure' ELSE reason END AS words, 'lib/' || path AS full_path, path AS short FROM files""")
def t10_messages(spark, d):
    words, templates = {"AI 判斷": "by AI", "截圖尺寸": "screenshot"}, {"closest": "closest to {cat}, unsure"}
    full = messages.absolute(F.col("path"), "lib/")
    return fx.files(spark, d).select("id", messages.reason(F.col("reason"), words, templates).alias("words"), full.alias("full_path"), messages.relative(full, "lib").alias("short"))


SAID = {"zh": {"k0": "{n} 個項目", "k1": "甲 {who}"}, "en": {"k0": "{n} item{s} {are} by {who}", "k2": "{n} box{es} {odd}"}}


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 1 THEN (event_id % 5) || ' item' || CASE WHEN event_id % 5 = 1 THEN ' is' ELSE 's are' END || ' by ' || event_type ELSE (event_id % 5) || ' 個項目' END
  WHEN 1 THEN '甲 ' || event_type WHEN 2 THEN CASE WHEN event_id % 3 = 1 THEN (event_id % 5) || ' box' || CASE WHEN event_id % 5 = 1 THEN '' ELSE 'es' END || ' {odd}' ELSE 'k2' END ELSE 'k3' END AS said FROM events""")
def t9_said(spark, d):
    i = F.col("event_id")
    key, lang = F.concat(F.lit("k"), (i % 4).cast("string")), F.element_at(F.array(*map(F.lit, ("zh", "en", "fr"))), (i % 3 + 1).cast("int"))
    return fx.table(spark, d, "events").select("event_id", messages.said(key, SAID, lang, n=i % 5, who=F.col("event_type")).alias("said"))


@query("SELECT event_id, event_type || ' {x} ' || event_id || CASE WHEN event_id = 1 THEN '' ELSE 's' END || ' {other}' AS line FROM events")
def t8_filled(spark, d):
    return fx.table(spark, d, "events").select("event_id", messages.filled(F.lit("{what} {n}{s} {other}"), what=F.concat("event_type", F.lit(" {x}")), n=F.col("event_id")).alias("line"))


@query("""SELECT doc_id, CASE WHEN length(bare) NOT BETWEEN 1 AND 20 OR regexp_matches(bare, '[<>:"/\\\\|?*.\\x00-\\x1f]') THEN 'form' WHEN bare = '未分類' THEN 'reserved' WHEN regexp_full_match(bare, 'cat_[0-6]') THEN 'taken' END AS fault FROM
  (SELECT doc_id, regexp_extract(coalesce(CASE doc_id % 6 WHEN 0 THEN 'cat_' || (doc_id % 9) WHEN 1 THEN ' 未分類 ' WHEN 2 THEN substr(text, 1, (doc_id % 24)::INT) WHEN 3 THEN 'a/' || doc_id WHEN 4 THEN repeat('x', (doc_id % 30)::INT) END, ''), '(?s)\\S(?:.*\\S)?') AS bare FROM documents)""")
def f11_name_fault(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 6 == 0, F.concat(F.lit("cat_"), (i % 9).cast("string"))).when(i % 6 == 1, " 未分類 ").when(i % 6 == 2, F.expr("substr(text, 1, int(doc_id % 24))")).when(i % 6 == 3, F.concat(F.lit("a/"), i.cast("string"))).when(i % 6 == 4, F.repeat(F.lit("x"), (i % 30).cast("int")))
    return fx.table(spark, d, "documents").select("doc_id", categories.name_fault(name, fx.CATEGORIES).alias("fault"))


@query("""SELECT doc_id, len(found) AS n, md5(array_to_string(found, chr(10))) AS found FROM
  (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:12] AS found FROM documents)""")
def f12_descriptions(spark, d):
    found = categories.descriptions(F.col("text"))
    return fx.table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "\n")).alias("found"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || substr(md5(event_id::VARCHAR), 1, 6) AS batch, CASE event_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE '' END AS lang FROM events")
def d6_batch_id(spark, d):
    codes = F.element_at(F.array(*(F.lit(x) for x in ("zh_TW", "EN-us.utf8", "fr-FR", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    return fx.table(spark, d, "events").select("event_id", messages.batch_id(F.col("ts"), F.md5(F.col("event_id").cast("string"))).alias("batch"), text.language(codes).alias("lang"))


# ---- streams


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def x_event_windows(spark, d):
    from strata.streaming.ingest import event_windows

    return event_windows(spark, d)


@query("SELECT batch, fid, sha256 FROM items WHERE doc_id % 9 <> 4")
def x_ingest(spark, d):
    from strata.streaming.ingest import replay_items

    return replay_items(spark, d)


@query("""SELECT batch, fid, 'expected' AS status FROM items WHERE doc_id % 5 <> 3 UNION ALL SELECT batch, fid, CASE WHEN doc_id % 5 = 3 THEN 'refused' WHEN doc_id % 9 = 4 THEN 'rejected' ELSE 'received' END FROM items
  UNION ALL SELECT batch, fid, CASE WHEN doc_id % 5 = 3 THEN 'refused' WHEN doc_id % 9 = 4 THEN 'rejected' ELSE 'repeated' END FROM items WHERE fid LIKE '%7'""")
def x_sessions(spark, d):
    from strata.streaming.sessions import replay_sessions

    return replay_sessions(spark, d)


@query("""SELECT batch, fid, status FROM (SELECT *, max(moment) OVER (PARTITION BY batch) AS last_at, max(moment) OVER () AS end_at FROM (
  SELECT batch, fid, doc_id, doc_id // 20 * 640 + CASE WHEN doc_id % 3 <> 0 THEN 1 + doc_id % 20 ELSE 0 END AS moment FROM items)), (VALUES ('expected'), ('received'), ('expired')) AS s(status)
  WHERE CASE status WHEN 'expected' THEN true WHEN 'received' THEN doc_id % 3 <> 0 ELSE doc_id % 3 = 0 AND last_at + 3600 < end_at - 600 END""")
def x_session_expiry(spark, d):
    from strata.streaming.sessions import replay_expiry

    return replay_expiry(spark, d)


@query("""SELECT fingerprint, unnest(CASE WHEN fresh AND left_ THEN ['new', 'gone'] WHEN fresh THEN ['new'] ELSE ['gone'] END) AS status, unnest(CASE WHEN fresh AND left_ THEN [ts, ts + INTERVAL 15 MINUTE] WHEN fresh THEN [ts] ELSE [ts + INTERVAL 15 MINUTE] END) AS at
  FROM (SELECT *, coalesce(ts - before_ > INTERVAL 15 MINUTE, true) AS fresh, coalesce(after_ - ts > INTERVAL 15 MINUTE, ts + INTERVAL 15 MINUTE < end_ - INTERVAL 2 MINUTE) AS left_
    FROM (SELECT *, lag(ts) OVER w AS before_, lead(ts) OVER w AS after_, max(ts) OVER () AS end_ FROM (SELECT event_id, 'p' || (user_id % 40) AS fingerprint, ts::TIMESTAMP AS ts FROM events) WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, event_id)))
  WHERE fresh OR left_""")
def x_peers(spark, d):
    """Comings and goings of peers, streamed, with two minutes of lateness."""
    from strata.streaming.peers import replay_peers

    return replay_peers(spark, d)
