"""Searches through indexes against the searches without them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.vectors import literal
from strata.operators import narrow, search, text_index, two_pass
from strata.operators.filters import Filter
from strata.operators.text_index import TextIndex
from strata.plans import fixtures as fx
from test_operators import files

SF = "/root/testdata/sf0.001"


def scanned(df) -> int:
    """Rows that the scans of an executed plan gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    text, total, todo = [], 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
            text.append(name)
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert text
    return total


def test_hits_equal_the_scan(spark, tmp_path):
    table = fx.files(spark, SF).select("id", "taken", "kind", "category", "mode", "duplicate_of", "removed", "place1", "ocr_n").cache()
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(table.where("id % 3 <> 0"))
    index.add(table.where("id % 3 = 0 OR id < 50"))  # the second adds rows and repeats some
    texts = [x.ocr_n for x in table.where("length(ocr_n) > 100").orderBy("id").limit(40).collect()]
    r = random.Random(1)
    queries = ["", "x", "The, aner", "zzzqqq", "'", "\\%_"]
    while len(queries) < 100:
        t, n = r.choice(texts), r.choice([2, 2, 3, 4, 7, 15])
        at = r.randrange(len(t) - n)
        queries.append(t[at : at + n] if r.random() < 0.8 else t[at : at + n][::-1])
    got = {}
    for x in index.hits(table, queries).collect():
        got.setdefault(x.q, []).append((x.taken or "", x.id))
    rows = [(x.taken or "", x.id, x.ocr_n or "") for x in table.where("NOT removed").collect()]
    for q, t in enumerate(queries):
        wanted = text_index.normalise(t)[0]
        want = sorted(((a, i) for a, i, o in rows if wanted in o), reverse=True)[:200] if len(wanted) >= 2 else []
        assert sorted(got.get(q, []), reverse=True) == want, t
    one = index.hits(table, ["The, aner"], Filter(kind="image"), 7).select("id").collect()
    assert one == search.text_hits(table, "The, aner", Filter(kind="image"), 7).select("id").collect()


def test_odd_texts_and_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 5)  # pairs across the ends of pieces
    rows = [(0, "ab"), (-1, "xab"), (-32768, "aab"), (-32770, "ba"), (32768, "abab"), (32769, "𝒜b"), (7, None), (8, ""), (9, "a"), (5, "qrstuvwxyz"), (5, "qrstuvwxyz"), (2**40, "ab")]
    table = files(spark, *(dict(id=i, ocr_n=t) for i, t in rows))
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(table)
    for t in ("ab", "ba", "aab", "𝒜b", "uvw", "qrstuvwxyz", "qs"):
        got = sorted(x.id for x in index.hits(table, [t]).collect())
        assert got == sorted(i for i, o in rows if o and text_index.normalise(t)[0] in o), t
    changed = table.withColumn("ocr_n", F.when(F.col("id") == 0, "new").otherwise(F.col("ocr_n")))
    index.add(changed.where("id = 0"))
    assert sorted(x.id for x in index.hits(changed, ["ab", "new"]).where("q = 0").collect()) == sorted(i for i, o in rows if o and "ab" in o and i)
    assert [x.id for x in index.hits(changed, ["new"]).collect()] == [0]
    empty = TextIndex(spark, f"{tmp_path}/empty")
    empty.add(table.limit(0))
    assert empty.hits(table, ["ab", "cd"]).collect() == []


def test_texts_are_read_by_range(spark, tmp_path):
    rows = spark.range(200_000).select("id", F.concat(F.lit("common"), F.when(F.col("id").isin(70_001, 70_005, 150_000), "rare").otherwise("")).alias("ocr_n"), F.lit(False).alias("removed"), F.lit(None).cast("string").alias("taken"))
    rows.repartitionByRange(2, "id").sortWithinPartitions("id").write.option("parquet.page.row.count.limit", "2000").option("parquet.block.row.count.limit", "20000").parquet(f"{tmp_path}/files")
    table = spark.read.parquet(f"{tmp_path}/files")
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(table)
    hits = index.hits(table, ["nrare"])
    assert sorted(x.id for x in hits.collect()) == [70_001, 70_005, 150_000]
    assert scanned(hits) < 50_000
    assert narrow.spans(table, "id") == [(0, 200_703)]


def test_texts_are_not_dealt_by_query(spark, tmp_path):
    table = spark.range(2000).select("id", F.concat(F.lit("common"), F.col("id").cast("string")).alias("ocr_n"), F.lit(False).alias("removed"), F.lit(None).cast("string").alias("taken"))
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(table)
    hits = index.hits(table, ["common", "common19", "zz"], limit=5)
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [q#" not in plan and "ShuffledHashJoin [q#" not in plan
    assert sorted((x.q, x.id) for x in hits.collect()) == [(0, i) for i in range(1995, 2000)] + [(1, i) for i in range(1995, 2000) if str(i).startswith("19")]


def test_spans(spark, monkeypatch):
    ids = spark.createDataFrame([(x,) for x in (5, 1030, 9_000_000, -3, None)], "id long")
    assert narrow.spans(ids, "id") == [(-1024, 2047), (8_999_936, 9_000_959)]
    monkeypatch.setattr(narrow, "SPANS", 1)
    assert narrow.spans(ids, "id") == [(-1024, 9_000_959)]
    monkeypatch.setattr(narrow, "BLOCKS", 2)
    assert narrow.spans(ids, "id") is None
    assert sorted(x.id for x in narrow.narrowed(ids, "id", ids).collect()) == [-3, 5, 1030, 9_000_000]
    assert narrow.narrowed(ids, "id", ids.limit(0)).collect() == []


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_two_passes(spark, k):
    r = np.random.default_rng(k)
    v = r.normal(size=(400, 16))
    v[5], v[6] = v[4], v[4]  # ties
    own = [dict(id=i, kind=("image", "video", None)[i % 3], vec=x.tolist(), removed=i % 11 == 0, category="ab"[i % 2]) for i, x in enumerate(v)]
    own += [dict(id=900, vec=[float("nan")] * 16), dict(id=901, vec=[float("inf")] + [0.0] * 15, kind="video"), dict(id=902, vec=[1.0]), dict(id=903), dict(id=904, vec=[0.0] * 16), dict(id=905, kind="video", vec=[None] + [9.0] * 15)]
    table = files(spark, *own)
    parts = [(i, float(t), (v[i] + r.normal(size=16)).tolist()) for i in range(300) for t in range(2)] + [(905, 1.0, [50.0] * 16), (31, 9.0, [None] * 16), (34, 9.0, [1.0]), (4000, 0.0, [99.0] * 16)]
    segs = spark.createDataFrame(parts, "file_id long, t double, vec array<float>")
    q = r.normal(size=16).tolist()
    coded, seg_coded = two_pass.with_codes(table).cache(), two_pass.with_codes(segs).cache()
    gone = spark.createDataFrame([(3,)], "id long")
    for chosen, exclude in ((Filter(), None), (Filter(cat="b"), gone)):
        got = two_pass.ranked_by_codes(coded, seg_coded, q, chosen, k, exclude).select("id", "sim", "t").collect()
        want = search.ranked(table, segs, literal(q), 16, chosen, k, exclude).select("id", "sim", "t").collect()
        assert str(got) == str(want)  # nan equals itself so
    whole, parts = two_pass.asked_whole(coded, seg_coded, q, k=k)
    assert k > 300 or whole.count() <= k + 30 and parts.count() <= k + 30
    assert two_pass.ranked_by_codes(coded.limit(0), seg_coded.limit(0), q).collect() == []
