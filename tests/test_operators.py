"""Rules that are easy to get wrong, on rows made by hand and against plain restatements."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from strata.constants import DUPLICATE, OTHER, UNSORTED
from strata.engine import Engine
from strata.functions import media, text, vectors
from strata.operators import classify, dedupe, export, filters, geo, ingest, mutate, neighbours, rollups, search
from strata.operators.filters import Filter
from strata.sources import media_files
from strata.sources.snapshots import Snapshots

FILES = (
    "id long, name string, path string, kind string, mode string, category string, score double, reason string, second string, second_score double, sha256 string, size long, duplicate_of long, batch string,"
    "taken string, received_at double, reviewed boolean, corrected boolean, checked boolean, removed boolean, prev_path string, place1 string, place2 string, geo boolean, vec array<float>, ocr string, ocr_n string, ocr_done int, seg_done int"
)
BASE = dict(name="n.jpg", path="sorted/a/n.jpg", kind="image", mode="sort", category="a", score=0.9, sha256="h", size=1, received_at=0.0, reviewed=False, corrected=False, checked=False, removed=False, geo=False, ocr="", ocr_n="", ocr_done=0, seg_done=0)


def files(spark, *rows):
    names = [c.split()[0] for c in FILES.replace("array<float>", "x").split(",")]
    return spark.createDataFrame([tuple((BASE | r).get(n) for n in names) for r in rows], FILES)


def test_roots_with_cycles_tails_and_lost_targets(spark):
    r = random.Random(0)
    for trial in range(3):
        dup = {i: r.choice([None, None, 0, *range(1, 45)]) for i in range(1, 40)}
        dup |= {50: 51, 51: 50, 52: 52, 53: 50, 54: 53, 55: 99, **{60 + i: 59 + i for i in range(1, 20)}, 60: None}
        gone = {7, 8, 99}
        alive = {k: v for k, v in dup.items() if k not in gone}

        def root(i):
            seen = set()
            while i in alive and alive[i] and i not in seen:
                seen.add(i)
                if alive[i] not in alive:
                    break
                i = alive[i]
            return i

        table = files(spark, *(dict(id=k, duplicate_of=v, removed=k in gone) for k, v in dup.items()))
        got = {x.id: x.root for x in dedupe.duplicate_roots(table).collect()}
        assert got == {k: root(k) for k, v in alive.items() if v}


def test_duplicate_groups(spark):
    v = [1.0, 0.0]
    table = files(spark, dict(id=1, sha256="a", vec=v, received_at=1.0), dict(id=2, sha256="a", duplicate_of=1, received_at=5.0), dict(id=3, sha256="b", vec=[0.6, 0.8], duplicate_of=2), dict(id=4, sha256=None, duplicate_of=9), dict(id=5, sha256=None))
    got = {(x.root, x.id): (x.is_root, x.exact, x.sim, x.latest) for x in dedupe.duplicate_groups(table).collect()}
    assert got == {(1, 1): (True, False, None, 5.0), (1, 2): (False, True, 1.0, 5.0), (1, 3): (False, False, 0.6, 5.0), (4, 4): (True, False, None, 0.0)}


def test_doubts(spark):
    rows = [dict(id=1, score=0.0, second="b", second_score=0.0), dict(id=2, score=0.5), dict(id=3, score=0.49), dict(id=4, score=0.5, second="b", second_score=0.3), dict(id=5, category=UNSORTED), dict(id=6, category=UNSORTED, reason="r"), dict(id=7, score=None), dict(id=8, score=0.1, reason="截圖檔名"), dict(id=9, duplicate_of=1), dict(id=10, duplicate_of=77), dict(id=11, score=0.1, checked=True), dict(id=12, mode="plain", score=0.1), dict(id=13, duplicate_of=1, reviewed=True), dict(id=14, score=0.125), dict(id=15, duplicate_of=1, sha256="other")]
    got = {r.id: r.doubt for r in rollups.reviewed_rows(files(spark, *rows)).collect()}
    assert got == {1: "low:0", 2: None, 3: "low:49", 4: "either:a|b", 5: "unsure", 6: "r", 7: None, 8: None, 9: "exact:n.jpg", 10: "dup", 11: None, 12: None, 13: None, 14: "low:12", 15: "similar:n.jpg"}


def test_batches_count_before_and_after_filters(spark):
    table = files(spark, dict(id=1, batch="x", reviewed=True), dict(id=2, batch="x", category="b", received_at=9.0), dict(id=3, batch=None), dict(id=4, batch="y", reviewed=True))
    none = spark.createDataFrame([], "id string, started_at double, sender string, mode string, count int")
    got = {r.bid: (r.total, r.reviewed, r.n, r.started_at) for r in rollups.batch_list(table, none, "pending").collect()}
    assert got == {"x": (2, 1, 1, 9.0), "legacy": (1, 0, 1, 0.0)}
    assert [r.bid for r in rollups.batch_list(table, none, "reviewed").collect()] == ["y"]
    assert [(r.bid, r.total, r.n) for r in rollups.batch_list(table, none, "all", "b").collect()] == [("x", 2, 1)]


def test_home_counts_every_pending_batch(spark):
    table = files(spark, *(dict(id=i, batch=f"b{i}") for i in range(1, 604)))
    none = spark.createDataFrame([], "id string, started_at double, sender string, mode string, count int")
    found = rollups.home(table, none, spark.createDataFrame([], "file_id long, t double, vec array<float>"), 2).first()
    assert (found.pending_batches, found.pending_files, found.total) == (603, 603, 603)


def test_ingest_computes_the_index_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def gone(x):
        asked.add(1)
        return x

    table = files(spark, *(dict(id=i, sha256=f"h{i}", path=f"p{i}", vec=[1.0, float(i)], corrected=i % 2 == 0) for i in range(1, 41))).withColumn("removed", gone("removed"))
    arrivals = spark.createDataFrame([(k, f"n{k}.jpg", f"in/n{k}.jpg", 1, f"h{k}", "2024-05", None, None, [1.0, 50.0 + k], "", False, None, "sort", "new", 1.0) for k in range(1, 60, 7)], "seq long, name string, path string, size long, sha256 string, taken string, lat double, lon double, vec array<float>, ocr string, camera boolean, shot string, mode string, batch string, received_at double")
    probe = table.select("path", F.lit(True).alias("exists"), "size", F.lit(True).alias("opens"), "sha256").where("path <> 'p8'")
    protos = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, vec array<double>")
    places = spark.createDataFrame([], "place struct<p1:string,p2:string>, lat double, lon double")
    done = ingest.ingest(table, arrivals, probe, protos, ["a", "b"], 2, places, places, near=1e9)
    got = {x.sha256: x.duplicate_of for x in done.where("batch = 'new'").select("sha256", "duplicate_of").collect()}
    assert got == {f"h{k}": k if k < 41 and k != 8 else None for k in range(1, 60, 7)}
    assert asked.value <= 2 * 40  # for the steps, and for the rows that are given back


def test_empty_index(spark):
    none = files(spark)
    segs = spark.createDataFrame([], "file_id long, t double, vec array<float>")
    batches = spark.createDataFrame([], "id string, started_at double, sender string, mode string, count int")
    engine = Engine(none, segs, batches, batches, 2)
    assert engine.home().first().total == 0 and engine.timeline().count() == 0 and engine.duplicates().count() == 0
    assert engine.search("two words", [1.0, 0.0]).count() == 0 and engine.counts().count() == 0


def test_unknown_and_places(spark):
    table = files(spark, dict(id=1, category=None), dict(id=2, category=""), dict(id=3, duplicate_of=1), dict(id=4, place1="P"), dict(id=5, place1="P", place2="Q"))
    assert {r.category: r.n for r in rollups.category_counts(table).collect()} == {"未知": 2, DUPLICATE: 1, "a": 2}
    assert [tuple(r) for r in rollups.places(table).collect()] == [("P", 2, "Q", 1)]


def test_text_matching():
    assert text.normalise("Ａb, ㎏-x")[0] == "abkgx" and text.normalise("ab, c")[1] == [0, 1, 4]
    assert text.normalise("臺灣", {"臺": "台", "灣": "湾"})[0] == "台湾"
    long = "line one\nsome words before the Needle, in it and many more words after that go on\nlast"
    hit = text.excerpt(long, "needle in")
    assert hit["text"][hit["a"] : hit["b"]] == "Needle, in" and "\n" not in hit["text"] and hit["text"].endswith("…")
    assert text.excerpt("abc", "zz") is None and text.excerpt(None, "a") is None and text.excerpt("abc", " ,") is None


def test_texts_are_normalised_in_slices(spark, monkeypatch):
    import pyarrow as pa

    r = random.Random(3)
    rows = [None, "", " ,", "İstanbul ﬁ Å Å ㎏ ẞ ｶﾞ", "臺灣"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randrange(90))) for _ in range(300)]
    monkeypatch.setattr(text, "BYTES_AT_ONCE", 100)
    parts = list(text._sliced(iter([pa.array(rows, pa.string())])))
    assert sum(parts, []) == rows and max(sum(len((t or "").encode()) for t in p) for p in parts if len(p) > 1) <= 100 and len(parts) > 100
    assert list(text._sliced(iter([pa.array([], pa.string())]))) == [[]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string")
    for simplify in (None, {"臺": "台"}):
        got = {x.i: x.n for x in table.select("i", text.norm_full(simplify)("t").alias("n")).collect()}
        assert got == {i: None if t is None else text.normalise(t, simplify)[0] for i, t in enumerate(rows)}


def test_search_prefers_better_segments(spark):
    table = files(spark, dict(id=1, kind="video", vec=[0.0, 1.0]), dict(id=2, vec=[0.8, 0.6]), dict(id=3, vec=[1.0, 0.0], removed=True), dict(id=4, kind="video", vec=[0.6, 0.8]), dict(id=5, vec=[1.0]), dict(id=6, vec=[0.0, 1.0], ocr="The Text", ocr_n="thetext"))
    segs = spark.createDataFrame([(1, 4.0, [1.0, 0.0]), (1, 8.0, [1.0, 0.0]), (4, 0.0, [0.6, 0.8])], "file_id long, t double, vec array<float>")
    got = [(r.id, r.t) for r in search.ranked(table, segs, vectors.literal([1.0, 0.0]), 2).collect()]
    assert got == [(1, 4.0), (2, None), (4, None), (6, None)]
    rows = search.search(table, segs, "the text", vectors.literal([1.0, 0.0]), 2).orderBy("section", "rank").collect()
    assert [(r.section, r.id) for r in rows] == [(0, 6), (1, 1), (1, 2), (1, 4)]
    assert search.text_hits(table, "t").count() == 0
    assert [r.id for r in search.similar(table, segs, 2, 2).collect()][:1] == [4]


def test_near_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKED_ROWS", 16)
    r = random.Random(1)
    vs = [[r.gauss(0, 1), r.gauss(0, 1)] for _ in range(60)]
    vs = [[x / (x * x + y * y) ** 0.5, y / (x * x + y * y) ** 0.5] for x, y in vs]
    table = files(spark, *(dict(id=i, vec=v) for i, v in enumerate(vs)))
    got = {x.id: x.other for x in search.near_pairs(table, 0.97, 2).collect()}
    f32 = [[struct.unpack("f", struct.pack("f", x))[0] for x in v] for v in vs]
    want = {}
    for i in range(60):
        near = [(sum(a * b for a, b in zip(f32[i], f32[j])), -j) for j in range(i)]
        near = [x for x in near if x[0] >= 0.97]
        if near:
            want[i] = -max(near)[1]
    assert got == want


def test_classification(spark):
    items = files(spark, dict(id=1, vec=[1.0, 0.0]), dict(id=2, vec=[0.0, 1.0], kind="video"), dict(id=3, vec=[0.7, 0.7]), dict(id=4, vec=[1.0])).withColumn("camera", F.lit(False)).withColumn("text_len", F.lit(0)).withColumn("shot", F.when(F.col("id") == 3, "截圖檔名"))
    protos = spark.createDataFrame([("a", [1.0, 0.0]), ("shots", [0.0, 1.0]), ("c", [-1.0, 0.0])], "name string, vec array<double>")
    examples = files(spark, dict(id=10, vec=[0.99, 0.1], category="c", corrected=True), dict(id=11, vec=[0.99, 0.1], category="lost", corrected=True))
    got = {r.id: (r.category, r.reason, r.second) for r in classify.cascade(items, examples, protos, ["a", "c", "shots"], 2, "shots").collect()}
    assert got[1] == ("c", "像你分類過的檔案", None) and got[3] == ("shots", "截圖檔名", None) and got[4] == (UNSORTED, "索引需要重建", None)
    assert got[2][0] != "shots"


def test_nearest_place_matches_brute_force(spark):
    import math

    r = random.Random(2)
    places = [(f"p{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(300)] + [("pole", 89.9, 10.0), ("east", 0.1, 179.9)]
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(300)] + [(900 + i, p[1] + 0.2, p[2] - 0.2) for i, p in enumerate(places[:80])] + [(990, 89.95, -170.0), (991, 0.0, -179.9)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return math.acos(max(-1, min(1, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)))) * 6371

    want = {}
    for i, lat, lon in points:
        d, p = min((km(lat, lon, a, b), p) for p, a, b in places)
        if d <= 80:
            want[i] = p
    got = geo.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "place string, lat double, lon double"), 80.0)
    assert {x.id: x.place for x in got.collect()} == want and {990, 991} <= set(want)


def test_nearest_place_groups_nothing_before_dealing(spark):
    points = spark.createDataFrame([(1, 89.9, 10.0), (1, 89.9, 10.0), (2, -40.0, 179.99), (2, -40.0, -179.99), (3, 0.0, 0.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([("pole", 90.0, -170.0), ("line", -40.0, -179.9), ("far", 5.0, 5.0)], "place string, lat double, lon double")
    got = geo.nearest(points, places, 80.0)
    assert sorted((x.id, x.place, round(x.km, 2)) for x in got.collect()) == [(1, "pole", 11.12), (2, "line", 7.67)]
    plan = got._jdf.queryExecution().sparkPlan().toString()  # the last operators first
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") if "Exchange" in plan else 0 :]



def test_places_prefer_near_districts(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 11.0), (3, 50.0, 50.0), (4, 0.0, 0.0)], "id long, lat double, lon double")
    kind = "place struct<p1:string,p2:string>, lat double, lon double"
    districts = spark.createDataFrame([(("D", "d"), 10.0, 10.05), (("D", "z"), 0.0, 0.0)], kind)
    cities = spark.createDataFrame([(("C", "c"), 10.0, 10.5)], kind)
    got = {r.id: (r.place1, r.place2) for r in geo.place_of(points, districts, cities).collect()}
    assert got == {1: ("D", "d"), 2: ("C", "c"), 3: (None, None), 4: (None, None)}


def test_changes(spark):
    table = files(spark, dict(id=1, sha256="s", vec=[1.0]), dict(id=2, sha256="s", duplicate_of=1, category=DUPLICATE, taken="2024-05"), dict(id=3, duplicate_of=1), dict(id=4, kind="other", category=OTHER))
    out = {r.id: r for r in mutate.resolve_duplicates(table, [2], [1], ["a"], "doc").collect()}
    assert out[1].removed and out[1].path == "removed/n.jpg" and out[1].prev_path == "sorted/a/n.jpg"
    assert (out[2].category, out[2].duplicate_of, out[2].vec, out[2].path, out[2].checked) == ("a", None, [1.0], "sorted/a/2024-05/n.jpg", True)
    assert out[3].duplicate_of == 2
    with pytest.raises(ValueError):
        mutate.resolve_duplicates(table, [], [1], ["a"], "doc")
    with pytest.raises(ValueError):
        mutate.resolve_duplicates(table, [1], [1], ["a"], "doc")
    gone = mutate.remove(mutate.remove(table, [2]), [1])
    back = {r.id: r for r in mutate.restore(gone, [2]).collect()}
    assert (back[2].removed, back[2].duplicate_of, back[2].category, back[2].path) == (False, None, UNSORTED, f"sorted/{UNSORTED}/2024-05/n.jpg")
    moved = mutate.set_category(table, [1], "b", ["b"])
    assert [tuple(r) for r in mutate.retarget(moved).where("id = 1").collect()] == [(1, "sorted/a/n.jpg", "sorted/b/n.jpg")]


def test_archive_names(spark):
    names = ["a.jpg", "a.jpg", "a (1).jpg", "A.JPG", "b", "b", "x.tar.gz", "x.tar.gz", "a (1).jpg"]
    rows = spark.createDataFrame([(i, "", n) for i, n in enumerate(names)], "pos int, folder string, name string")
    got = [r.target for r in export.archive_names(rows).orderBy("pos").collect()]
    used, want = set(), []
    for n in names:
        dot = n.rfind(".")
        stem, end = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        t, i = n, 1
        while t.lower() in used:
            t, i = f"{stem} ({i}){end}", i + 1
        used.add(t.lower())
        want.append(t)
    assert got == want


def test_snapshots(spark, tmp_path):
    own = Snapshots(spark, f"{tmp_path}/index")
    assert own.current() is None and own.versions() == []
    a = own.commit({"files": spark.range(3)}, "first")
    b = own.commit({"files": spark.range(5)})
    assert own.current() == b and own.load("files").count() == 5 and [m["version"] for m in own.versions()] == [b, a]
    own.restore(a)
    assert own.load("files").count() == 3
    with pytest.raises(ValueError):
        own.restore("nothing")


def test_headers(spark):
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    moov = box(b"mvhd", bytes(4) + struct.pack(">II", 3786912000, 0)) + b"+22.6273+120.3014+010.000/"
    film = box(b"ftyp", b"isom") + box(b"moov", moov) + b"rest"
    assert media_files.creation_seconds(media_files.movie_header(film)) == 3786912000
    assert media_files.movie_header(b"") is None and media_files.movie_header(film[:20]) is None
    row = spark.createDataFrame([(3786912000, "+22.6273+120.3014+010.000/", "2024:05:06 07:08:09", "2024-05-06T07:08:09Z", "bad")], "s long, loc string, exif string, iso string, bad string")
    lat, lon = media.iso6709("loc")
    got = row.select(media.seconds_since_1904("s").cast("string"), lat, lon, media.exif_date("exif").cast("string"), media.iso_date("iso").cast("string"), media.exif_date("bad"), media.degrees(F.lit(1.0), F.lit(30.0), F.lit(0.0), F.lit("S"))).first()
    assert tuple(got) == ("2024-01-01 00:00:00", 22.6273, 120.3014, "2024-05-06", "2024-05-06", None, -1.5)
    assert media_files.decode_text("é".encode("utf-16")) == "é" and media_files.decode_text("中文a".encode("cp950")) == "中文a" and media_files.decode_text(None) == ""


def test_folder_scan(spark, tmp_path):
    for name in ("a.JPG", "sub/b.mov", "sub/.hidden", "thumbs.db", "$bin/c.jpg"):
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {(r.name, r.kind, r.size) for r in media_files.scan(spark, f"{tmp_path}/lib").collect()}
    assert got == {("a.JPG", "image", 1), ("b.mov", "video", 1)}


def test_filters(spark):
    table = files(spark, dict(id=1, taken=None), dict(id=2, taken="2024-03"), dict(id=3, taken="2024-05", mode="plain", category="x"), dict(id=4, removed=True))
    ids = lambda f: [r.id for r in filters.listing(table, f).collect()]
    assert ids(Filter()) == [3, 2, 1] and ids(Filter(date_from="2024-04-30")) == [3] and ids(Filter(date_to="2024-03-01")) == [2]
    assert ids(Filter(cat="傳送")) == [3] and ids(Filter(cat="x")) == [] and ids(Filter(place="-")) == [3, 2, 1]
    assert [r.id for r in filters.multi_get(table, [3, 9, 1, 3]).collect()] == [3, 1, 3]
