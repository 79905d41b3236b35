"""Neighbours, categories, sessions, readers and helpers against brute force and hand-made cases."""

import gzip
import hashlib
import io
import json
import os
import random
import struct
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import arrays, messages
from strata.operators import categories, ingest, neighbours
from strata.operators.categories import Categories, prototype_text
from strata.sources import media_files, settings
from strata.sources.shared import shared_dir
from strata.sources.snapshots import Snapshots
from strata.streaming import sessions

SF = "/root/testdata/sf0.001"


def drawn_vector(text: str, dim: int = 256) -> np.ndarray:
    """A unit vector that stands in for an embedding: normal numbers drawn from the text's MD5."""
    v = np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")).normal(size=dim)
    return v / (np.linalg.norm(v) + 1e-9)


def brute_near(rows, threshold, most):
    out = []
    for i, v in rows:
        best = sorted((-float(np.dot(v, w)), j) for j, w in rows if j < i and len(w) == len(v) and np.dot(v, w) >= threshold)[:most]
        out += [(i, j, round(-s, 9)) for s, j in best]
    return sorted(out)


@pytest.mark.parametrize("threshold, most", [(0.9, 1), (0.9, 3), (0.2, 2), (2.5, 1)])
def test_near_earlier(spark, monkeypatch, threshold, most):
    monkeypatch.setattr(neighbours, "ASKED_ROWS", 20)  # several cells and blocks
    monkeypatch.setattr(neighbours, "MET_ROWS", 30)
    r = np.random.default_rng(1)
    v = r.normal(size=(150, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(200 + i, v[3].tolist()) for i in range(60)] + [(300 + i, (1.7 * v[i]).tolist()) for i in range(20)] + [(400, [1.0, 0.0]), (401, [1.0, 0.1]), (402, [3.0])]
    table = spark.createDataFrame([*rows, (500, None), (501, [])], "id long, vec array<double>").repartition(3)
    got = neighbours.near_earlier(table, threshold, most).collect()
    if most == 1:  # of equal vectors the first is met alone: which one of equals is told by the smaller id
        assert sorted((x.id, x.other, round(x.sim, 9)) for x in got) == brute_near(rows, threshold, 1)
    else:
        want = brute_near(rows, threshold, most)
        assert {(x.id, round(x.sim, 9)) for x in got} == {(i, s) for i, _, s in want} and len(got) == len(want)
    since = neighbours.near_earlier(table, threshold, 1, since=200).collect()
    assert sorted((x.id, x.other) for x in since) == [(i, j) for i, j, _ in brute_near(rows, threshold, 1) if i >= 200]
    assert neighbours.near_earlier(table.limit(0), threshold).collect() == []


def test_cells_prune(spark, monkeypatch):
    """Clusters whose members have a cosine of 0.5: at 0.97 few pairs meet, though one vector is long, and few of those are multiplied whole."""
    monkeypatch.setattr(neighbours, "ASKED_ROWS", 25)
    monkeypatch.setattr(neighbours, "COPY", 20)
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 64)) / 8
    v = np.repeat(centres, 50, axis=0) + r.normal(size=(2000, 64)) / 8
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[1::50] = v[::50] + 0.01 * r.normal(size=(40, 64))  # near copies
    v[7] *= 50
    own = spark.createDataFrame([(i, "x", x.tolist()) for i, x in enumerate(v)], "id long, label string, vec array<double>")
    layouts = neighbours._layouts(own, 0.97)
    asked, met = neighbours.in_cells(own, own, layouts, 0.97)
    a, b = ({r.cell: r["count"] for r in df.groupBy("cell").count().collect()} for df in (asked, met))
    assert sum(n * b.get(c, 0) for c, n in a.items()) < 0.2 * 2000**2 and sum(b.values()) <= 10 * 2000
    got = {x.id: (x.other, round(x.sim, 9)) for x in neighbours.near_earlier(own.select("id", "vec"), 0.97).collect()}
    assert got == {i: (j, s) for i, j, s in brute_near(list(enumerate(v)), 0.97, 1)} and len(got) >= 40
    able = np.ones((500, 500), bool)
    row, other, sim = neighbours._reaching(v[500:1000], v[1000:1500], able, layouts[64].axes, 0.97)
    whole = v[500:1000] @ v[1000:1500].T
    assert set(zip(row.tolist(), other.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(whole >= 0.97))))


@pytest.mark.parametrize("held", [64 << 20, 900])
def test_nearest_examples(spark, monkeypatch, held):
    monkeypatch.setattr(neighbours, "HELD_BYTES", held)
    r = np.random.default_rng(2)
    items = [(i, r.normal(size=3 if i % 4 else 2).tolist()) for i in range(40)]
    examples = [(i, "ab"[i % 2], r.normal(size=3 if i % 3 else 2).tolist()) for i in range(30, 70)]
    got = neighbours.nearest_examples(spark.createDataFrame(items, "id long, vec array<double>"), spark.createDataFrame(examples, "id long, label string, vec array<double>"), 3).collect()
    some = neighbours.nearest_examples(spark.createDataFrame(items, "id long, vec array<double>"), spark.createDataFrame(examples, "id long, label string, vec array<double>"), 3, 1.5).collect()
    assert {x.id: [t.other for t in x.top] for x in some} == {x.id: [t.other for t in x.top if t.sim >= 1.5] for x in got}
    assert len(got) == 40
    for x in got:
        v = dict(items)[x.id]
        want = sorted((-float(np.dot(v, w)), j, c) for j, c, w in examples if j != x.id and len(w) == len(v))[:3]
        assert [(t.other, t.label) for t in x.top] == [(j, c) for _, j, c in want]
        assert np.allclose([t.sim for t in x.top], [-s for s, _, _ in want])


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7919 % 1009, f"n{i}") for i in range(500)], "seq long, name string").repartition(5)
    got = ingest.numbered(rows, "seq", 41).orderBy("seq").collect()
    assert [x.id for x in got] == list(range(41, 541))


def test_categories(spark):
    own = Categories({"Food": ["a meal"], "Shots": ["a screen"], "Papers": ["a form"]}, {"Food": "F"}, "Shots", "Papers")
    more = own.add(" Pets ", "cats\n\n dogs \n")
    assert more.names == ["Food", "Shots", "Papers", "Pets"] and more.descriptions["Pets"] == ["cats", "dogs"]
    for bad in ("", "  ", "x" * 21, "a/b", "a.b", "a\tb", "Food", categories.UNSORTED):
        with pytest.raises(ValueError):
            own.add(bad, "x")
    with pytest.raises(ValueError):
        own.add("New", " \n ")
    assert len(categories.clean_descriptions([str(i) for i in range(20)])) == 12
    moved = own.edit("Shots", "Screens", ["one"])
    assert moved.names == ["Food", "Screens", "Papers"] and moved.screenshot == "Screens" and own.edit("Food", "Food", "x").names == own.names
    assert own.delete("Food").names == ["Shots", "Papers"]
    with pytest.raises(ValueError):
        own.delete("Shots")
    assert Categories.load(own.dump(), more) == Categories(own.descriptions, {n: own.emojis.get(n, categories.DEFAULT_EMOJI) for n in own.names}, "Shots", "Papers") and Categories.load(None, more) is more
    assert [(r.name, r.emoji, r.special) for r in own.listing(spark).orderBy("pos").collect()] == [("Food", "F", None), ("Shots", categories.DEFAULT_EMOJI, "screenshot"), ("Papers", categories.DEFAULT_EMOJI, "document")]
    assert prototype_text("Food", "a meal") == "Food: a meal" and prototype_text("美食", "一餐") == "美食：一餐" and prototype_text("Food", "Food on a plate") == "Food on a plate"
    assert {r.text for r in own.prototype_texts(spark).collect()} == {"Food: a meal", "Shots: a screen", "Papers: a form"}


def test_messages(spark):
    tables = {"zh": {"a": "甲", "b": "{x} 乙"}, "en": {"a": "{n} item{s} {are} in {place}", "c": "{n} box{es}"}}
    rows = [("a", "en", "1", "{x}"), ("c", "en", "2", None), ("b", "en", "1.0", "q"), ("b", "fr", "x", "{n}"), ("d", "en", None, "q"), (None, "en", "1", "q"), ("c", None, "1", "")]
    own = spark.createDataFrame(rows, "key string, lang string, n string, x string")
    got = own.select(messages.said(F.col("key"), tables, F.col("lang"), n=F.col("n"), x=F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["1 item is in {place}", "2 boxes", "q 乙", "{n} 乙", "d", None, "c"]
    assert own.select(messages.filled(F.lit("{a}{x}"), x=F.col("x")).alias("t")).first().t == "{a}{x}"
    assert own.select(messages.filled(F.lit("{a} b")).alias("t")).first().t == "{a} b"


def test_name_and_description_columns(spark):
    own = Categories({"Food": ["a meal"], "Shots": ["a screen"]}, {}, "Shots", "Food")
    names = ["", None, " ", "ok", " ok ", "Food", "x" * 20, "x" * 21, "a/b", "a.b", "a\\b", "a\nb", categories.UNSORTED, "日" * 20, "two words"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", categories.name_fault(F.col("n"), own.names).alias("f")).orderBy("i").collect()
    for n, r in zip(names, got):
        try:
            own.checked_name(n)
            assert r.f is None, n
        except ValueError as e:
            assert (r.f or "none") in str(e) or r.f == "form", n
    texts = ["cats\n\n dogs \n", "", None, "a\r\nb\x0bc", "\n".join(map(str, range(20))), "one"]
    for t, r in zip(texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", categories.descriptions(F.col("t")).alias("d")).orderBy("i").collect()):
        try:
            assert r.d == categories.clean_descriptions(t or "")
        except ValueError:
            assert r.d == []


def test_settings_and_gazetteer(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"temperature": 20, "files_dir": "/a"}))
    (tmp_path / "b.json").write_text(json.dumps({"min_confidence": 0.5, "files_dir": " "}))
    own = settings.load_settings(spark, f"{tmp_path}/a.json", f"{tmp_path}/none.json", f"{tmp_path}/b.json")
    assert (own["temperature"], own["min_confidence"], own["files_dir"], own["near_duplicate"]) == (20, 0.5, "/a", 0.97)
    with gzip.open(tmp_path / "g.json.gz", "wt", encoding="utf-8") as f:
        json.dump({"countries": {"fr": "France"}, "tw": {"names": [["P", "Q"]], "pts": [[25.0, 121.5, 0]]}, "cities": [["Paris", "fr", 48.85, 2.35], ["X", "zz", 1, 2]]}, f)
    districts, cities = settings.load_gazetteer(spark, f"{tmp_path}/g.json.gz")
    assert [tuple(r.place) for r in districts.collect()] == [("P", "Q")] and sorted(tuple(r.place) for r in cities.collect()) == [("France", "Paris"), ("zz", "X")]
    with pytest.raises(FileNotFoundError):
        settings.load_gazetteer(spark, f"{tmp_path}/none")
    default = Categories({"Food": ["a meal"]})
    assert settings.load_categories(spark, f"{tmp_path}/none", default) is default


# ---- sessions


def test_session_answers():
    s = sessions.Session()
    assert s.answer("upload", "a", None, True) == [("a", "refused")] and s.answer("open", None, [], True) == [] and not s.open
    assert s.answer("open", None, ["b", "a"], True) == [("a", "expected"), ("b", "expected")]
    assert s.answer("upload", "a", None, False) == [("a", "rejected")] and s.answer("upload", "a", None, True) == [("a", "received")]
    assert s.answer("upload", "a", None, True) == [("a", "repeated")] and s.answer("upload", "c", None, True) == [("c", "refused")]
    assert s.answer("cancel", None, None, True) == [("b", "cancelled")] and s.answer("upload", "b", None, True) == [("b", "refused")]


class CountedState:
    """Map state in a dict, with the accesses counted."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def __getattr__(self, name):
        self.asked += 1
        return {"containsKey": self.held.__contains__, "getValue": self.held.get, "updateValue": self.held.__setitem__, "removeKey": self.held.pop, "iterator": lambda: iter(self.held.items()), "keys": lambda: iter(self.held), "clear": self.held.clear}[name]


@pytest.mark.parametrize("n", [10, 100_000])
def test_an_upload_costs_the_same_in_any_batch(n):
    state = CountedState()
    s = sessions.Session(files=sessions.KeyedFiles(state))
    assert len(s.answer("open", None, [f"f{i}" for i in range(n)] + [None, "f1"], True)) == n
    before = state.asked
    assert s.answer("upload", "f7", None, True) == [("f7", "received")] and s.answer("upload", "f7", None, True) == [("f7", "repeated")] and s.answer("upload", "g", None, True) == [("g", "refused")]
    assert state.asked - before == 6
    assert len(s.answer("cancel", None, None, True)) == n - 1 and state.asked - before == 8


def test_entries_are_asked_and_written_once():
    state = CountedState()
    files = sessions.Held(sessions.KeyedFiles(state), True)
    s = sessions.Session(files=files)
    s.answer("open", None, ["a", "b", "c"], True)
    assert s.answer("upload", "a", None, True) == [("a", "received")] and s.answer("upload", "a", None, True) == [("a", "repeated")] and s.answer("upload", "d", None, True) == [("d", "refused")]
    assert state.asked == 0
    files.flush()
    assert state.asked == 3 and state.held == {("a",): (True,), ("b",): (False,), ("c",): (False,)}
    files = sessions.Held(sessions.KeyedFiles(state), False)  # a later trigger
    s = sessions.Session(True, files)
    assert s.answer("upload", "b", None, False) == [("b", "rejected")] and s.answer("upload", "b", None, True) == [("b", "received")] and s.answer("upload", "a", None, True) == [("a", "repeated")]
    files.flush()
    assert state.asked == 8 and state.held[("b",)] == (True,)


def test_held_entries_equal_plain_ones():
    r = random.Random(5)
    for _ in range(300):
        state, plain, on = CountedState(), sessions.Session(), False
        for _ in range(4):  # triggers
            files = sessions.Held(sessions.KeyedFiles(state), not on)
            s = sessions.Session(on, files)
            for _ in range(r.randrange(6)):
                event = (r.choice(["open", "upload", "upload", "upload", "cancel"]), r.choice("abcd"), r.sample("abcd", r.randrange(4)), r.random() < 0.8)
                assert s.answer(*event) == plain.answer(*event)
            files.flush()
            on = s.open
            assert on == plain.open and {k[0]: v[0] for k, v in state.held.items()} == plain.files


def test_peers():
    from strata.streaming.peers import heard

    peer, out = heard(None, "a", 100, 50)
    assert out == [("a", 100, "new")]
    peer, out = heard(peer, "", 150, 50)
    assert (peer, out) == (("a", 150), [])
    peer, out = heard(peer, "b", 200, 50)
    assert out == [("b", 200, "renamed")]
    assert heard(peer, None, 190, 50) == (("b", 200), [])
    peer, out = heard(peer, "", 251, 50)
    assert out == [("b", 250, "gone"), ("", 251, "new")]


def test_sessions_expire(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    row = lambda batch, at, kind, fid=None, files=None, size=None, got=None: (batch, at, kind, fid, files, size, None, got, None)
    rounds = [
        [row("x", t, "open", files=["a", "b"]), row("x", t + timedelta(minutes=1), "upload", "a", size=5, got=5)],
        [row("y", t + timedelta(hours=3), "open", files=["c"]), row("y", t + timedelta(hours=3, minutes=1), "upload", "c", size=5, got=4)],
        [row("y", t + timedelta(hours=3, minutes=2), "upload", "c", size=5, got=5), row("x", t + timedelta(hours=3, minutes=3), "upload", "b", size=1, got=1)],
    ]
    for k, rows in enumerate(rounds):
        spark.createDataFrame(rows, sessions.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    for k in range(len(rounds)):  # one folder after another: a restart each time
        stream = spark.readStream.schema(sessions.EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in/[0-{k}]")
        sessions.serve(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "1 minute").start().awaitTermination()
    seen = sorted((r.batch, r.fid, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert seen == sorted([("x", "a", "expected"), ("x", "b", "expected"), ("x", "a", "received"), ("x", "b", "expired"), ("x", "b", "refused"), ("y", "c", "expected"), ("y", "c", "rejected"), ("y", "c", "received")])
    last = sessions.item_states(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted((r.batch, r.fid, r.status) for r in last.collect()) == [("x", "a", "received"), ("x", "b", "expired"), ("y", "c", "received")]


# ---- readers


def tiff(order, taken, lat, lon):
    """A small Exif block: main directory with make, the Exif and the GPS part."""
    pack = lambda f, *x: struct.pack(order + f, *x)
    heap, base = b"", 400

    def put(raw):
        nonlocal heap
        heap += raw
        return base + len(heap) - len(raw)

    def entry(tag, kind, n, value):
        return pack("HHI", tag, kind, n) + (value if isinstance(value, bytes) else pack("I", value))

    fractions = lambda xs: put(b"".join(pack("II", *x) for x in xs))
    main = [entry(0x010F, 2, 6, put(b"Maker\0")), entry(0x8769, 4, 1, 100), entry(0x8825, 4, 1, 200)]
    exif = [entry(0x9003, 2, 20, put(taken.encode() + b"\0"))]
    gps = [entry(1, 2, 2, b"S\0\0\0"), entry(2, 5, 3, fractions(lat)), entry(3, 2, 2, b"E\0\0\0"), entry(4, 5, 3, fractions(lon))]
    out = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8)
    for at, entries in ((8, main), (100, exif), (200, gps)):
        out = out.ljust(at, b"\0") + pack("H", len(entries)) + b"".join(entries) + pack("I", 0)
    return out.ljust(base, b"\0") + heap


@pytest.mark.parametrize("order", ["<", ">"])
def test_image_headers(spark, order):
    block = tiff(order, "2021:03:04 05:06:07", [(10, 1), (30, 1), (0, 0)], [(20, 1), (0, 1), (36, 1)])
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\x00\x02"
    rows = spark.createDataFrame([(0, bytearray(jpeg)), (1, bytearray(b"\xff\xd8\xff")), (2, None), (3, bytearray(jpeg[:90]))], "id long, content binary")
    facts = rows.select("id", media_files.image_facts("content").alias("f"))
    lat, lon = media_files.position(F.col("f"))
    got = {r.id: r for r in facts.select("id", "f.taken", "f.make", lat.alias("lat"), lon.alias("lon")).collect()}
    assert (got[0].taken, got[0].make) == ("2021:03:04 05:06:07", "Maker") and np.allclose([got[0].lat, got[0].lon], [-10.5, 20.01])
    assert all(got[k].taken is None and got[k].lat is None for k in (1, 2))


def test_documents(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    assert media_files.docx_text(held.getvalue()) == "one\ttwo\nthree" and media_files.docx_text(b"PK") is None and media_files.docx_text(None) is None
    rows = spark.createDataFrame([("a.DOCX", bytearray(held.getvalue())), ("b.txt", bytearray("é".encode() * 7000)), ("c.pdf", bytearray(b"%PDF"))], "name string, content binary")
    got = {r.name: r.text for r in rows.select("name", media_files.document_texts("name", "content").alias("text")).collect()}
    assert got["a.DOCX"] == "one\ttwo\nthree" and got["b.txt"] == "é" * 6000 and got["c.pdf"] is None


def test_scan_counts_names_once(spark, tmp_path):
    for n in ("a.JPG", "A.jpg", "b.txt", ".hidden", "Thumbs.db"):
        (tmp_path / n).write_text(n)
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(media_files.scan(spark, str(tmp_path))) == names(media_files.scan(spark, str(tmp_path), content=True)) == ["A.jpg", "b.txt"]
    assert all(len(r.sha256) == 64 for r in media_files.scan(spark, str(tmp_path), content=True).collect())
    with pytest.raises(ValueError):
        media_files.scan(spark, str(tmp_path), most=1)


def test_restore_backs_up(spark, tmp_path):
    own = Snapshots(spark, f"{tmp_path}/index")
    one = own.commit({"files": spark.range(3)})
    two = own.commit({"files": spark.range(5)})
    name = own.restore(one)
    assert own.current() == one and own.load("files").count() == 3
    kept = own.backups()
    assert [b["name"] for b in kept] == [name] and (kept[0]["version"], kept[0]["files"]) == (two, 5)
    with pytest.raises(ValueError):
        own.restore("none")


def paths(df):
    return {f.split("/index/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_updates_write_touched_parts_alone(spark, tmp_path):
    own = Snapshots(spark, f"{tmp_path}/index", part_ids=10)
    rows = spark.range(95).select(F.when(F.col("id") >= 0, F.col("id")).alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.col("id").cast("float")).alias("vec"))
    segs = spark.range(40).select((F.col("id") % 20).alias("file_id"), F.col("id").cast("double").alias("t"))
    one = own.commit({"files": rows, "segs": segs, "batches": spark.range(2)})
    held = paths(own.load("files"))
    assert len(held) == 10
    five = rows.where(F.col("id").isin(3, 4, 25, 93)).withColumn("name", F.lit("new")).unionByName(spark.createDataFrame([(200, "added", [1.0]), (None, "none", None)], "id long, name string, vec array<float>"))
    two = own.update("files", five, spark.createDataFrame([(26,), (999,)], "id long"))
    after = paths(own.load("files"))
    assert len(after - held) == 5 and len(held & after) == 7  # 0, 20, 90, 200 and the null key's; 999 had no part
    want = {i: f"n{i}" for i in range(95) if i != 26} | {3: "new", 4: "new", 25: "new", 93: "new", 200: "added", None: "none"}
    assert {r.id: r.name for r in own.load("files").collect()} == want and own.load("files").columns == ["id", "name", "vec"]
    assert own.load("files", one).count() == 95 and own.load("files", one).where("name = 'new'").count() == 0  # the older version still loads
    own.update("segs", spark.createDataFrame([(3, 0.5)], "file_id long, t double"))  # a file's segments are replaced together
    assert [r.t for r in own.load("segs").where("file_id = 3").collect()] == [0.5] and own.load("segs").count() == 39 and own.load("segs", two).count() == 40
    assert own.load("batches").count() == 2 and len(own.versions()) == 3
    before = own.load("files")
    own.update("files", rows.limit(0))
    assert paths(own.load("files")) == paths(before)
    own.update("files", rows.limit(0), own.load("files").select("id"))
    assert own.load("files").collect() == [] and own.load("files").columns == rows.columns
    with pytest.raises(ValueError):
        own.update("files_", rows) if "files_" in own.keys else Snapshots(spark, f"{tmp_path}/none").update("files", rows)


def test_pointer_survives_a_crash(spark, tmp_path, monkeypatch):
    own = Snapshots(spark, f"{tmp_path}/index")
    one = own.commit({"files": spark.range(3)})
    (tmp_path / "index/pointers" / f"{1:012d}").write_text("half a vers")  # a writer died while it wrote
    assert own.current() == one and own.load("files").count() == 3
    two = own.commit({"files": spark.range(4)})
    assert own.current() == two
    monkeypatch.setattr(Snapshots, "_pointers", lambda self: [f"{1:012d}"])  # another writer was faster
    with pytest.raises(Exception, match="exist"):
        own._point(one)
    monkeypatch.undo()
    rename = monkeypatch.setattr(Snapshots, "_write_text", lambda self, path, text: (_ for _ in ()).throw(OSError("can't rename")))  # noqa: F841
    with pytest.raises(OSError):
        own.commit({"files": spark.range(9)})
    monkeypatch.undo()
    assert own.current() == two and own.load("files").count() == 4
    for _ in range(12):
        last = own.commit({"files": spark.range(1)})
    assert own.current() == last and len(own._pointers()) <= 11


def test_shared_dir_needs_a_name_on_clusters():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


# ---- arrays


def test_ctc_and_boxes(spark):
    assert arrays.ctc_text([0, 1, 1, 0, 1, 2, 9], [0.9, 0.8, 0.1, 0.9, 0.6, 0.4, 0.9], ["", "a", "b"]) == ("aab", pytest.approx(0.6))
    assert arrays.ctc_text([], [], [""]) == ("", 0.0)
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]])
    grown = arrays.unclipped(square)
    assert np.allclose(grown, [[-3.75, -3.75], [13.75, -3.75], [13.75, 13.75], [-3.75, 13.75]])
    assert np.allclose(arrays.corners(square[[2, 0, 3, 1]]), square)
    flat, edge = np.full((8, 8), 7), np.tile([0, 0, 0, 0, 200, 200, 200, 200], (8, 1))
    assert arrays.sharpness(edge) > arrays.sharpness(flat)
    v = drawn_vector("x", 64)
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and np.allclose(v, drawn_vector("x", 64)) and not np.allclose(v, drawn_vector("y", 64))
    box = lambda text, left, top, height=10: (text, left, top, left + 5, top + height)
    # a line's first box is its anchor: c is within half a height of b, but not of a
    rows = [(1, [box("b", 20, 4), box("a", 0, 0), box("c", 40, 9), box("z", 0, 30)]), (2, []), (3, [box("q", 9, 0, 40), box("p", 0, 20, 10)])]
    table = spark.createDataFrame(rows, "id long, boxes array<struct<text:string,left:int,top:int,right:int,bottom:int>>")
    got = {r.id: r.text for r in table.select("id", arrays.reading_lines("boxes").alias("text")).collect()}
    assert got == {1: "a b\nc\nz", 2: "", 3: "p q"}


# ---- the index as one object


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_engine_changes(spark, tmp_path):
    from strata.engine import Engine
    from strata.plans import fixtures as fx

    own = Engine(fx.files(spark, SF), fx.segs(spark, SF), fx.batches(spark, SF), fx.items(spark, SF), 64)
    own.save(f"{tmp_path}/index")
    own = Engine.open(spark, f"{tmp_path}/index", 64)
    listed = Categories({f"cat_{i}": ["x"] for i in range(7)}, {}, "cat_1", "cat_4")
    assert own.status().first().removed == own.removed().count() and own.batch_page("all", limit=2).first().batches == own.batch_list("all", limit=500).count()
    renamed, more = own.rename_category(listed, "cat_2", "New", ["y"])
    assert more.names[2] == "New" and renamed.files.where("category = 'New'").count() == own.files.where("category = 'cat_2'").count()
    gone, fewer = renamed.delete_category(more, "New")
    assert "New" not in fewer.names and gone.files.where("category = 'New' and mode = 'sort'").count() == 0
    assert own.set_category([1, 2], "cat_6", listed).files.where("id in (1, 2) and category = 'cat_6'").count() == own.files.where("id in (1, 2) and mode = 'sort' and not removed").count()
    assert own.check([3]).files.where("id = 3 and checked").count() == 1 and own.confirm_batch("b1").files.where("batch = 'b1' and not reviewed").count() == 0
    cleared = own.clear_exact("b8", fx.probe(spark, SF), listed)
    assert cleared.files.count() == own.files.count() and cleared.files.where("removed").count() >= own.files.where("removed").count()
    assert own.similar(7, k=3).count() == 3
    with pytest.raises(ValueError):
        own.similar(10**9)
