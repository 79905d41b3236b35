"""The media source: what it reads, and how much of it."""

import hashlib
import io
import struct
import tracemalloc
import zipfile

import pytest

from strata.sources import media_files, media_ranges


def box(kind, body, long=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if long else struct.pack(">I4s", len(body) + 8, kind) + body


MVHD = box(b"mvhd", b"\0\0\0\0" + struct.pack(">I", 3_786_912_000) + b"\0" * 12)


def sparse_movie(path, size):
    """ftyp, an mdat of that size that is a hole, and a moov box behind it."""
    with open(path, "wb") as f:
        f.write(box(b"ftyp", b"qt  ") + struct.pack(">I4sQ", 1, b"mdat", size + 16))
        f.seek(size, 1)
        f.write(box(b"moov", box(b"trak", b"x" * 5000) + MVHD))


def in_task(root, *facts):
    """The rows of all partitions, read in this process."""
    source = media_ranges.MediaSource({"path": media_ranges.address(str(root)), "columns": ",".join(facts)})
    schema = source.schema()
    reader = source.reader(schema)
    return [dict(zip(schema.names, row)) for p in reader.partitions() for row in reader.read(p)]


def test_large_movie_by_its_headers(tmp_path):
    sparse_movie(tmp_path / "a.mp4", 3 << 30)
    tracemalloc.start()
    (row,) = in_task(tmp_path, "created", "moov")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["created"] == 3_786_912_000 and row["size"] > 3 << 30 and row["moov"].endswith(MVHD)
    assert row["touched"] < 20_000 < row["size"] // 100 and peak < 50 << 20
    (row,) = in_task(tmp_path, "created")
    assert row["touched"] < 200  # not even the movie header is read whole


def test_digest_in_pieces(tmp_path):
    sparse_movie(tmp_path / "a.mp4", 200 << 20)
    tracemalloc.start()
    (row,) = in_task(tmp_path, "sha256")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["touched"] == row["size"] and peak < 16 << 20
    with open(tmp_path / "a.mp4", "rb") as f:
        assert row["sha256"] == hashlib.file_digest(f, "sha256").hexdigest()


def test_damaged_movies():
    facts = lambda data: (media_files.movie_header(data), media_files.created(s := media_files.Ranges(data), media_files.movie_part(s)))
    whole = box(b"moov", MVHD)
    assert facts(box(b"free", b"") + whole) == (MVHD, 3_786_912_000)
    assert facts(whole[:20]) == facts(b"") == facts(b"\0\0\0\1mo") == facts(struct.pack(">I4s", 4, b"moov")) == (None, None)
    assert facts(struct.pack(">I4s", 0, b"moov") + MVHD) == (MVHD, 3_786_912_000)  # reaches to the end
    assert facts(box(b"moov", MVHD, long=True)) == (MVHD, 3_786_912_000)
    assert facts(box(b"moov", box(b"mvhd", b"\1\0\0\0" + struct.pack(">Q", 1 << 33) + b"\0\0\0\0")))[1] == 1 << 33
    assert facts(box(b"moov", box(b"trak", b"")))[1] is None


def test_source_in_spark(spark, tmp_path):
    sparse_movie(tmp_path / "a.mp4", 1 << 31)
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/media/big.bin", b"\1" * 300_000)
    (tmp_path / "sub").mkdir()
    for name, data in (("sub/B.docx", doc.getvalue()), ("sub/b.DOCX", b"later"), ("c.txt", ("é" * 40_000).encode()), ("d.pdf", b"%PDF"), (".hidden", b"x"), ("Thumbs.db", b"x"), ("e.jpg", b"\xff\xd8\xff"), ("f", b"")):
        (tmp_path / name).write_bytes(data)
    df = media_ranges.read_media(spark, str(tmp_path), "created", "text", "exif")
    rows = {r.name: r for r in df.collect()}
    assert set(rows) == {"a.mp4", "B.docx", "c.txt", "d.pdf", "e.jpg", "f"}
    assert rows["a.mp4"].created == 3_786_912_000 and rows["a.mp4"].kind == "video" and rows["a.mp4"].text is None
    assert rows["B.docx"].text == "first\nsecond" and rows["B.docx"].touched < 100_000 + rows["B.docx"].size
    assert rows["c.txt"].text == "é" * 6000 and rows["c.txt"].touched <= 24_001 and rows["d.pdf"].text is None
    assert rows["e.jpg"].exif.taken is None and rows["f"].size == 0 and rows["f"].exif is None
    shas = {r.name: r.sha256 for r in media_ranges.read_media(spark, f"file:{tmp_path}/sub", "sha256").collect()}
    assert shas == {"B.docx": hashlib.sha256(doc.getvalue()).hexdigest()}
    (tmp_path / "none").mkdir()
    assert media_ranges.read_media(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="no such facts"):
        media_ranges.read_media(spark, str(tmp_path), "colour").collect()


def test_partitions_by_bytes(tmp_path):
    for i in range(10):
        sparse_movie(tmp_path / f"{i}.mp4", 100 << 20)
    plan = lambda facts, **more: [len(p.files) for p in media_ranges.MediaReader(media_ranges.MediaSource({"columns": facts}).schema(), {"path": f"file://{tmp_path}", **more}).partitions()]
    assert plan("sha256") == [1] * 10  # a hundred MB each
    assert plan("created") == [10] and plan("created", filesATask="4") == [4, 4, 2]


def test_files_written_by_tasks(spark, tmp_path):
    own = spark.createDataFrame([(f"n{i}.txt", bytes([65 + i])) for i in range(5)] + [("empty.txt", None)], "name string, content binary").repartition(3)
    media_ranges.write_files(own, f"{tmp_path}/out")
    assert {r.name: r.text for r in media_ranges.read_media(spark, f"{tmp_path}/out", "text").collect()} == {**{f"n{i}.txt": chr(65 + i) for i in range(5)}, "empty.txt": ""}
