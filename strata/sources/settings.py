"""Settings, saved categories and the gazetteer, read through Spark's file systems."""

from __future__ import annotations

import gzip
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import constants
from strata.operators.categories import Categories

#: Settings and their defaults.
DEFAULTS = {
    "temperature": constants.TEMPERATURE, "min_confidence": constants.MIN_CONFIDENCE, "doubt_confidence": constants.DOUBT_CONFIDENCE, "doubt_close_ratio": constants.DOUBT_CLOSE_RATIO,
    "learn_similarity": constants.LEARN_SIMILARITY, "near_duplicate": constants.NEAR_DUPLICATE, "ocr_doc_chars": constants.OCR_DOC_CHARS, "ocr_doc_boost": constants.OCR_DOC_BOOST,
    "embed_dim": constants.EMBED_DIM, "video_seg_max": constants.VIDEO_SEG_MAX, "files_dir": "", "date_subfolder": True,
}


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's content; None if there is no such file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def settings(*layers: Mapping[str, object] | None) -> dict[str, object]:
    """The defaults under each layer in turn; the last one wins. An empty files_dir in a later layer leaves an earlier one."""
    out = dict(DEFAULTS)
    for layer in layers:
        out |= {k: v for k, v in (layer or {}).items() if k != "files_dir" or str(v or "").strip()}
    return out


def load_settings(spark: SparkSession, *paths: str) -> dict[str, object]:
    """Settings from JSON files, the last one first in rank; files that don't exist are passed over."""
    found = (read_bytes(spark, p) for p in paths)
    return settings(*(json.loads(x) for x in found if x))


def load_categories(spark: SparkSession, path: str, default: Categories) -> Categories:
    found = read_bytes(spark, path)
    return Categories.load(found.decode() if found else None, default)


def load_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(districts, cities) for geo.place_of from a gazetteer file (JSON, gzipped or not).

    The file has countries by code, tw (names as pairs, points as latitude, longitude and the name's number) and
    cities (name, country code, latitude, longitude); a city of an unknown country keeps its code.
    """
    raw = read_bytes(spark, path)
    if raw is None:
        raise FileNotFoundError(path)
    d = json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    names = [tuple(n) for n in d["tw"]["names"]]
    districts = [(*names[int(k)], float(lat), float(lon)) for lat, lon, k in d["tw"]["pts"]]
    cities = [(d["countries"].get(code, code), name, float(lat), float(lon)) for name, code, lat, lon in d["cities"]]
    made = (spark.createDataFrame(rows, "p1 string, p2 string, lat double, lon double") for rows in (districts, cities))
    return tuple(x.select(F.struct("p1", "p2").alias("place"), "lat", "lon") for x in made)
