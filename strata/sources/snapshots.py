"""The index as versioned snapshots: tables laid out by ranges of ids in Parquet, a manifest for each version, and pointers to the version in use.

A table with a key (``KEYS``) lies in parts of PART_IDS keys each. A version's manifest names the parts of every table, and
an update writes those alone that hold a changed key; all others are shared with the version before, which
still loads. A version is complete before a pointer names it, so readers see all of a change or none; pointers are numbered, are
never replaced, and the highest complete one counts. A backup is a version that is kept, a restore a
new pointer to an old one. Of two writers at once one gets an error.

Defined results: rows with a null key lie in a part of their own; an update without changed keys makes a version that shares all
parts; a table of no rows has no parts and loads with its columns.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.shared import written

MANIFEST_TYPE = "strata-index"
KEYS = {"files": "id", "segs": "file_id"}
PART_IDS, POINTERS = 100_000, 10


@dataclass
class Snapshots:
    spark: SparkSession
    root: str
    part_ids: int = PART_IDS
    keys: dict[str, str] = field(default_factory=lambda: dict(KEYS))

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _create(self, path: str, text: str) -> None:
        """A new file; an error if there is one of that name."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _write_text(self, path: str, text: str) -> None:
        """A file of a name that nothing has yet: written beside and renamed, so that it is whole when it appears."""
        fs, p = self._fs(path)
        beside = f"{path}.{uuid.uuid4().hex}"
        self._create(beside, text)
        if not fs.rename(self._fs(beside)[1], p):
            raise OSError(f"can't rename to {path}")

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text

    def _pointers(self) -> list[str]:
        """Names of the pointers, the newest first."""
        fs, p = self._fs(f"{self.root}/pointers")
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((n for n in found if n.isdigit()), reverse=True)

    def _point(self, version: str) -> None:
        """The next pointer; its last character makes it complete. Old ones go."""
        known = self._pointers()
        self._create(f"{self.root}/pointers/{int(known[0]) + 1 if known else 0:012d}", f"{version}\n")
        for name in known[POINTERS:]:
            fs, p = self._fs(f"{self.root}/pointers/{name}")
            fs.delete(p, False)

    def current(self) -> str | None:
        for name in self._pointers():
            text = self._read_text(f"{self.root}/pointers/{name}")
            if text and text.endswith("\n"):
                return text[:-1]
        return None

    def _part_of(self, df: DataFrame, name: str) -> Column:
        key = self.keys.get(name)
        return F.lit(0).cast("long") if key not in df.columns else F.coalesce(F.floor(F.col(key) / self.part_ids).cast("long"), F.lit(-1).cast("long"))

    def _lay_out(self, version: str, name: str, df: DataFrame) -> dict[str, str]:
        """Writes rows by part, and returns the folder of each part."""
        place = f"{self.root}/data/{version}/{name}"
        dealt = df.withColumn("__part", self._part_of(df, name))
        if self.keys.get(name) in df.columns:
            dealt = dealt.repartition("__part")  # a file a part, of PART_IDS keys
        dealt.write.partitionBy("__part").parquet(place)
        fs, p = self._fs(place)
        found = [x.getPath().getName() for x in fs.listStatus(p)]
        return {n.removeprefix("__part="): f"data/{version}/{name}/{n}" for n in found if n.startswith("__part=")}

    def _publish(self, version: str, tables: dict, note: str) -> str:
        self._write_text(f"{self.root}/versions/{version}/manifest.json", json.dumps({"type": MANIFEST_TYPE, "created": version[:13], "tables": tables, "note": note}))
        self._point(version)
        return version

    def commit(self, tables: dict[str, DataFrame], note: str = "") -> str:
        """Writes all tables as a new version and points to it."""
        version = _version()
        return self._publish(version, {name: {"schema": _nullable(df), "parts": self._lay_out(version, name, df)} for name, df in tables.items()}, note)

    def update(self, name: str, rows: DataFrame, gone: DataFrame | None = None, note: str = "") -> str:
        """A new version in which ``rows`` stand in place of all rows of their keys, and keys in ``gone`` (a column of the key's name) have none.

        Only the parts that hold such a key are read and written.
        """
        key, before = self.keys[name], self._manifest(self.current() or "")
        if name not in before.get("tables", {}):
            raise ValueError(f"there is no table {name} to update")
        held, version = before["tables"][name], _version()
        rows = written(rows.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromJson(json.loads(held["schema"])))))
        asked = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(F.col(key).cast(rows.schema[key].dataType)))
        asked = written(asked.distinct())
        touched = [str(r[0]) for r in asked.select(self._part_of(asked, name)).distinct().collect()]  # parts, as many as the manifest names
        old = self._read(held["schema"], [held["parts"][k] for k in touched if k in held["parts"]])
        left = old.join(asked.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        new = self._lay_out(version, name, left.unionByName(rows)) if touched else {}
        parts = {k: v for k, v in held["parts"].items() if k not in touched} | new
        return self._publish(version, before["tables"] | {name: held | {"parts": parts}}, note)

    def _read(self, schema: str, parts: list[str]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], kind)

    def load(self, name: str, version: str | None = None) -> DataFrame:
        table = self._manifest(version or self.current() or "")["tables"][name]
        return self._read(table["schema"], [table["parts"][k] for k in sorted(table["parts"])])

    def versions(self) -> list[dict]:
        """Manifests of complete versions, newest first; what has no manifest of this type isn't one."""
        fs, p = self._fs(f"{self.root}/versions")
        found = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().getName()
            text = self._read_text(f"{self.root}/versions/{name}/manifest.json")
            manifest = json.loads(text) if text else {}
            if manifest.get("type") == MANIFEST_TYPE:
                found.append(manifest | {"version": name})
        return sorted(found, key=lambda m: m["version"], reverse=True)

    def backup(self, note: str = "") -> str:
        """Marks the version in use as a backup, with the number of its files; returns the backup's name."""
        version = self.current()
        if version is None:
            raise ValueError("there is no version to back up")
        name = _version()
        manifest = self._manifest(version)
        files = self.load("files", version).count() if "files" in manifest["tables"] else None
        self._write_text(f"{self.root}/backups/{name}.json", json.dumps({"type": MANIFEST_TYPE, "created": name[:13], "version": version, "files": files, "note": note}))
        return name

    def backups(self) -> list[dict]:
        """Backups whose version is whole, newest first."""
        fs, p = self._fs(f"{self.root}/backups")
        found = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().getName()
            entry = json.loads(self._read_text(f"{self.root}/backups/{name}") or "{}") if name.endswith(".json") else {}
            if entry.get("type") == MANIFEST_TYPE and self._manifest(entry["version"]).get("type") == MANIFEST_TYPE:
                found.append(entry | {"name": name[:-5]})
        return sorted(found, key=lambda e: e["name"], reverse=True)

    def _manifest(self, version: str) -> dict:
        text = self._read_text(f"{self.root}/versions/{version}/manifest.json")
        return json.loads(text) if text else {}

    def restore(self, version: str) -> str | None:
        """Points to an older version; the one in use is backed up before, and that backup's name returned."""
        if self._manifest(version).get("type") != MANIFEST_TYPE:
            raise ValueError(f"no such version: {version}")
        name = self.backup("before a restore") if self.current() else None
        self._point(version)
        return name


def _nullable(df: DataFrame) -> str:
    """The schema as JSON, as Parquet gives it back: anything may be null."""
    return re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', df.schema.json())


def _version() -> str:
    return f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:6]}"
