"""Versions of partitioned Parquet tables: a base, and steps of deletes and inserts, published one by one.

A table lives in a folder. A change is staged as Parquet folders that nobody reads; to publish it, the
list of folders that make the table now is written as the next numbered file of ``log``, which fails
if somebody else wrote that number first. So readers see the old table or the new one whole, and of
writers at the same time none is lost: the later one's step is put behind the earlier one's if they
touch different partitions, and is refused if not. The visits that made the table stand in the same
file, so a visit and its rows are published together or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """What the store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_beside(self, path: str, text: str):
        fs, p = self._at(path)
        temporary = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temporary)
        stream.write(text.encode())
        stream.close()
        return fs, p, temporary

    def _rename(self, fs, temporary, p, mode) -> None:
        modes = self.jvm.java.lang.reflect.Array.newInstance(mode.getClass(), 1)
        modes[0] = mode
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(temporary, fs.makeQualified(p), modes)

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file and renames over it."""
        fs, p, temporary = self._write_beside(path, text)
        self._rename(fs, temporary, p, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def create(self, path: str, text: str) -> bool:
        """Writes a new file, whole at once; whether it was not there before."""
        fs, p, temporary = self._write_beside(path, text)
        try:
            self._rename(fs, temporary, p, self.jvm.org.apache.hadoop.fs.Options.Rename.NONE)
            return True
        except Py4JJavaError as error:
            fs.delete(temporary, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class VersionConflict(RuntimeError):
    """Another writer published a change that this one did not see and that it touches."""


class VersionedTable:
    """Rows of one schema with a key, partitioned by some columns, in versions of base, deletes and inserts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, partitions: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.key, self.partitions = spark, path.rstrip("/"), schema, key, tuple(partitions)
        self.files = Files(spark)

    def _state(self) -> dict:
        """The newest published state; its number is 0 before the first."""
        published = [n for n in self.files.names(f"{self.path}/log") if n.endswith(".json")]
        if not published:
            return {"number": 0, "base": [], "delta": [], "visits": []}
        return {"number": int(published[-1].split(".")[0]), **json.loads(self.files.read(f"{self.path}/log/{published[-1]}"))}

    def visits(self) -> set[int]:
        """The visits whose rows are in the table."""
        return set(self._state()["visits"])

    def _read(self, folders: Sequence[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # folders are of different versions, each with its own partition directories
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out.select([f.name for f in schema.fields])

    def read(self, staged: str | None = None) -> DataFrame:
        """The current rows, or those of a staged version: base without deleted keys, and the delta. A table never written is empty."""
        state = self._state()
        if staged:
            stage = json.loads(self.files.read(f"{self.path}/{staged}/STATE"))
            state = stage["state"] if stage["step"] is None else {"base": stage["state"]["base"], "delta": [*stage["state"]["delta"], stage["step"]]}
        out = self._read(state["base"], self.schema)
        for step in state["delta"]:
            if step["deletes"]:
                out = out.join(self._read([step["deletes"]], StructType([self.schema[self.key]])), self.key, "left_anti").select([f.name for f in self.schema.fields])
            if step["rows"]:
                out = out.unionByName(self._read([step["rows"]], self.schema))
        return out

    def _write(self, df: DataFrame, folder: str) -> str:
        writer = df.select([f.name for f in self.schema.fields]).write
        if self.partitions:
            # one writer for each partition of the table and task, not a file for every pair of them
            writer = df.select([f.name for f in self.schema.fields]).repartition(*self.partitions).write.partitionBy(*self.partitions)
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def stage_base(self, rows: DataFrame) -> str:
        """A version that has these rows and nothing else."""
        version, seen = uuid.uuid4().hex, self._state()
        return self._stage(version, {"number": seen["number"], "state": {"base": [self._write(rows, f"{version}/base")], "delta": []}, "step": None})

    def stage_delta(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None, touches: Sequence | None = None) -> str:
        """A version that takes keys of ``deletes`` out of the current one, then adds ``inserts``. Deleting twice is the same as once.

        touches: the partitions that the change was made from and goes to; all of them, if not said.
        """
        version, seen = uuid.uuid4().hex, self._state()
        step = {"deletes": None, "rows": None, "touches": None if touches is None else sorted(touches)}
        if deletes is not None:
            deletes.select(self.key).distinct().write.parquet(f"{self.path}/{version}/deletes")
            step["deletes"] = f"{version}/deletes"
        if inserts is not None:
            step["rows"] = self._write(inserts, f"{version}/delta")
        return self._stage(version, {"number": seen["number"], "state": {"base": seen["base"], "delta": seen["delta"]}, "step": step})

    def _stage(self, version: str, stage: dict) -> str:
        self.files.replace(f"{self.path}/{version}/STATE", json.dumps(stage))
        return version

    def commit(self, version: str, visit: int | None = None) -> None:
        """Publishes a staged version, and that ``visit`` made it.

        Raises VersionConflict if what was published since it was staged touches what it touches. A
        visit that is in the table already is not published again.
        """
        stage = json.loads(self.files.read(f"{self.path}/{version}/STATE"))
        seen, step = stage["state"], stage["step"]
        while True:
            now = self._state()
            if visit is not None and visit in now["visits"]:
                return
            if now["number"] != stage["number"]:
                since = now["delta"][len(seen["delta"]) :]
                apart = step is not None and step["touches"] is not None and now["base"] == seen["base"] and all(s["touches"] is not None and not set(s["touches"]) & set(step["touches"]) for s in since)
                if not apart:
                    raise VersionConflict(f"{self.path} has changed since version {version} was staged")
            made = {"base": seen["base"], "delta": seen["delta"]} if step is None else {"base": now["base"], "delta": [*now["delta"], step]}
            made["visits"] = [*now["visits"], *([] if visit is None else [visit])]
            if self.files.create(f"{self.path}/log/{now['number'] + 1:012d}.json", json.dumps(made)):
                return

    def rollback(self, version: str) -> None:
        """Discards a staged version."""
        self.files.delete(f"{self.path}/{version}")

    def compact(self) -> None:
        """Writes the current rows as a new base, which drops what was deleted."""
        self.commit(self.stage_base(self.read()))

    def deltas(self) -> int:
        return len(self._state()["delta"])
