"""Versioned tables in hash buckets, with one commit file for all that a step writes.

A table is cut into buckets by a hash of its keys.  A step rewrites the buckets it touches, below the number of its
version, and appends to logs; nothing that an earlier version refers to is ever changed.  A version begins to exist when
its commit file is renamed into place, which is the last thing a step does:

* a step that dies between two outputs leaves none of them visible, and running it again overwrites what it left;
* a step that runs again after its commit does nothing;
* every earlier version stays readable until ``forget`` drops it.

The commit file names, for each table, the version that holds each bucket.  It grows with the number of buckets, not
with the table or its history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 256


class Store:
    """Tables and logs below one folder.  One writer at a time, as a streaming query is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- commit files

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._children(f"{self.root}/_commits") if n.endswith(".json") and n[0].isdigit())

    def commit_of(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{version:010d}.json", wholetext=True).first()[0])

    def _commit(self, version: int, content: dict) -> None:
        final, fs = self._path(f"{self.root}/_commits/{version:010d}.json")
        staged, _ = self._path(f"{self.root}/_commits/.{version:010d}-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.rename(staged, final):
            raise RuntimeError(f"version {version} could not be committed")

    # --- buckets

    def _bucket(self, table: dict) -> Column:
        return F.pmod(F.xxhash64(*table["keys"]), F.lit(table["buckets"])).cast("int")

    def buckets_of(self, name: str, rows: DataFrame) -> set[int]:
        """Buckets of the keys in ``rows``; at most as many as the table has."""
        table = self.commit_of()["tables"][name]
        return {r[0] for r in rows.select(self._bucket(table).alias("b")).distinct().collect()}

    def _write(self, name: str, version: int, table: dict, rows: DataFrame) -> tuple[dict[str, int], int]:
        """-> (version of each bucket written, rows), counted while they are written."""
        seen = Observation(f"{name}-{version}")
        folder = f"{self.root}/{name}/version={version}"
        placed = rows.withColumn("_bucket", self._bucket(table)).repartition("_bucket")
        placed.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        written = [n.split("=")[1] for n in self._children(folder) if n.startswith("_bucket=")]
        return {b: version for b in written}, seen.get["rows"]

    # --- reading

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a version, or some of its buckets."""
        table = self.commit_of(version)["tables"][name]
        wanted = table["at"] if buckets is None else {str(b): table["at"][str(b)] for b in buckets if str(b) in table["at"]}
        schema = StructType.fromJson(table["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/version={v}/_bucket={b}" for b, v in sorted(wanted.items(), key=lambda x: int(x[0]))]
        return self.spark.read.schema(schema).parquet(*paths)

    def log(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a log up to a version, with ``version``; folders of steps that never committed are left out."""
        commit = self.commit_of(version)
        path = f"{self.root}/{name}"
        schema = StructType.fromJson(commit["logs"][name]["schema"]).add("version", IntegerType())
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(f"{path}/version=*")
        return rows.filter(F.col("version").between(commit["logs"][name]["first"], commit["version"]))

    # --- writing

    def create(self, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = BUCKETS) -> None:
        """Version 0: whole tables with their keys."""
        if 0 in self.versions():
            return
        content: dict = {"version": 0, "tables": {}, "logs": {}, "counts": {}}
        for name, (rows, keys) in tables.items():
            table = {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue()}
            table["at"], content["counts"][name] = self._write(name, 0, table, rows)
            content["tables"][name] = table
        self._commit(0, content)

    def write(
        self,
        version: int,
        tables: dict[str, tuple[DataFrame, set[int]]],
        logs: dict[str, DataFrame],
        counted: dict[str, dict[str, Column]] | None = None,
    ) -> dict:
        """One step: whole new contents of the touched buckets of each table, and rows for the logs.

        ``counted`` names aggregates of a log, taken while it is written.  Gives the commit, with ``counts``.
        """
        if version in self.versions():
            return self.commit_of(version)
        content = self.commit_of(version - 1)
        content |= {"version": version, "counts": {}}
        for name, (rows, touched) in tables.items():
            table = content["tables"][name]
            schema = StructType.fromJson(table["schema"])
            new, content["counts"][name] = self._write(name, version, table, rows.select(schema.names))
            table["at"] = {b: v for b, v in table["at"].items() if int(b) not in touched} | new
        for name, rows in logs.items():
            seen = Observation(f"{name}-{version}")
            wanted = {"rows": F.count(F.lit(1))} | (counted or {}).get(name, {})
            observed = rows.observe(seen, *[c.alias(n) for n, c in wanted.items()])
            observed.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
            content["counts"][name] = seen.get
            content["logs"].setdefault(name, {"first": version})["schema"] = rows.schema.jsonValue()
        self._commit(version, content)
        return content

    def set_aside(self, name: str, version: int, rows: DataFrame) -> DataFrame:
        """What a step works out and reads more than once, in compressed columns until ``clear``; a replay overwrites it."""
        folder = f"{self.root}/_aside/version={version}/{name}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def clear(self, version: int) -> None:
        """Drops what a step has set aside."""
        path, fs = self._path(f"{self.root}/_aside/version={version}")
        fs.delete(path, True)

    def forget(self, before: int) -> None:
        """Drops versions before one, and the bucket folders that no later version refers to.  Logs stay whole."""
        kept = [v for v in self.versions() if v >= before]
        used = {(n, b, v) for k in kept for n, t in self.commit_of(k)["tables"].items() for b, v in t["at"].items()}
        names = set(self.commit_of(kept[-1])["tables"])
        for old in (v for v in self.versions() if v < before):
            path, fs = self._path(f"{self.root}/_commits/{old:010d}.json")
            fs.delete(path, False)
        for name in names:
            for folder in self._children(f"{self.root}/{name}"):
                version = int(folder.split("=")[1])
                for child in self._children(f"{self.root}/{name}/{folder}") if version < before else []:
                    if child.startswith("_bucket=") and (name, child.split("=")[1], version) not in used:
                        path, fs = self._path(f"{self.root}/{name}/{folder}/{child}")
                        fs.delete(path, True)
