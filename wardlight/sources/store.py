"""Tables in one folder that change together, one version at a time.

A store holds keyed tables (one row per key, in hash buckets) and logs (append-only). A change
writes its rows into fresh folders and becomes visible by one small file, the version's
manifest, that is renamed into place. A run that fails before leaves the version before as it
was; its folders are written over when the change is tried again.

    <path>/versions/<n>.json             the manifest: buckets of each keyed table, and notes
    <path>/<keyed table>/v=<n>/bucket=<b>
    <path>/<log>/v=<n>

Only the buckets that a delta touches are written again, so bytes written follow the delta.
Manifests carry the id of the streaming batch that they fold, so a batch that is delivered a
second time changes nothing. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.sources.tables import latest_per_key


class Files:
    """The few file operations a store needs, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file beside its place and rename it, so that it is seen whole or not at all."""
        draft = self.path(f"{name}.draft")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(draft, self.path(name)):
            raise OSError(f"could not publish {name}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """Keyed tables and logs under `path`; `buckets` counts from the first version on."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.buckets = self.manifest().get("buckets", buckets)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json"))

    def manifest(self) -> dict:
        """The latest version; version -1 has no tables."""
        known = self.versions()
        if not known:
            return {"version": -1, "batch": -1, "tables": {}, "notes": {}}
        return json.loads(self.files.read(f"{self.path}/versions/{known[-1]}.json"))

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, name: str, schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
        """A keyed table, or some of its buckets, as of the latest version."""
        held = self.manifest()["tables"].get(name, {})
        paths = [f"{self.path}/{name}/v={v}/bucket={b}" for b, v in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read_log(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """All rows of a log up to the latest version, by default with the columns it was last written with."""
        now = self.manifest()
        schema = schema or T.StructType.fromJson(now["notes"]["logs"][name])
        paths = [f"{self.path}/{name}/{v}" for v in self.files.names(f"{self.path}/{name}") if int(v[2:]) <= now["version"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def change(self, batch: int | None = None) -> Change | None:
        """A new version to be filled; None if that streaming batch is folded already."""
        now = self.manifest()
        return None if batch is not None and batch <= now["batch"] else Change(self, now, batch)

    def vacuum(self) -> None:
        """Remove what neither the latest version nor the one before refers to."""
        kept = self.versions()[-2:]
        manifests = [json.loads(self.files.read(f"{self.path}/versions/{v}.json")) for v in kept]
        for v in self.versions()[:-2]:
            self.files.remove(f"{self.path}/versions/{v}.json")
        for name in {n for m in manifests for n in m["tables"]}:
            used = {f"v={v}" for m in manifests for v in m["tables"].get(name, {}).values()}
            for folder in set(self.files.names(f"{self.path}/{name}")) - used:
                if int(folder[2:]) < kept[-1]:
                    self.files.remove(f"{self.path}/{name}/{folder}")


class Change:
    """The next version of a store, invisible until `commit`."""

    def __init__(self, store: Store, before: dict, batch: int | None):
        self.store, self.version = store, before["version"] + 1
        self.batch = before["batch"] if batch is None else batch
        self.tables = {name: dict(b) for name, b in before["tables"].items()}
        self.notes = dict(before["notes"])

    def folder(self, name: str) -> str:
        return f"{self.store.path}/{name}/v={self.version}"

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Write this version's rows of a log; a version tried again writes them over."""
        rows.write.mode("overwrite").parquet(self.folder(name))
        self.notes["logs"] = self.notes.get("logs", {}) | {name: rows.schema.jsonValue()}
        return self.store.spark.read.schema(rows.schema).parquet(self.folder(name))

    def once(self, name: str, make) -> DataFrame:
        """This version's rows of a log, made by `make()` unless a try before wrote them whole."""
        if "_SUCCESS" in self.store.files.names(self.folder(name)):
            return self.store.spark.read.parquet(self.folder(name))
        return self.append(name, make())

    def touched(self, rows: DataFrame, keys: list[str]) -> set[int]:
        """Buckets that hold the keys of `rows`."""
        return {r[0] for r in rows.select(self.store.bucket(keys)).distinct().collect()}  # `buckets` rows at most

    def replace(self, name: str, rows: DataFrame, keys: list[str], touched: set[int]) -> None:
        """`rows` become all rows of the touched buckets of a keyed table."""
        held = self.tables.setdefault(name, {})
        for b in touched:
            held.pop(str(b), None)
        if not touched:
            return
        dealt = rows.withColumn("bucket", self.store.bucket(keys)).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.folder(name))
        for folder in self.store.files.names(self.folder(name)):
            if folder.startswith("bucket="):
                held[folder[7:]] = self.version

    def merge(self, name: str, delta: DataFrame, keys: list[str], order: list[str]) -> None:
        """Rows of `delta` enter a keyed table; of each key the newest by `order` stays.

        A row older than the stored one loses, so merging the same rows twice changes nothing.
        `delta` is read twice and must be a written table.
        """
        touched = self.touched(delta, keys)
        rows = self.store.read(name, delta.schema, touched).unionByName(delta)
        ties = [c for c in delta.columns if c not in order]
        self.replace(name, latest_per_key(rows, keys, [*order, *ties]), keys, touched)

    def commit(self) -> int:
        manifest = {
            "version": self.version,
            "batch": self.batch,
            "buckets": self.store.buckets,
            "tables": self.tables,
            "notes": self.notes,
        }
        self.store.files.publish(f"{self.store.path}/versions/{self.version}.json", json.dumps(manifest))
        self.store.vacuum()
        return self.version


class KeyedTable:
    """One row per key on disk, changed by deltas: a store with a single table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64):
        self.store, self.schema, self.keys, self.order = Store(spark, path, buckets), schema, keys, order

    def read(self) -> DataFrame:
        return self.store.read("rows", self.schema)

    def upsert(self, delta: DataFrame, batch: int | None = None) -> None:
        """Newest row per key wins; with `batch`, a streaming batch that was folded before is left out."""
        change = self.store.change(batch)
        if change is None:
            return
        rows = delta.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        written = change.append("delta", rows)
        change.merge("rows", written, self.keys, self.order)
        change.commit()
        for folder in self.store.files.names(f"{self.store.path}/delta"):
            self.store.files.remove(f"{self.store.path}/delta/{folder}")
