"""A store of tables by entry, in immutable files: versions, safe writers, reading back in time, compaction.

A version is a manifest that lists layers. A layer is a folder with the ids of the entries that it writes and their rows of each table;
it replaces these entries in all layers below it. Files are never changed: a writer adds a layer, and then a manifest under the
next number. A manifest that is there is never replaced, so of two writers one sees the other's and goes on from it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKET, LAYER = "entry_bucket", "_layer"


class Conflict(Exception):
    """Another writer's versions could not be joined with this one's."""


class Folder:
    """Small files below a path, of whatever file system Spark reads it with."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, jvm = path.rstrip("/"), spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.system = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._read = jvm.org.apache.commons.io.IOUtils.toByteArray

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        where = self._path(self.path)
        return [s.getPath().getName() for s in self.system.listStatus(where)] if self.system.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(self._read(stream)).decode()
        finally:
            stream.close()

    def add(self, name: str, text: str) -> bool:
        """Writes a file that is whole as soon as it is there; False if another one has the name."""
        draft = f".{name}-{uuid.uuid4().hex}"
        stream = self.system.create(self.at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # The empty claim is made by one writer only; the manifest's own name appears by a rename.
        won = self.system.createNewFile(self.at(f".claim-{name}"))
        if won:
            self.system.rename(self.at(draft), self.at(name))
        else:
            self.system.delete(self.at(draft), False)
        return won

    def delete(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def age_ms(self, name: str, now: int) -> int:
        return now - self.system.getFileStatus(self.at(name)).getModificationTime()


class SnapshotStore:
    """Tables with an `entry_id`, written and read by entry.

    path: the store's folder; schemas: the columns of each table, for a store that is new. An existing store keeps its own
    schemas and number of buckets; to ask for others raises ValueError. The number of layers grows with the
    writes since compact(), not with the entries.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, StructType] | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Folder(spark, f"{self.path}/manifests")
        found = self.latest()
        if found is None:
            if not schemas:
                raise ValueError(f"no store at {path}")
            self.schemas, self.buckets = schemas, buckets or 16
        else:
            self.schemas = {name: StructType.fromJson(s) for name, s in found["schemas"].items()}
            self.buckets = found["buckets"]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the store has {self.buckets} buckets, not {buckets}")
            if schemas and {n: s.simpleString() for n, s in schemas.items()} != {n: s.simpleString() for n, s in self.schemas.items()}:
                raise ValueError("the store has other tables or columns")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.manifests.names() if n.endswith(".json") and not n.startswith("."))

    def latest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the last one; None for an empty store."""
        known = self.versions()
        if version is None and known:
            version = known[-1]
        if version is None:
            return None
        if version not in known:
            raise ValueError(f"no version {version}")
        return json.loads(self.manifests.read(f"{version}.json"))

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.hash("entry_id"), F.lit(self.buckets)))

    def _write(self, tables: dict[str, DataFrame], entries: DataFrame | None = None) -> str:
        """A new layer, not yet part of any version. Without entries its ids are those of the rows that were written."""
        layer = uuid.uuid4().hex

        def add(name: str, df: DataFrame) -> None:
            self._keyed(df).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/layers/{layer}/{name}")

        for name, df in tables.items():
            add(name, df)
        if entries is None:
            entries = reduce(DataFrame.union, [self._layers(name, [layer]).select("entry_id") for name in tables])
        add("_ids", entries.select("entry_id").distinct())
        return layer

    def _commit(self, change, seconds: float = 120) -> int:
        """Writes the next version: change(layers of the last one) gives its layers."""
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            last = self.latest()
            version = last["version"] + 1 if last else 1
            text = {"version": version, "parent": last and last["version"], "buckets": self.buckets, "schemas": {n: s.jsonValue() for n, s in self.schemas.items()}, "layers": change(last["layers"] if last else [])}
            if self.manifests.add(f"{version}.json", json.dumps(text)):
                return version
            if version not in self.versions():  # another writer is between its claim and its manifest, or was lost there
                self._take_back(f".claim-{version}.json")
                time.sleep(0.2)
        raise Conflict(f"no version could be written in {seconds} seconds")

    def _take_back(self, claim: str, patience_ms: int = 30_000) -> None:
        """Frees a number whose writer was lost: one of those who wait moves the claim away, and back if it is not old."""
        old = f".old-{uuid.uuid4().hex}"
        clock = self.spark._jvm.System.currentTimeMillis
        if claim in self.manifests.names() and self.manifests.age_ms(claim, clock()) > patience_ms and self.manifests.system.rename(self.manifests.at(claim), self.manifests.at(old)):
            if self.manifests.age_ms(old, clock()) <= patience_ms:
                self.manifests.system.rename(self.manifests.at(old), self.manifests.at(claim))

    def put(self, tables: dict[str, DataFrame], entries: DataFrame | None = None) -> int:
        """Replaces entries by the rows of tables, and gives the new version. Tables that are left out have no rows for these entries.

        entries: (entry_id) of what is replaced; without it all entries of the tables. An entry without rows is deleted. A writer that
        is lost before the last step leaves the store as it was.
        """
        rows = {name: tables[name].select(*schema.names) if name in tables else self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        layer = self._write(rows, entries)
        return self._commit(lambda layers: [*layers, layer])

    def delete(self, entries: DataFrame) -> int:
        return self.put({}, entries)

    def _layers(self, name: str, layers: Sequence[str]) -> DataFrame:
        """The rows of a table in all layers, with the layer's place. Columns come from the store's schema, also where a layer is empty."""
        fields = [next(iter(self.schemas.values()))["entry_id"]] if name == "_ids" else self.schemas[name].fields
        schema = StructType([*fields, StructField(BUCKET, IntegerType())])
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/layers/{layer}/{name}").withColumn(LAYER, F.lit(k)) for k, layer in enumerate(layers)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema).withColumn(LAYER, F.lit(0))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version, or at the last one; a filter on entry_bucket reads only these files."""
        found = self.latest(version)
        layers = found["layers"] if found else []
        rows = self._layers(name, layers)
        if len(layers) > 1:  # each entry's rows count in the last layer that wrote it
            owner = self._layers("_ids", layers).groupBy("entry_id", BUCKET).agg(F.max(LAYER).alias(LAYER))
            rows = rows.join(owner, ["entry_id", BUCKET, LAYER], "left_semi")
        return rows.select(*self.schemas[name].names, BUCKET)

    def bucket_of(self, entry_id) -> int:
        """The bucket of an entry, for filters."""
        rows = self.spark.createDataFrame([(entry_id,)], StructType([next(iter(self.schemas.values()))["entry_id"]]))
        return self._keyed(rows).first()[BUCKET]

    def compact(self) -> int:
        """Joins the layers of the last version into one. Layers that other writers add meanwhile stay above it."""
        last = self.latest()
        if last is None or len(last["layers"]) < 2:
            return last["version"] if last else 0
        old = last["layers"]
        tables = {name: self.read(name, last["version"]).drop(BUCKET) for name in self.schemas}
        layer = self._write(tables)

        def change(layers: list[str]) -> list[str]:
            if layers[: len(old)] != old:
                raise Conflict("another compaction was first")
            return [layer, *layers[len(old) :]]

        return self._commit(change)

    def vacuum(self, keep: int = 1, spare_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Deletes all versions but the last `keep`, and the layers that none of these has; layers younger than `spare_ms` may be another writer's and stay."""
        known = self.versions()
        for version in known[: max(0, len(known) - max(1, keep))]:
            self.manifests.delete(f"{version}.json")
        used = {layer for v in self.versions() for layer in self.latest(v)["layers"]}
        folder, now = Folder(self.spark, f"{self.path}/layers"), self.spark._jvm.System.currentTimeMillis()
        gone = [n for n in folder.names() if n not in used and folder.age_ms(n, now) >= spare_ms]
        for name in gone:
            folder.delete(name)
        return gone
