"""Tables in versions: a folder of partitions and manifests, of which a writer replaces those partitions that a batch touches.

A version is a JSON file that names the folder of each partition. New folders are written first and named by a version last, by
a rename that fails if another writer was faster; so a reader sees a whole version or the one before, and a writer that dies
leaves folders that no version names. A batch number in the manifest lets a batch that runs again be passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Versions:
    """A table at `path`, partitioned by the values of some columns. The driver knows the partitions, never their rows."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], schema: StructType, keep: int = 3):
        self.spark, self.path, self.columns, self.schema, self.keep = spark, path.rstrip("/"), columns, schema, keep
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._place(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in self._files.listStatus(folder) if x.getPath().getName().isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """Of a version, the newest by default: `batch`, and `partitions` as [[values, folder], ...]."""
        known = self.numbers()
        if not known:
            return {"number": 0, "batch": -1, "partitions": []}
        stream = self._files.open(self._place(f"{self.path}/versions/{number or known[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, number: int | None = None, wanted: list[tuple] | None = None) -> DataFrame:
        """The rows of a version; of the `wanted` partitions only, whose folders alone are read then."""
        found = [folder for values, folder in self.manifest(number)["partitions"] if wanted is None or tuple(values) in wanted]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found)

    def replace(self, rows: DataFrame, touched: list[tuple], before: dict, batch: int | None = None) -> int:
        """A new version in which `rows` stand for all rows of the touched partitions; a partition that gets none is gone. `before` is the
        manifest that the rows were made from; if another version has come since, this fails and changes nothing."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        inner = [f"_p{i}" for i in range(len(self.columns))]
        rows.select(*self.schema.names, *[F.col(c).cast("string").alias(p) for c, p in zip(self.columns, inner, strict=True)]).write.partitionBy(*inner).parquet(folder)
        new = self._partitions(folder, ())
        kept = [x for x in before["partitions"] if tuple(x[0]) not in set(touched)]
        stray = {v for v, _ in new} - set(touched)
        if stray:
            raise ValueError(f"rows of partitions that were not given: {sorted(stray, key=str)[:3]}")
        manifest = {"number": before["number"] + 1, "batch": before["batch"] if batch is None else batch, "partitions": kept + [[list(v), f] for v, f in new]}
        self._commit(manifest)
        self._clean()
        return manifest["number"]

    def _partitions(self, folder: str, values: tuple) -> list[tuple[tuple, str]]:
        """The partitions below a folder that was just written: their values, as its names give them, and folders."""
        if len(values) == len(self.columns):
            return [(values, folder)]
        out, names = [], self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for x in self._files.listStatus(self._place(folder)):
            name = x.getPath().getName()
            if x.isDirectory() and name.startswith(f"_p{len(values)}="):
                value = name.split("=", 1)[1]
                value = None if value == "__HIVE_DEFAULT_PARTITION__" else names.unescapePathName(value)
                out += self._partitions(f"{folder}/{name}", (*values, value))
        return out

    def _commit(self, manifest: dict) -> None:
        draft = self._place(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._place(f"{self.path}/versions/{manifest['number']}")
        self._files.mkdirs(target.getParent())
        if self._files.exists(target) or not self._files.rename(draft, target):
            raise RuntimeError(f"version {manifest['number']} was written by another writer")

    def _clean(self) -> None:
        """Removes versions but the last `keep`, and the partition folders that only those named."""
        known = self.numbers()
        old, live = known[: -self.keep], known[-self.keep :]
        if not old:
            return
        named = {f for n in live for _, f in self.manifest(n)["partitions"]}
        for n in old:
            for _, folder in self.manifest(n)["partitions"]:
                if folder not in named:
                    self._files.delete(self._place(folder), True)
            self._files.delete(self._place(f"{self.path}/versions/{n}"), False)


def newest_state(spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> Versions:
    """STR-03: a table of the newest record of each key, in buckets of the key's hash (column `bucket`)."""
    return Versions(spark, path, ["bucket"], StructType(schema.fields).add("bucket", "integer"), keep=2)


def upsert_newest(state: Versions, batch: DataFrame, keys: list[str], newest: list[Column], buckets: int = 64, number: int | None = None) -> int:
    """Takes a batch in; only the buckets that it touches are read and written. A number that is not above the last one is passed over.
    Of equal records the batch's counts, as it came later. Returns the version."""
    before = state.manifest()
    if number is not None and number <= before["batch"]:
        return before["number"]
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [(str(r.bucket),) for r in rows.select("bucket").distinct().collect()]
    if not touched:
        return before["number"]
    both = rows.withColumn("_age", F.lit(0)).unionByName(state.read(wanted=touched).withColumn("_age", F.lit(1)))
    # one row of each key, of the batch first on a tie: by a struct, so that rows of a hot key are combined before the shuffle
    names = state.schema.names
    order = F.struct(*newest, -F.col("_age"))
    found = both.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("row")).select("row.*")
    return state.replace(found, touched, before, number)


def keep_newest(log: DataFrame, state: Versions, checkpoint: str, keys: list[str], newest: list[Column], buckets: int = 64):
    """A streaming query that keeps the newest record of each key; a batch that runs again after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert_newest(state, batch, keys, newest, buckets, number)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def move_listings(store: Versions, batch: DataFrame, key: str) -> int:
    """SNK-03: puts listings into a store by their partition columns; a listing that was elsewhere leaves its old partition, and a partition
    that it leaves empty is gone. Of several rows of a key in the batch one stays. Only partitions that change are read whole and written."""
    before = store.manifest()
    rows = batch.groupBy(key).agg(F.max(F.struct(*[c for c in store.schema.names if c != key])).alias("row")).select(key, "row.*").select(*store.schema.names)
    values = [F.col(c).cast("string") for c in store.columns]
    old = store.read().select(key, *store.columns).join(rows.select(key), key, "left_semi")
    found = old.select(*values).unionByName(rows.select(*values)).distinct().collect()
    touched = [tuple(r) for r in found]
    if not touched:
        return before["number"]
    stay = store.read(wanted=touched).join(rows.select(key), key, "left_anti")
    return store.replace(stay.unionByName(rows), touched, before)
