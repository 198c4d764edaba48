"""Tables in a shared folder that change in versions: a version is a small manifest, and readers see the newest one whole.

A keyed table lies in buckets by the hash of its keys. A merge reads and writes only the buckets that a batch names, and its
manifest takes the other ones over from the version before. Several tables that belong together are one version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed the same version first; nothing has changed."""


class _Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/v{version:010d}.json", wholetext=True).collect()))

    def commit(self, manifest: dict, base: int) -> int:
        """Makes the manifest the version after base. It is written under another name first and renamed, which fails where
        the name is taken."""
        draft, final = self._at(f"manifests/draft-{uuid.uuid4().hex}"), self._at(f"manifests/v{base + 1:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Exception as error:
            if not self._fs.exists(final):
                raise
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} of {self.path} is there already") from error
        return base + 1


class KeyedTable(_Folder):
    """A table by keys, in buckets. All writers must name the same keys and number of buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        super().__init__(spark, path)
        self.keys, self.buckets = keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Where the rows of each bucket are now; a bucket without rows has no place."""
        at = f"data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{at}")
        there = [f.getPath().getName() for f in self._fs.listStatus(self._at(at))]
        return {n.removeprefix("_bucket="): f"{at}/{n}" for n in there if n.startswith("_bucket=")}

    def create(self, df: DataFrame) -> int:
        base = self.version()
        return self.commit({"schema": df.schema.jsonValue(), "buckets": self._write(df)}, base)

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The whole table, or some of its buckets."""
        from pyspark.sql.types import StructType

        told = self.manifest(version)
        schema = StructType.fromJson(told["schema"])
        places = [p for b, p in told["buckets"].items() if buckets is None or int(b) in buckets]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in places])

    def merge(self, batch: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], retries: int = 3) -> int:
        """The version after a batch. step gives the new rows from the old ones and the batch, both of the buckets that the
        batch names; it must treat keys apart, as joins and groups by the keys do. If another writer was faster, the batch
        goes over that one's version."""
        named = [r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()]  # so many as there are buckets at most
        for left in range(retries, -1, -1):
            base = self.version()
            told = self.manifest(base)
            if not named:
                return base
            new = self._write(step(self.read(named, base), batch))
            kept = {b: p for b, p in told["buckets"].items() if int(b) not in named}
            try:
                return self.commit({"schema": told["schema"], "buckets": kept | new}, base)
            except Conflict:
                if not left:
                    raise
        raise AssertionError


class TableSet(_Folder):
    """Tables that change together: a version names a place for each, so readers never see one without the others."""

    def write(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        base, places = self.version() if base is None else base, {}
        for name, df in tables.items():
            places[name] = f"data/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{places[name]}")
        return self.commit({"tables": places}, base)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest(version)['tables'][name]}")
