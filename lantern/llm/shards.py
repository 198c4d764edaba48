"""Sharding by size-tiered compaction.

A store is a folder: data/ holds immutable Parquet shards, manifests/ one file for each version that lists the shards that
make it up, with their rows, bytes and tier. Arrivals are appended as small shards. Compaction takes the shards of one
tier (those of a similar size) once there are enough and merges whole shards into larger ones, up to files of the target
size; Spark packs them into tasks, so rows don't cross the network. A version counts from the moment at which its file
has its final name, which only one writer can give it; readers hold on to one version, and writers that were slower take
the newer one as their base. Shards that no kept version lists are deleted by vacuum.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """path: below the store's folder. tier: how often the size has grown by the factor of a tier."""

    path: str
    rows: int
    bytes: int
    tier: int
    run: int


class Conflict(Exception):
    """Another writer has committed the version first."""


class ShardStore:
    """fanout: shards of a tier that make a merge, and the factor between the sizes of tiers; smallest: bytes of tier 0."""

    def __init__(self, spark: SparkSession, path: str, target: int = 256 << 20, smallest: int = 1 << 20, fanout: int = 4) -> None:
        self.spark, self.path, self.target, self.smallest, self.fanout = spark, path.rstrip("/"), target, smallest, fanout
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.smallest, self.fanout))) if size >= self.smallest else 0

    # manifests
    def version(self) -> int:
        """The newest version; 0 is the empty store."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        """One entry for each file: what the driver holds grows with the number of files only."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        text = self.spark.read.text(f"{self.path}/manifests/v{version:010d}.json").orderBy("value").collect()
        return [Shard(**json.loads(r["value"])) for r in text]

    def commit(self, shards: list[Shard], base: int) -> int:
        """Makes these the version after base, or raises Conflict if another writer was faster; then nothing has changed.

        The file is written under another name first and then gets its own, which fails if that is taken: on a local disk
        by a hard link, elsewhere by a rename that doesn't replace, one step in HDFS and the like. A store that renames by
        copying needs a file system that refuses to replace.
        """
        lines = "\n".join(json.dumps(asdict(s)) for s in sorted(shards, key=lambda s: s.path))
        draft, final = self._at(f"manifests/draft-{uuid.uuid4().hex}"), self._at(f"manifests/v{base + 1:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(lines.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":
                path = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(path(final), path(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {base + 1} is there already") from None
        finally:
            self._fs.delete(draft, False)
        return base + 1

    def _add(self, new: list[Shard]) -> int:
        """Commits more shards, after whatever other writers commit meanwhile."""
        while True:
            base = self.version()
            try:
                return self.commit([*self.shards(base), *new], base)
            except Conflict:
                continue

    # shards
    def written(self, folder: str, run: int) -> list[Shard]:
        """The files of a finished write, with their rows, which Spark counts by the files' footers."""
        rows = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(F.substring_index(F.input_file_name(), "/", -2).alias("name")).count().collect()
        found, walk = {r["name"]: r["count"] for r in rows}, self._fs.listFiles(self._at(folder), True)
        out = []
        while walk.hasNext():
            f = walk.next()
            path = f.getPath().toString()
            name = "/".join(path.rsplit("/", 2)[1:])  # files of one task have the same name in each arrival's folder
            if found.get(name):
                out.append(Shard(path[path.index(f"/{folder}/") + 1 :], found[name], f.getLen(), self.tier(f.getLen()), run))
        return out

    def append(self, rows: DataFrame, run: int) -> int:
        """Adds rows as new shards of their own, as many as the rows have partitions."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._add(self.written(folder, run))

    def adopt(self, shards: list[Shard], run: int) -> int:
        """Adds files that a job has written below the store as new shards."""
        return self._add([replace(s, run=run) for s in shards])

    def plan(self, shards: list[Shard]) -> list[Shard]:
        """The shards to merge next: those of the lowest tier that has enough below the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target * 3 // 4:
                tiers.setdefault(s.tier, []).append(s)
        return next((sorted(tiers[t], key=lambda s: (s.run, s.path)) for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merges until no tier has enough shards; each merge is a version. Returns the last version. If another writer
        commits meanwhile, the merge is thrown away and planned anew."""
        while merged := self.plan(shards := self.shards(base := self.version())):
            size = min(self.target, max(sum(s.bytes for s in merged) // max(len(merged) // self.fanout, 1), 1))
            own = self.spark.newSession()  # how files are packed into tasks is set for the merge only
            for k, v in {"maxPartitionBytes": size, "openCostInBytes": 0, "minPartitionNum": 1}.items():
                own.conf.set(f"spark.sql.files.{k}", v)
            folder = f"data/{uuid.uuid4().hex}"
            own.read.parquet(*[f"{self.path}/{s.path}" for s in merged]).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
            new = self.written(folder, max(s.run for s in merged))
            gone = {s.path for s in merged}
            if sum(s.rows for s in new) != sum(s.rows for s in merged):
                raise RuntimeError("a merge must keep all rows")
            try:
                base = self.commit([*(s for s in shards if s.path not in gone), *new], base)
            except Conflict:
                self._fs.delete(self._at(folder), True)
                continue
            if len(new) >= len(merged):
                break  # the shards are as large as they get
        return self.version()

    def vacuum(self, keep: int = 1, orphans: float = 86_400.0) -> None:
        """Forgets all but the newest versions, and deletes the shards that only the others list. Readers of those must
        have ended. Folders that no version lists go too when nothing has been written to them for so many seconds: an
        append that died has left them."""
        version = self.version()
        known = {s.path.split("/")[1] for v in range(version, 0, -1) if self._fs.exists(self._at(f"manifests/v{v:010d}.json")) for s in self.shards(v)}
        for f in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            if f.getPath().getName() not in known and time.time() - self._touched(f) > orphans:
                self._fs.delete(f.getPath(), True)
        listed = {s.path for v in range(max(version - keep, 0) + 1, version + 1) for s in self.shards(v)}
        for v in range(version - keep, 0, -1):
            name = self._at(f"manifests/v{v:010d}.json")
            if not self._fs.exists(name):
                break
            for s in self.shards(v):
                if s.path not in listed:
                    self._fs.delete(self._at(s.path), False)
            self._fs.delete(name, False)

    def _touched(self, folder) -> float:
        """When a folder or anything in it was last changed."""
        last, walk = folder.getModificationTime(), self._fs.listFiles(folder.getPath(), True)
        while walk.hasNext():
            last = max(last, walk.next().getModificationTime())
        return last / 1000

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self.spark.read.parquet(*[f"{self.path}/{s.path}" for s in self.shards(version)])


def arrive_and_compact(rows: DataFrame, arrivals: int, store: ShardStore, keep: int = 2) -> int:
    """Deals rows to so many arrivals by the hash of their id, commits each as small shards, and compacts now and then; the
    newest keep versions stay readable. All arrivals are written in one pass, each task adding a shard to each; an empty
    table leaves the store as it is."""
    folder = f"data/{uuid.uuid4().hex}"
    arrival, taken = "_arrival", {c.lower() for c in rows.columns}
    while arrival in taken:
        arrival = f"_{arrival}"
    dealt = rows.withColumn(arrival, F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(arrivals)))
    dealt.write.option("compression", "zstd").partitionBy(arrival).parquet(f"{store.path}/{folder}")
    new, version = store.written(folder, 0) if not rows.isEmpty() else [], store.version()
    for k in range(arrivals):
        if part := [s for s in new if f"/{arrival}={k}/" in s.path]:
            version = store.adopt(part, k)
            if k % 4 == 3:
                version = store.compact()
                store.vacuum(keep)
    version = store.compact() if version else version
    store.vacuum(keep)
    return version


def sharded(docs: DataFrame, path: str, arrivals: int = 8, **options) -> DataFrame:
    """doc_id, shard, n_shards, n_bytes and text_crc32 of every document as read back from the compacted store.

    shard: the place of its file among the newest version's, by path. n_bytes and text_crc32 are of the stored text in
    UTF-8 (null stays null). Repeated rows and rows with a null id are stored as they are, with all columns of docs.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path, **options)
    version = arrive_and_compact(docs, arrivals, store)
    if not version:
        return spark.createDataFrame([], "doc_id long, shard int, n_shards int, n_bytes long, text_crc32 long")
    names = sorted("/".join(s.path.rsplit("/", 2)[1:]) for s in store.shards(version))
    order = spark.createDataFrame(list(enumerate(names)), "shard int, name string")
    data = F.col("text").cast("string").cast("binary")
    rows = store.read(version).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), F.crc32(data).alias("text_crc32"), F.substring_index(F.input_file_name(), "/", -2).alias("name"))
    return rows.join(order, "name").select("doc_id", "shard", F.lit(len(names)).alias("n_shards"), "n_bytes", "text_crc32")
