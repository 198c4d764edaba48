import threading
import zlib

import pytest
from pyspark.sql import functions as F

from lantern.llm import queries, shards


def test_of_racing_writers_one_wins(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.range(3).withColumn("text", F.lit("x")), 0)
    base, listed, won, lost = store.version(), store.shards(), [], []
    gate = threading.Barrier(6)

    def write():
        gate.wait()
        try:
            won.append(store.commit(listed, base))
        except shards.Conflict:
            lost.append(1)

    threads = [threading.Thread(target=write) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won == [base + 1] and len(lost) == 5 and store.version() == base + 1
    assert not [p for p in (tmp_path / "store/manifests").iterdir() if p.name.startswith("draft")]


def test_a_slower_append_follows(spark, tmp_path, monkeypatch):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.range(5), 0)
    real, first = shards.ShardStore.commit, []

    def commit(self, listed, base):
        if not first:  # another writer is faster once
            first.append(1)
            real(self, self.shards(base), base)
        return real(self, listed, base)

    monkeypatch.setattr(shards.ShardStore, "commit", commit)
    assert store.append(spark.range(5, 8), 1) == 3
    assert sorted(r["id"] for r in store.read().collect()) == list(range(8))


def test_versions_stay_until_vacuum(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", fanout=2)
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1), k)
    before = store.version()
    last = store.compact()
    assert last > before and len(store.shards()) < 4
    assert store.read(before).count() == store.read(last).count() == 40
    store.vacuum(keep=2)
    assert store.read(last).count() == store.read(last - 1).count() == 40
    store.vacuum()
    assert store.read(last).count() == 40 and store.version() == last
    with pytest.raises(Exception):  # noqa: B017
        store.read(before).count()


def test_session_settings_stay(spark, tmp_path):
    names = [f"spark.sql.files.{k}" for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")]
    before = [spark.conf.get(n, None) for n in names]
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", fanout=2)
    store.append(spark.range(10).repartition(4), 0)
    store.compact()
    assert [spark.conf.get(n, None) for n in names] == before


def test_query_gives_what_is_stored(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op5_tiered_shards(spark, path).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["text_crc32"]) for r in rows} == {k: (None, None) if t is None else (len(t.encode()), zlib.crc32(t.encode())) for k, t in texts.items()}
    assert {r["shard"] for r in rows} == set(range(rows[0]["n_shards"]))
