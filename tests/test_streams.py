"""Streams against their batch twins."""

import shutil


import pytest
from pyspark.sql import functions as F

from docketry.operators import aggregates, joins, windows
from docketry.sources.manifest import Manifest
from docketry.streaming import triage


@pytest.fixture
def results(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("result_id"), F.col("event_id").alias("submission_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr("event_id div 20").alias("batch_id"), F.expr("event_id % 20").alias("item"), F.expr("event_id % 50").alias("case_no"),
    )
    path = str(tmp_path / "in")
    rows.repartitionByRange(3, "result_id").write.parquet(path)
    return rows, path


def stream(spark, rows, path):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer, tmp_path, name, mode):
    q = writer.outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_dedupe(spark, results, tmp_path):
    rows, path = results
    rows.write.mode("append").parquet(path)  # every submission once more
    out = triage.dedupe_submissions(stream(spark, rows, path), "60 days")
    drain(out.writeStream.format("memory").queryName("st1"), tmp_path, "st1", "append")
    got = [r[0] for r in spark.table("st1").select("submission_id").collect()]
    assert sorted(got) == sorted(r[0] for r in triage.first_submissions(rows).select("submission_id").collect())


def test_progress(spark, results, tmp_path):
    rows, path = results
    out = triage.stream_progress(stream(spark, rows, path), 20, "60 days")
    drain(out.writeStream.format("memory").queryName("st2"), tmp_path, "st2", "append")
    last = spark.table("st2").groupBy("batch_id").agg(F.max("done").alias("done"), F.max("closed").alias("closed"))
    twin = aggregates.batch_progress(rows, rows)
    assert sorted(map(tuple, last.collect())) == sorted((r["batch_id"], r["done"], r["closed"]) for r in twin.collect())


def progress(spark, tmp_path, files, ck="ck", delay="1 hour"):
    """Rows of stream_progress over files of (batch_id, item, hour), one a micro-batch, in order; 3 items close a batch."""
    import time

    folder = tmp_path / "files"
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "batch_id long, item long, hour long").select("batch_id", "item", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/new")
        part = next((tmp_path / "new").glob("part-*"))
        folder.mkdir(exist_ok=True)
        part.rename(folder / f"{len(list(folder.iterdir())):04d}.parquet")
        shutil.rmtree(tmp_path / "new")
        time.sleep(0.02)
    source = spark.readStream.schema("batch_id long, item long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = triage.stream_progress(source, 3, delay)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / ck)).trigger(availableNow=True).start()
    q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "sink")).collect())), state


def test_a_batch_closes_exactly_once(spark, tmp_path):
    one = [(1, 0, 10), (1, 1, 10), (1, 1, 10), (1, None, 10), (2, 0, 10)]
    files = [one, one, [(1, 2, 11), (2, 0, 11)], one, [(1, 2, 11)], [(2, 1, 12)]]
    got, _ = progress(spark, tmp_path, files)
    assert got == [(1, 2, False), (1, 3, True), (2, 1, False), (2, 2, False)]
    # a restart brings every result of batch 1 once more, and the end of batch 2
    got, _ = progress(spark, tmp_path, [one, [(1, 2, 11)], [(2, 2, 12)], [(2, 2, 12)]])
    assert got == [(1, 2, False), (1, 3, True), (2, 1, False), (2, 2, False), (2, 3, True)]


def test_state_of_closed_batches_goes(spark, tmp_path):
    files = [[(1, k, 10) for k in range(3)], [(2, 0, 30)], [(2, 1, 31)], [(1, 0, 10), (1, 7, 10)], [(2, 2, 32)], [(3, 0, 90)], [(4, 0, 91)], [(3, 0, 90)]]
    got, state = progress(spark, tmp_path, files)
    assert [g for g in got if g[2]] == [(1, 3, True), (2, 3, True)]  # late repeats of batch 1 are dropped, and open nothing
    assert [g for g in got if g[0] == 1] == [(1, 3, True)]
    assert state[-1] <= 6  # what is left belongs to batches 3 and 4


def test_progress_of_large_batches(spark, results, tmp_path):
    rows = results[0].withColumn("batch_id", F.expr("result_id div 300"))
    rows = rows.withColumn("item", F.expr("result_id % 300"))
    path = str(tmp_path / "large")
    rows.repartitionByRange(3, "result_id").write.parquet(path)
    out = triage.stream_progress(stream(spark, rows, path), 300, "60 days")
    drain(out.writeStream.format("memory").queryName("st2_large"), tmp_path, "st2-large", "append")
    last = spark.table("st2_large").groupBy("batch_id").agg(F.max("done").alias("done"), F.max("closed").alias("closed"))
    want = rows.groupBy("batch_id").agg(F.countDistinct("item").alias("done")).select("batch_id", "done", (F.col("done") == 300).alias("closed"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert last.filter("closed").count() > 0


KEY = ["tenant", "degree", "case_no"]


def test_latest(spark, results, tmp_path):
    rows, path = results
    rows = rows.withColumns({"tenant": F.expr("result_id % 3"), "degree": F.lit(1)})
    path = str(tmp_path / "keyed")
    rows.repartitionByRange(9, "result_id").write.parquet(path)
    table = Manifest(spark, str(tmp_path / "latest"))
    drain(triage.stream_latest(stream(spark, rows, path), table.path, KEY), tmp_path, "st3", "update")
    cols = [*KEY, "result_id"]
    want = sorted(map(tuple, windows.latest(rows, KEY, "ts", "result_id").select(*cols).collect()))
    read = lambda: sorted(map(tuple, triage.read_latest(table, KEY).select(*cols).collect()))
    assert read() == want
    # nine micro-batches: two merges of four, and old parts are gone
    assert sorted(p["level"] for p in table.parts()) == [0, 1, 1]
    assert len([p for p in (tmp_path / "latest").iterdir() if p.name.startswith("part-")]) <= 5
    # a new checkpoint starts at its first epoch again: the table stays, and replays change nothing
    newer = rows.filter("case_no = 7").withColumn("result_id", F.col("result_id") + 10**6).withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS"))
    newer.write.parquet(str(tmp_path / "newer"))
    drain(triage.stream_latest(stream(spark, rows, str(tmp_path / "newer")), table.path, KEY), tmp_path, "st3-anew", "update")
    want = sorted(map(tuple, windows.latest(rows.unionByName(newer), KEY, "ts", "result_id").select(*cols).collect()))
    assert read() == want
    triage.merge_latest(rows, table, KEY, "ts", "result_id")
    assert read() == want


def test_the_cost_of_a_batch_is_its_own(spark, tmp_path):
    table = Manifest(spark, str(tmp_path / "latest"))
    rows = lambda a, n: spark.range(a, a + n).selectExpr("id % 7 AS tenant", "1 AS degree", "id AS case_no", "timestamp_seconds(id) AS ts", "id AS result_id")
    triage.merge_latest(rows(0, 20_000), table, KEY, "ts", "result_id")
    first = table.parts()[0]["folder"]
    for k in range(2):
        triage.merge_latest(rows(30_000 + k, 1), table, KEY, "ts", "result_id")
    assert first in {p["folder"] for p in table.parts()}  # the large part is not written again
    assert triage.read_latest(table, KEY).count() == 20_002


def test_auto_tag(spark, results, tmp_path):
    rows, path = results
    grants = rows.groupBy("batch_id").agg((F.min("ts") + F.expr("INTERVAL 2 HOURS")).alias("granted_ts"))
    grants.write.parquet(str(tmp_path / "grants"))
    source = spark.readStream.schema(grants.schema).parquet(str(tmp_path / "grants"))
    out = triage.stream_auto_tag(stream(spark, rows, path), source, "60 days", 6)
    drain(out.writeStream.format("memory").queryName("st4"), tmp_path, "st4", "append")
    twin = joins.auto_tag(rows, grants, 6)
    assert twin.count() > 0
    assert sorted(r[0] for r in spark.table("st4").select("result_id").collect()) == sorted(r[0] for r in twin.select("result_id").collect())


def test_a_micro_batch_touches_its_state_once():
    from docketry.streaming.triage import Progress

    calls = []

    class State(dict):
        def getValue(self, k): calls.append("get"); return self.get(k)  # noqa: E702
        def updateValue(self, k, v): calls.append("put"); self[k] = v  # noqa: E702

    class Told(list):
        def get(self): calls.append("get"); return self[-1] if self else None  # noqa: E702
        def exists(self): calls.append("exists"); return bool(self)  # noqa: E702
        def update(self, v): calls.append("put"); self.append(v)  # noqa: E702

    class Handle:
        def getMapState(self, *a): return State()  # noqa: E704
        def getValueState(self, *a): return Told()  # noqa: E704
        def registerTimer(self, at): calls.append("timer")  # noqa: E704
        def deleteTimer(self, at): calls.append("timer")  # noqa: E704
        def listTimers(self): calls.append("timer"); return []  # noqa: E702, E704

    p = Progress(20, 1000)
    p.init(Handle())
    told = [list(p.handleInputRows((1,), iter([{"ms": 5, "item": str(k % 10 + n)} for k in range(20)]), None)) for n in (0, 5, 10)]
    assert [(r.done, r.closed) for (r,) in told] == [(10, False), (15, False), (20, True)]
    assert len(calls) <= 16  # each result asked for itself before
