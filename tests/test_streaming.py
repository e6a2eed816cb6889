"""Streams equal their batch forms."""
import datetime as dt

from pyspark.sql import functions as F

from kreditflow.catalog import budget_events, queries
from kreditflow.operators import budget as B
from kreditflow.operators import clean as C
from kreditflow.session import scratch_path
from kreditflow.sources.decision_log import VersionedTable
from kreditflow.streaming import decisions as SD

SF = "/root/testdata/sf0.001"


def test_stream_budget_equals_batch_fold(spark):
    """With budgets reset so low that requests wait and sweeps approve them."""
    events = budget_events(spark, SF)
    low = events.select("pool_id").distinct().select(
        "pool_id", F.lit(-1).cast("long").alias("seq"), F.lit("1990-01-01").cast("timestamp_ntz").alias("ts"), F.lit("RESET").alias("event_type"),
        F.lit(None).cast("string").alias("applicant_id"), F.lit(900.0).alias("amount"))
    events = low.unionByName(events).select(*[F.col(f.name).cast(f.dataType) for f in B.EVENT_SCHEMA.fields]).checkpoint(eager=True)
    src, out = scratch_path(spark, "stream-events"), scratch_path(spark, "stream-fold")
    for (y,) in events.select(F.year("ts")).distinct().orderBy(F.year("ts")).collect():  # each call restarts the query from its checkpoint
        events.filter(F.year("ts") == y).write.mode("append").parquet(src)
        SD.run_budget_stream(spark, src, out, out + "-ckpt")
    cols = ["pool_id", "seq", "event_type", "applicant_id", "status", "remaining", "waitlist_size", "step"]
    stream = {tuple(r) for r in spark.read.schema(B.FOLD_SCHEMA).parquet(out).select(*cols).collect()}
    batch = {tuple(r) for r in B.fold_events(events).select(*cols).collect()}
    assert stream == batch
    assert sum(r[4] == "WAITLISTED" for r in batch) > 10 and any(r[2] == "WAITLIST_APPROVAL" for r in batch)


def test_stream_state_written_does_not_grow_with_the_waitlist(spark):
    """Batches that add few requests to waitlists of very different lengths change as much state."""
    import datetime as dt

    base = dt.datetime(2020, 1, 1)
    src, out = scratch_path(spark, "long-wait"), scratch_path(spark, "long-wait-fold")
    ckpt = out + "-ckpt"

    def batch(first, n, kind="REQUEST", amount=400.0):
        rows = [(1, i, base + dt.timedelta(minutes=i), kind, f"a{i}", amount) for i in range(first, first + n)]
        spark.createDataFrame(rows, B.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        with SD.state_store(spark):
            q = SD.stream_budget(spark.readStream.schema(B.EVENT_SCHEMA).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        changed.append(sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"]))
        seen.append(spark.read.schema(B.FOLD_SCHEMA).parquet(out).agg(F.max("waitlist_size")).first()[0])

    seen, changed = [], []
    batch(0, 40)
    batch(100, 3)
    batch(1000, 3000)
    batch(9000, 3)
    batch(9500, 2, "REPAYMENT", 400.0)
    assert seen == [15, 18, 3018, 3021, 3021]
    got = spark.read.schema(B.FOLD_SCHEMA).parquet(out).filter("event_type = 'WAITLIST_APPROVAL'").orderBy("seq").collect()
    assert [r.applicant_id for r in got] == ["a25", "a26"]
    assert changed[1] == changed[3] <= 8 < changed[2]  # three requests, whether 15 or 3,018 wait


def test_stream_decisions_equal_batch_log(spark):
    q = queries()
    cols = ["applicant_id", "decision", "tier", "commit_version"]
    s = {tuple(r) for r in q["str_01_stream_decisions"](spark, SF).select(*cols).collect()}
    b = {tuple(r) for r in q["src_08_log_scan"](spark, SF).select(*cols).collect()}
    assert s == b and len(s) > 0


def test_version_as_of_is_prefix(spark):
    q = queries()
    v3 = q["src_10_version_as_of"](spark, SF)
    assert v3.agg(F.max("commit_version")).first()[0] <= 3


def test_staging_a_year_reads_no_other(spark):
    rows = [(i, None if i % 7 == 0 else dt.datetime(1993 + i % 3, 5, 1 + i % 9)) for i in range(40)]
    apps = SD.applications_by_year(spark.createDataFrame(rows, "loan_id long, decided_at timestamp_ntz"))
    for year in (1993, 1994, 1995):
        one, path = SD.of_year(apps, year), scratch_path(spark, "one-year")
        assert "PartitionFilters: [isnotnull(_year" in one._jdf.queryExecution().executedPlan().toString()
        SD.stage_applications(apps, path, year)
        got = spark.read.parquet(path)
        assert got.columns == ["loan_id", "decided_at"]
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[1] and r[1].year == year)


def test_a_batch_runs_its_budget_once(spark, monkeypatch):
    """The state and the log read the stored outcome of the rounds."""
    apps, plans, append = C.applicants(spark, SF), {}, VersionedTable.append
    src, out, ckpt = (scratch_path(spark, f"once-{n}") for n in ("src", "log", "ckpt"))

    def seen(self, df, **k):
        plans[self.path.endswith("_budget_state")] = df._jdf.queryExecution().optimizedPlan().toString()
        return append(self, df, **k)

    monkeypatch.setattr(VersionedTable, "append", seen)
    SD.stage_applications(apps, src, 1995)
    log = SD.stream_decisions(spark, src, apps.schema, out, ckpt, budget=1200.0).read()
    assert {r.decision for r in log.filter("tier = 3").select("decision").distinct().collect()} == {"APPROVED", "WAITLISTED"}
    assert set(plans) == {True, False} and not any("Window" in p for p in plans.values())
