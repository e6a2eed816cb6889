"""Structured Streaming forms of the decision jobs (STR-01..03).

STR-01  applications arrive as files; each micro-batch is decided and
        committed to the versioned log as version = batch id.  The commit is
        idempotent (dynamic partition overwrite of that version; a batch whose
        commit row exists is skipped), so a restarted query after executor or
        driver loss does not duplicate decisions.  The pool budget carries
        across batches through a small per-pool state table, committed first.
STR-02  the budget fold as a stateful operator per pool
        (``transformWithStateInPandas``) whose waitlist lies in the state store,
        entry by entry; events ordered by (ts, seq) in a batch.
STR-03  approval rate per sliding 7-day window with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kreditflow import constants as K
from kreditflow.functions.numeric import pround
from kreditflow.operators import budget as B
from kreditflow.operators import clean as C
from kreditflow.operators import decide as D
from kreditflow.sources.decision_log import VersionedTable

# --------------------------------------------------------------------- STR-01


#: Year of the decision, by which the applications are stored before they are staged.
YEAR = "_year"


def applications_by_year(apps: DataFrame) -> DataFrame:
    """The applications stored once, with their year, so that staging one reads no other."""
    return D.store(apps.withColumn(YEAR, F.year("decided_at")), "stream_apps", by=YEAR)


def of_year(apps: DataFrame, year: int) -> DataFrame:
    """One year's applications, by the stored year where there is one."""
    return apps.filter((F.col(YEAR) if YEAR in apps.columns else F.year("decided_at")) == year).drop(YEAR)


def stage_applications(apps: DataFrame, path: str, year: int) -> None:
    """Write one year's applications, over as many files as there are, for the stream to find."""
    of_year(apps, year).write.mode("append").parquet(path)


def _decide_batch(batch: DataFrame, batch_id: int, log: VersionedTable, state: VersionedTable, budget: float) -> None:
    if log.has(batch_id):  # replay of a committed batch
        return
    rows = D.decide_rows(
        batch.withColumn("repay_prob", C.surrogate_prob()), "repay_prob", C.surrogate_attributions(), F.lit(C.surrogate_base_logit()), F.lit("surrogate-linear-1"),
    )
    pending = F.col("decision") == "PENDING"
    # what the batches before this one have spent: the newest earlier version holds every pool
    spent = None
    newest = state.latest_version(batch_id - 1)
    if newest is not None:
        spent = state.read(newest).filter(F.col("commit_version") == newest).select("pool_id", F.col("spent").alias("_spent0"))
    t3 = rows.filter(pending)
    res = B.approve_in_order(t3.select("pool_id", *D.ARRIVAL, "trial_amount"), budget=budget, order_cols=D.ARRIVAL, initial_spent=spent)
    res = D.store(res.select("pool_id", *D.ARRIVAL, "budget_status", "budget_remaining"), "batch_budget")  # for the state and for the log
    last = res.groupBy("pool_id").agg(F.max_by(F.lit(budget) - F.col("budget_remaining"), F.struct(*D.ARRIVAL)).alias("spent"))
    if spent is not None:
        carried = spent.join(last.select("pool_id"), "pool_id", "left_anti").select("pool_id", F.col("_spent0").alias("spent"))
        last = last.unionByName(carried)
    # state first: a crash between the two commits replays the batch, which then finds the spending of the
    # batches before it again and writes the same decisions
    state.append(last, operation="STREAMING UPDATE", version=batch_id)
    t3 = t3.join(res.select(D.ROW, "budget_status", "budget_remaining"), D.ROW).withColumn("decision", F.col("budget_status")).drop("budget_status")
    dec = rows.filter(~pending).withColumn("budget_remaining", F.lit(None).cast("double")).unionByName(t3)
    log.append(D.decision_record(dec, extra=["pool_id"]), operation="STREAMING UPDATE", version=batch_id)


STATE_FIELDS = T.StructType([T.StructField("pool_id", T.IntegerType()), T.StructField("spent", T.DoubleType())])


def stream_decisions(spark: SparkSession, source: str, schema: T.StructType, log_path: str, checkpoint: str, budget: float = K.DEFAULT_POOL_BUDGET) -> VersionedTable:
    """STR-01: decide what has arrived since the last call, as one micro-batch, and commit it."""
    log = VersionedTable(spark, log_path)
    state = VersionedTable(spark, log_path.rstrip("/") + "_budget_state", STATE_FIELDS)
    q = (
        spark.readStream.schema(schema).parquet(source)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, bid: _decide_batch(df, bid, log, state, budget))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return log


# --------------------------------------------------------------------- STR-02


class StoredState(B.PoolState):
    """A pool's state whose waitlist lies in the state store: a batch reads and writes only the requests that it serves or adds."""

    __slots__ = ("queues", "stored", "ends", "first")

    def __init__(self, queues, stored):
        self.queues, self.stored = queues, stored
        self.ends: dict[float, list[int]] = {}  # amount -> [first waiting place, next place]
        self.first: dict[float, int] = {}  # amount -> arrival of its first waiting request
        super().__init__()

    def reset(self, total: float) -> None:
        super().reset(total)
        for amount, (head, tail) in self.ends.items():
            for place in range(head, tail):
                self.stored.removeKey((amount, place))
            self.queues.removeKey((amount,))
        self.ends.clear()
        self.first.clear()

    def load(self) -> None:
        for (amount,), (head, tail) in self.queues.iterator():
            self.ends[amount] = [head, tail]
            if head < tail:
                self.first[amount] = self.stored.getValue((amount, head))[0]

    def wait(self, ev: dict) -> None:
        amount = float(ev["amount"] or 0.0)
        ends = self.ends.setdefault(amount, [0, 0])
        self.stored.updateValue((amount, ends[1]), (self.arrivals, ev["applicant_id"], ev["amount"]))
        if ends[0] == ends[1]:
            self.first[amount] = self.arrivals
        ends[1] += 1
        self.arrivals += 1
        self.size += 1

    def heads(self) -> list[tuple[int, float]]:
        return [(arrival, amount) for amount, arrival in self.first.items()]

    def pop(self, amount: float) -> dict:
        ends = self.ends[amount]
        _, applicant, asked = self.stored.getValue((amount, ends[0]))
        self.stored.removeKey((amount, ends[0]))
        ends[0] += 1
        self.first.pop(amount)
        if ends[0] < ends[1]:
            self.first[amount] = self.stored.getValue((amount, ends[0]))[0]
        self.size -= 1
        return {"pool_id": self.pool, "applicant_id": applicant, "amount": asked}

    def save(self) -> None:
        for amount, ends in self.ends.items():
            self.queues.updateValue((amount,), tuple(ends))

    pool = None


class BudgetProcessor(StatefulProcessor):
    """The fold of one pool: a value state for its totals, a map of waiting requests by (amount, place), a map of each amount's ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "total double, deployed double, repaid double, defaulted double, size long, arrivals long")
        self.queues = handle.getMapState("queues", "amount double", "head long, tail long")
        self.waiting = handle.getMapState("waiting", "amount double, place long", "arrival long, applicant_id string, amount double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pool = type("Pool", (StoredState,), {"pool": key[0]})
        st = pool(self.queues, self.waiting)
        if self.totals.exists():
            st.load()
            st.total, st.deployed, st.repaid, st.defaulted, st.size, st.arrivals = self.totals.get()
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = [row for ev in batch.astype(object).where(batch.notna(), None).to_dict("records") for row in st.apply(ev)]
        st.save()
        self.totals.update((st.total, st.deployed, st.repaid, st.defaulted, st.size, st.arrivals))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in B.FOLD_SCHEMA.fields])

    def close(self) -> None:
        pass


def stream_budget(events: DataFrame) -> DataFrame:
    """STR-02: the budget fold of every pool as a stateful operator over a stream of events.

    The rows of one pool in a micro-batch are folded in (ts, seq) order; a batch holds what its trigger admits, and
    batches must come in order of time.  The state of a batch is what it changes, however long the waitlist is.
    Needs the RocksDB state store (``state_store``)."""
    return events.groupBy("pool_id").transformWithStateInPandas(BudgetProcessor(), B.FOLD_SCHEMA, "Append", "None")


@contextmanager
def state_store(spark: SparkSession):
    """The state store that the fold needs, while its query is started; the caller's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_budget_stream(spark: SparkSession, source: str, out: str, checkpoint: str) -> DataFrame:
    """Fold what has arrived under ``source`` since the last call; all rows written so far."""
    stream = spark.readStream.schema(B.EVENT_SCHEMA).parquet(source)
    with state_store(spark):
        q = (stream_budget(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(B.FOLD_SCHEMA).parquet(out)


# --------------------------------------------------------------------- STR-03


def windowed_approval(decisions: DataFrame, watermark: str = "1 day", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """STR-03: approval rate per sliding window; works on a stream (with the
    watermark dropping late rows) and on a batch frame alike."""
    ts = F.col("decided_at").cast("timestamp").alias("ts") if dict(decisions.dtypes).get("decided_at") != "string" else F.try_to_timestamp("decided_at").cast("timestamp").alias("ts")
    d = decisions.select(ts, (F.col("decision") == "APPROVED").cast("int").alias("ok"))
    if decisions.isStreaming:
        d = d.withWatermark("ts", watermark)
    g = d.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("approved"))
    return g.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "approved",
        pround(F.col("approved") / F.col("n"), 6).alias("approval_rate"),
    )
