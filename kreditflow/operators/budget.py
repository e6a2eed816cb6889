"""Ring-fenced trial-loan budget per pool (DEC-05, DEC-06, DEC-07, DEC-13, AGG-30).

DEC-05, requests only.  Sequential rule per pool in arrival order: approve a
request when the remaining budget covers it, else waitlist it.  Remaining
budget only falls, so once an amount ``a`` fails every later request of at
least ``a`` fails too.  With the four ladder amounts this gives at most four
failure points, found by rounds of parallel prefix sums (one round for each
distinct amount at most):

  round: running sum of the still-open requests (bucketed, see ``ordered``);
         the first request whose running total passes the budget fails;
         earlier open requests are approved; later ones of at least the
         failing amount are waitlisted; the rest stay open with the failing
         amount as the new cap.

DEC-06/07/13 interleave repayments (which refill the budget and sweep the
waitlist), defaults and resets.  Between two resets the approvals of one amount
are its first requests: a waiting one does not fit, the budget only falls until
a repayment, and a sweep serves equal amounts in order of arrival, so a later
equal request never overtakes.  Each approval spends its amount, so at most
(start budget + all repayments) / amount requests of an amount can ever be
approved, which is a property of the data and not a cap.

So the fold is taken apart.  Defaults touch nothing but their own total, which
is a prefix sum.  Every (pool, period between resets) is a group of its own.  In
it, requests are ranked by bucketed prefix counts; only those within the bound
above are folded in order with the repayments.  A group is folded in ranges of
RANGE_EVENTS: a round folds one range of every group, each in a task, and hands
on the totals and, for each amount, how many of its requests are approved.  The
next round reads of the earlier requests only those that the money of its own
range can reach, by their rank.  All other requests are known to wait: their
rows take the fold's state as of their arrival, again by prefix operations.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround
from pyspark.sql import types as T

from kreditflow import constants as K
from kreditflow.operators.ordered import BUCKET, prefix_sum, range_buckets


#: Requests of a range of the rounds, at least; there are at most as many ranges as shuffle partitions.
ROWS_A_RANGE = 10_000


def approve_in_order(
    requests: DataFrame,
    budget: float = K.DEFAULT_POOL_BUDGET,
    pool_col: str = "pool_id",
    order_cols: tuple[str, ...] = ("decided_at", "loan_id"),
    amount_col: str = "trial_amount",
    initial_spent: DataFrame | None = None,
) -> DataFrame:
    """DEC-05: adds ``budget_status`` (APPROVED / WAITLISTED) and
    ``budget_remaining`` (after the request if approved, as found if not).

    ``order_cols`` must tell all rows of a pool apart."""
    order = list(order_cols)
    pos = F.struct(*[F.col(c) for c in order])
    most = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = range_buckets(requests, [pool_col], order, max(1, min(most, -(-requests.count() // ROWS_A_RANGE)))).withColumn("_pos", pos)
    spent = rows.sparkSession.createDataFrame([], f"{pool_col} {requests.schema[pool_col].dataType.simpleString()}, _spent double")
    if initial_spent is not None:  # carried over from earlier batches (streaming)
        spent = initial_spent.select(pool_col, F.col("_spent0").cast("double").alias("_spent"))

    open_rows = rows
    decided: list[DataFrame] = []
    keep = list(rows.columns)
    while True:  # every round settles one amount for good in each pool that fails
        o = open_rows.join(spent, pool_col, "left").withColumn("_spent", F.coalesce("_spent", F.lit(0.0)))
        o = prefix_sum(o, [pool_col], order, amount_col, "_ps")
        over = F.col("_spent") + F.col("_ps") > F.lit(budget)
        first_fail = (
            o.filter(over)
            .groupBy(pool_col)
            .agg(
                F.min("_pos").alias("_fpos"),
                F.min_by(F.col(amount_col), F.col("_pos")).alias("_famt"),
                F.min_by(F.col("_ps") - F.col(amount_col), F.col("_pos")).alias("_fbefore"),
            )
        )
        o = o.join(first_fail, pool_col, "left")
        status = (
            F.when(F.col("_fpos").isNull() | (F.col("_pos") < F.col("_fpos")), F.lit("APPROVED"))
            .when(F.col("_pos") == F.col("_fpos"), F.lit("WAITLISTED"))
            .when(F.col(amount_col) >= F.col("_famt"), F.lit("WAITLISTED"))
        )
        # one checkpoint per round: later rounds and the result read it
        # instead of re-running this round's joins and windows
        o = o.select(*keep, status.alias("budget_status"), (F.col("_spent") + F.col("_fbefore")).alias("_spent_next"), F.col("_fpos").isNotNull().alias("_failed")).checkpoint(eager=True)
        decided.append(o.filter(F.col("budget_status").isNotNull()).select(*keep, "budget_status"))
        open_rows = o.filter(F.col("budget_status").isNull()).select(*keep)
        spent = o.filter(F.col("_failed")).groupBy(pool_col).agg(F.first("_spent_next").alias("_spent"))
        if open_rows.isEmpty():
            break

    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.withColumn("_appr", F.when(F.col("budget_status") == "APPROVED", F.col(amount_col)).otherwise(F.lit(0.0)))
    out = prefix_sum(out, [pool_col], order, "_appr", "_deployed")
    if initial_spent is not None:
        out = out.join(initial_spent.select(pool_col, "_spent0"), pool_col, "left").withColumn(
            "_deployed", F.col("_deployed") + F.coalesce("_spent0", F.lit(0.0))
        ).drop("_spent0")
    return out.withColumn("budget_remaining", pround(F.lit(budget) - F.col("_deployed"), 2)).drop(
        "_appr", "_deployed", "_pos", BUCKET
    )


def budget_message(status, amount, remaining):
    """Texts shown with a tier-3 decision."""
    return F.when(
        status == "APPROVED",
        F.concat(
            F.lit("Approved as Tier 3 trial loan — $"),
            F.format_string("%.0f", pround(amount, 0)),
            F.lit(" at 9% APR over 6 months. Budget remaining: $"),
            F.format_number(pround(remaining, 2), 2),
        ),
    ).otherwise(
        F.concat(
            F.lit("Tier 3 budget currently exhausted ($"),
            F.format_string("%.2f", pround(remaining, 2)),
            F.lit(" remaining, need $"),
            F.format_string("%.0f", pround(amount, 0)),
            F.lit("). You have been added to the waitlist and will be reconsidered as repayments come in."),
        )
    )


# --------------------------------------------------------------------------- events fold

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("pool_id", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("applicant_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
    ]
)

FOLD_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields
    + [
        T.StructField("status", T.StringType()),
        T.StructField("total_budget", T.DoubleType()),
        T.StructField("amount_deployed", T.DoubleType()),
        T.StructField("amount_repaid", T.DoubleType()),
        T.StructField("amount_defaulted", T.DoubleType()),
        T.StructField("remaining", T.DoubleType()),
        T.StructField("waitlist_size", T.LongType()),
        T.StructField("step", T.IntegerType()),  # place among the rows of one event
    ]
)


class PoolState:
    """Budget state of one pool (the fold's accumulator), by the rule as it is told."""

    __slots__ = ("total", "deployed", "repaid", "defaulted", "waiting", "size", "arrivals", "approvals")

    def __init__(self, total: float = K.DEFAULT_POOL_BUDGET):
        self.reset(total)

    def reset(self, total: float) -> None:
        self.total, self.deployed, self.repaid, self.defaulted = float(total), 0.0, 0.0, 0.0
        self.waiting: dict[float, deque] = {}  # amount -> (arrival, event) in order
        self.approvals: dict[float, int] = {}  # amount -> how many
        self.size = self.arrivals = 0

    @property
    def remaining(self) -> float:
        return self.total - self.deployed

    def wait(self, ev: dict) -> None:
        self.waiting.setdefault(float(ev["amount"] or 0.0), deque()).append((self.arrivals, ev))
        self.arrivals += 1
        self.size += 1

    def heads(self) -> list[tuple[int, float]]:
        """(arrival, amount) of the first waiting request of each amount."""
        return [(q[0][0], a) for a, q in self.waiting.items() if q]

    def pop(self, amount: float) -> dict:
        """The first waiting request of an amount leaves the waitlist."""
        self.size -= 1
        return self.waiting[amount].popleft()[1]

    def approve(self, amount: float) -> None:
        self.deployed += amount
        self.approvals[amount] = self.approvals.get(amount, 0) + 1

    def apply(self, ev: dict) -> list[dict]:
        """Apply one event; returns output rows (the event, plus any waitlist
        approvals it triggers)."""
        kind, amt = ev["event_type"], float(ev["amount"] or 0.0)
        out = []
        if kind == "REQUEST":
            if self.remaining >= amt:
                self.approve(amt)
                out.append(self._row(ev, "APPROVED"))
            else:
                self.wait(ev)
                out.append(self._row(ev, "WAITLISTED"))
        elif kind == "REPAYMENT":
            self.repaid += amt
            self.total += amt
            out.append(self._row(ev, "RECORDED"))
            # what doesn't fit now can't fit later in the sweep: the earliest of the first of each amount that fits is next
            while fits := [h for h in self.heads() if h[1] <= self.remaining]:
                first = min(fits)[1]
                w = self.pop(first)
                self.approve(first)
                out.append(self._row({**w, "seq": ev["seq"], "ts": ev["ts"], "event_type": "WAITLIST_APPROVAL"}, "APPROVED"))
        elif kind == "DEFAULT":
            self.defaulted += amt
            out.append(self._row(ev, "RECORDED"))
        elif kind == "RESET":
            self.reset(amt)
            out.append(self._row(ev, "RESET"))
        for step, row in enumerate(out):
            row["step"] = step
        return out

    def _row(self, ev: dict, status: str) -> dict:
        return {
            "pool_id": ev["pool_id"], "seq": ev["seq"], "ts": ev["ts"], "event_type": ev["event_type"],
            "applicant_id": ev["applicant_id"], "amount": ev["amount"], "status": status,
            "total_budget": self.total, "amount_deployed": self.deployed, "amount_repaid": self.repaid,
            "amount_defaulted": self.defaulted, "remaining": self.remaining, "waitlist_size": self.size,
        }


#: Events of one group that a task folds before the state is handed on.
RANGE_EVENTS = 100_000
#: Rows of a group on the way into a round: its state, earlier requests that may be served, its events.
STATE, WAITING, EVENT = 0, 1, 2
HANDED = "_bucket int, _period long, _rank long, _kind int, _amounts array<double>, _approvals array<long>"


def _fold_groups(budget: float):
    """Rows arrive sorted by (pool_id, _period, _kind, ts, seq); the state of one group is held at a time and written at its end."""
    fields = [f.name for f in FOLD_SCHEMA.fields]
    names = [*fields, *(c.split()[0] for c in HANDED.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, st, out = None, PoolState(budget), []

        def handed() -> dict:
            end = {**st._row(dict.fromkeys(fields), "STATE"), "pool_id": group[0], "step": 0}
            return {**end, "_period": group[1], "_kind": STATE, "_amounts": list(st.approvals), "_approvals": list(st.approvals.values())}

        for pdf in batches:
            for ev in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if (ev["pool_id"], ev["_period"]) != group:
                    if group is not None:
                        out.append(handed())
                    group, st = (ev["pool_id"], ev["_period"]), PoolState(budget)
                if ev["_kind"] == STATE:
                    st.total, st.deployed, st.repaid, st.size = ev["total_budget"], ev["amount_deployed"], ev["amount_repaid"], ev["waitlist_size"]
                    st.approvals = dict(zip(ev["_amounts"], ev["_approvals"], strict=True))
                elif ev["_kind"] == WAITING:
                    st.wait(ev)
                    st.size -= 1  # the state has counted it
                else:
                    out.extend({**row, "_bucket": ev["_bucket"], "_period": ev["_period"], "_kind": EVENT, "_amounts": None, "_approvals": None} for row in st.apply(ev))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if group is not None:
            yield pd.DataFrame([handed()], columns=names)

    return run


def _fold_ranges(kept: DataFrame, budget: float) -> DataFrame:
    """Folded rows of the events ``kept`` (with _rank and _range in their group), a range of every group in each round."""
    group, order = ["pool_id", "_period"], ["ts", "seq"]
    last = kept.agg(F.max("_range")).first()[0]  # one number
    kind = T.StructType([*FOLD_SCHEMA.fields, *T.StructType.fromDDL(HANDED).fields])
    empty = {f.name: F.lit(None).cast(f.dataType) for f in kind.fields}
    shaped = lambda df, k: df.select(*[F.lit(k).alias(n) if n == "_kind" else F.col(n) if n in df.columns else c.alias(n) for n, c in empty.items()])
    done, state = [], None
    for at in range((last or 0) + 1):
        now = kept.filter(F.col("_range") == at)
        rows = shaped(now, EVENT)
        if state is not None:
            money = now.groupBy(*group).agg(F.sum(F.when(F.col("event_type") == "REPAYMENT", F.coalesce("amount", F.lit(0.0))).otherwise(0.0)).alias("_money"))
            state = state.join(money, group)
            reach = state.select(*group, (F.col("remaining") + F.col("_money")).alias("_reach"), "_amounts", "_approvals")
            early = kept.filter((F.col("_range") < at) & (F.col("event_type") == "REQUEST")).join(reach, group)
            # requests of the amount that are approved so far come first
            served = F.coalesce(F.get("_approvals", (F.array_position("_amounts", F.col("_value")) - 1).cast("int")), F.lit(0))
            early = early.filter((F.col("_rank") > served) & ((F.col("_rank") - served) * F.col("_value") <= F.col("_reach")))
            rows = rows.unionByName(shaped(state, STATE)).unionByName(shaped(early.drop("_amounts", "_approvals"), WAITING))
        folded = rows.repartition(*group).sortWithinPartitions(*group, "_kind", *order).mapInPandas(_fold_groups(budget), kind).checkpoint(eager=True)
        done.append(folded.filter(F.col("_kind") == EVENT))
        state = folded.filter(F.col("_kind") == STATE)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fold_events(events: DataFrame, budget: float = K.DEFAULT_POOL_BUDGET, range_events: int = RANGE_EVENTS) -> DataFrame:
    """DEC-06 / DEC-07 / DEC-13: REQUEST, REPAYMENT, DEFAULT and RESET events in order per pool."""
    order, state = ["ts", "seq"], ["total_budget", "amount_deployed", "amount_repaid", "remaining", "waitlist_size"]
    group, value = ["pool_id", "_period"], F.coalesce("amount", F.lit(0.0))
    ev = events.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA.fields])
    rows = range_buckets(ev, ["pool_id"], order)
    is_kind = lambda k: (F.col("event_type") == k).cast("long")
    rows = prefix_sum(rows.withColumn("_reset", is_kind("RESET")), ["pool_id"], order, "_reset", "_period").drop("_reset").withColumn("_value", value)
    # what each period can spend: its start and all repayments
    start = F.when(F.col("_period") == 0, F.lit(budget)).otherwise(F.max(F.when(F.col("event_type") == "RESET", F.col("_value"))))
    pots = rows.groupBy(*group).agg((start + F.sum(F.when(F.col("event_type") == "REPAYMENT", F.col("_value")).otherwise(0.0))).alias("_pot"))
    asked = rows.filter(F.col("event_type") == "REQUEST").withColumn("_one", F.lit(1))
    asked = prefix_sum(asked, [*group, "_value"], order, "_one", "_rank").join(pots, group)
    asked = asked.withColumn("_may", F.col("_rank") * F.col("_value") <= F.col("_pot")).select(*rows.columns, "_rank", "_may").checkpoint(eager=True)

    moving = rows.filter(F.col("event_type").isin("REPAYMENT", "RESET")).withColumn("_rank", F.lit(None).cast("long"))
    kept = asked.filter("_may").drop("_may").unionByName(moving).withColumn("_one", F.lit(1))
    kept = prefix_sum(kept, group, order, "_one", "_n").withColumn("_range", F.floor((F.col("_n") - 1) / range_events).cast("int"))
    kept = kept.select(*[f.name for f in EVENT_SCHEMA.fields], BUCKET, "_period", "_value", "_rank", "_range").checkpoint(eager=True)
    fields = [f.name for f in FOLD_SCHEMA.fields]
    folded = _fold_ranges(kept, budget).select(*fields, BUCKET, "_period")

    # rows outside the fold
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in FOLD_SCHEMA.fields if f.name in [*state, "amount_defaulted"]]
    outside = lambda df, status: df.select(*[f.name for f in EVENT_SCHEMA.fields], BUCKET, "_period", F.lit(status).alias("status"), *empty, F.lit(0).alias("step"))
    every = folded.unionByName(outside(asked.filter(~F.col("_may")), "WAITLISTED")).unionByName(outside(rows.filter(F.col("event_type") == "DEFAULT"), "RECORDED"))
    waits = F.col("total_budget").isNull() & (F.col("event_type") == "REQUEST")
    every = every.withColumns({"_late": waits.cast("long"), "_lost": F.when(F.col("event_type") == "DEFAULT", value).otherwise(0.0)}).checkpoint(eager=True)

    # the state as of each of them: the last one in its bucket, or of an earlier bucket
    place = [*order, "step"]
    known = F.when(F.col("total_budget").isNotNull(), F.struct(*state))
    ends = every.filter(F.col("total_budget").isNotNull()).groupBy("pool_id", BUCKET).agg(F.max_by(F.struct(*state), F.struct(*place)).alias("_end"))
    every = every.join(_carried(ends, every), ["pool_id", BUCKET], "left")
    here = Window.partitionBy("pool_id", BUCKET).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_state", F.coalesce(F.last(known, ignorenulls=True).over(here), F.col("_before")))
    # requests that wait outside the fold count in the waitlist, and defaults add up, until the next reset
    every = prefix_sum(every, group, place, "_late", "_extra")
    every = prefix_sum(every, group, place, "_lost", "_defaulted")
    fresh = {"total_budget": F.lit(budget), "remaining": F.lit(budget)}
    out = {c: F.coalesce(F.col("_state").getField(c), fresh.get(c, F.lit(0.0))) for c in state}
    out["amount_defaulted"] = F.col("_defaulted").cast("double")
    out["waitlist_size"] = (F.coalesce(F.col("_state.waitlist_size"), F.lit(0)) + F.col("_extra")).cast("long")
    return every.withColumns(out).select(*fields)


def _carried(ends: DataFrame, every: DataFrame) -> DataFrame:
    """(pool_id, bucket, _before): the last state of a pool in earlier buckets; a row per pool and bucket."""
    all_buckets = every.select("pool_id", BUCKET).distinct().join(ends, ["pool_id", BUCKET], "left")
    w = Window.partitionBy("pool_id").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return all_buckets.select("pool_id", BUCKET, F.last("_end", ignorenulls=True).over(w).alias("_before"))


def status_from_requests(decided: DataFrame, budget: float = K.DEFAULT_POOL_BUDGET, pool_col: str = "pool_id") -> DataFrame:
    """AGG-30 over DEC-05 output: per pool totals, remaining and counts."""
    approved = F.col("budget_status") == "APPROVED"
    return decided.groupBy(pool_col).agg(
        F.lit(budget).alias("total_budget"),
        pround(F.sum(F.when(approved, F.col("trial_amount")).otherwise(0.0)), 2).alias("amount_deployed"),
        pround(F.lit(budget) - F.sum(F.when(approved, F.col("trial_amount")).otherwise(0.0)), 2).alias("remaining"),
        F.count_if(approved).alias("approved"),
        F.count_if(~approved).alias("waitlisted"),
    )


def status_from_fold(folded: DataFrame) -> DataFrame:
    """AGG-30 over the fold: last state per pool plus counts and repay rate."""
    last = F.max_by(
        F.struct("total_budget", "amount_deployed", "amount_repaid", "amount_defaulted", "remaining", "waitlist_size"),
        F.struct("ts", "seq", "step"),
    )
    s = folded.groupBy("pool_id").agg(last.alias("s"), F.count_if(F.col("status") == "APPROVED").alias("approved"))
    resolved = F.col("s.amount_repaid") + F.col("s.amount_defaulted")
    return s.select(
        "pool_id", "s.total_budget", "s.amount_deployed", "s.remaining", "s.amount_repaid", "s.amount_defaulted",
        F.when(resolved > 0, pround(F.col("s.amount_repaid") / resolved, 4)).alias("repay_rate"),
        "approved", F.col("s.waitlist_size").alias("waitlisted"),
    )
