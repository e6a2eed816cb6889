"""Budget: the parallel prefix-sum rounds equal the sequential rule."""
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kreditflow.operators import budget as B


def sequential(rows, budget):
    out, spent = {}, {}
    for pool, ts, key, amt in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = spent.get(pool, 0.0)
        if budget - s >= amt:
            spent[pool] = s + amt
            out[key] = ("APPROVED", round(budget - s - amt, 2))
        else:
            out[key] = ("WAITLISTED", round(budget - s, 2))
    return out


def test_rounds_equal_sequential(spark):
    rnd = random.Random(7)
    base = dt.datetime(2020, 1, 1)
    rows = [(rnd.randrange(5), base + dt.timedelta(days=rnd.randrange(60)), i, rnd.choice([300.0, 350.0, 400.0, 500.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "pool_id int, decided_at timestamp_ntz, loan_id long, trial_amount double")
    got = {r.loan_id: (r.budget_status, r.budget_remaining) for r in B.approve_in_order(df, budget=20000.0).collect()}
    assert got == sequential(rows, 20000.0)


def test_fold_replay(spark):
    ts = dt.datetime(2020, 1, 1)
    ev = [
        (1, 1, ts, "REQUEST", "a", 500.0), (1, 2, ts, "REQUEST", "b", 400.0), (1, 3, ts, "REQUEST", "c", 300.0),
        (1, 4, ts + dt.timedelta(days=1), "REPAYMENT", "a", 500.0), (1, 5, ts + dt.timedelta(days=2), "DEFAULT", "b", 400.0),
        (1, 6, ts + dt.timedelta(days=3), "RESET", None, 1000.0), (1, 7, ts + dt.timedelta(days=4), "REQUEST", "d", 500.0),
    ]
    df = spark.createDataFrame(ev, B.EVENT_SCHEMA)
    # budget 10,000 by default: shrink with a RESET first
    df = df.unionByName(spark.createDataFrame([(1, 0, ts - dt.timedelta(days=1), "RESET", None, 700.0)], B.EVENT_SCHEMA))
    out = {(r.seq, r.event_type, r.applicant_id): r.status for r in B.fold_events(df).collect()}
    assert out[(1, "REQUEST", "a")] == "APPROVED"
    assert out[(2, "REQUEST", "b")] == "WAITLISTED"
    assert out[(3, "REQUEST", "c")] == "WAITLISTED"
    assert out[(4, "WAITLIST_APPROVAL", "b")] == "APPROVED"  # repayment refills 500: b (400) fits, c (300) no longer
    assert out[(7, "REQUEST", "d")] == "APPROVED"
    st = {r.pool_id: r for r in B.status_from_fold(B.fold_events(df)).collect()}[1]
    assert st.total_budget == 1000.0 and st.amount_deployed == 500.0


def plain(state, ev):
    """Who is approved by an event: the rule as it is told, over one list."""
    amount, done = ev["amount"], []
    if ev["event_type"] == "RESET":
        state[:] = [amount, []]
    elif ev["event_type"] == "REQUEST":
        if state[0] >= amount:
            state[0] -= amount
            done.append(ev["applicant_id"])
        else:
            state[1].append(ev)
    elif ev["event_type"] == "REPAYMENT":
        state[0] += amount
        for w in list(state[1]):
            if state[0] >= w["amount"]:
                state[0] -= w["amount"]
                done.append(w["applicant_id"])
                state[1].remove(w)
    return done


@pytest.mark.parametrize("range_events", [B.RANGE_EVENTS, 37])
def test_parallel_fold_equals_the_sequential_rule(spark, range_events):
    """Random events with resets and small budgets: every output row and state, in order, also handed on range by range."""
    rnd = random.Random(11)
    base = dt.datetime(2020, 1, 1)
    events = []
    for i in range(1500):
        kind = rnd.choices(["REQUEST", "REPAYMENT", "DEFAULT", "RESET"], [20, 4, 2, 0.1])[0]
        amount = rnd.choice([300.0, 350.0, 400.0, 500.0]) if kind != "RESET" else rnd.choice([900.0, 2000.0, 4000.0])
        events.append((rnd.choice([1, 1, 1, 2, 3]), i, base + dt.timedelta(days=rnd.randrange(200)), kind, f"a{i}", amount))
    events += [(p, -1, base - dt.timedelta(days=1), "RESET", None, 1500.0) for p in (1, 2)]
    want, states = [], {}
    simple = {}
    for pool, seq, ts, kind, who, amount in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        ev = dict(zip(B.EVENT_SCHEMA.fieldNames(), (pool, seq, ts, kind, who, amount)))
        rows = states.setdefault(pool, B.PoolState()).apply(ev)
        want += [tuple(r[f] for f in B.FOLD_SCHEMA.fieldNames()) for r in rows]
        assert [r["applicant_id"] for r in rows if r["status"] == "APPROVED"] == plain(simple.setdefault(pool, [10000.0, []]), ev)
    df = spark.createDataFrame(events, B.EVENT_SCHEMA).repartition(7)
    got = [tuple(r) for r in B.fold_events(df, range_events=range_events).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[3] == "WAITLIST_APPROVAL" for r in want) > 50
    last = {r.pool_id: r for r in B.status_from_fold(B.fold_events(df)).collect()}
    for pool, st in states.items():
        assert (last[pool].amount_deployed, last[pool].remaining, last[pool].waitlisted) == (st.deployed, st.remaining, st.size)


def test_more_amounts_than_eight(spark):
    rows = [(1, dt.datetime(2020, 1, 1), i, 100.0 + 7 * (i % 23)) for i in range(400)]
    df = spark.createDataFrame(rows, "pool_id int, decided_at timestamp_ntz, loan_id long, trial_amount double")
    got = {r.loan_id: (r.budget_status, r.budget_remaining) for r in B.approve_in_order(df, budget=9000.0).collect()}
    assert got == sequential(rows, 9000.0)


def test_fold_of_odd_events(spark):
    """No events, no amounts, a pool without a number, and only repayments."""
    ts = dt.datetime(2020, 1, 1)
    assert B.fold_events(spark.createDataFrame([], B.EVENT_SCHEMA)).collect() == []
    ev = [(1, 1, ts, "REPAYMENT", None, None), (1, 2, ts, "DEFAULT", "a", 70.0), (2, 3, ts, "REQUEST", "b", None), (3, 4, ts, "DEFAULT", "c", 5.0), (3, 5, ts, "REQUEST", "d", 20000.0)]
    got = {r.seq: r for r in B.fold_events(spark.createDataFrame(ev, B.EVENT_SCHEMA)).collect()}
    assert (got[1].status, got[1].total_budget, got[2].amount_defaulted, got[3].status) == ("RECORDED", 10000.0, 70.0, "APPROVED")
    assert (got[4].amount_defaulted, got[5].status, got[5].waitlist_size, got[5].remaining) == (5.0, "WAITLISTED", 1, 10000.0)


def test_hot_pool_is_folded_in_ranges(spark, monkeypatch):
    """A pool with most events: no task of a round gets more events than a range holds, and states go from round to round."""
    base = dt.datetime(2020, 1, 1)
    rnd = random.Random(3)
    ev = [(1 if i % 3 else 2 + i % 5, i, base + dt.timedelta(minutes=i), rnd.choice(["REQUEST", "REPAYMENT"]), f"a{i}", rnd.choice([300.0, 400.0, 500.0])) for i in range(2000)]
    df = spark.createDataFrame([(p, -1, base - dt.timedelta(days=1), "RESET", None, 1000.0) for p in range(1, 7)] + ev, B.EVENT_SCHEMA)
    sizes = []
    fold = B._fold_ranges

    def seen(kept, budget):
        sizes.extend(r["count"] for r in kept.groupBy("pool_id", "_period", "_range").count().collect())
        return fold(kept, budget)

    monkeypatch.setattr(B, "_fold_ranges", seen)
    got = Counter(map(tuple, B.fold_events(df, range_events=150).collect()))
    assert max(sizes) <= 150 and len(sizes) > 10
    states, want = {}, []
    for row in sorted(map(tuple, df.collect()), key=lambda e: (e[0], e[2], e[1])):
        want += [tuple(r[f] for f in B.FOLD_SCHEMA.fieldNames()) for r in states.setdefault(row[0], B.PoolState()).apply(dict(zip(B.EVENT_SCHEMA.fieldNames(), row)))]
    assert got == Counter(want)


def test_decisions_keep_rows_without_or_with_repeated_ids(spark):
    """Tier-3 rows with a null id, one id twice and equal rows: each is decided once and its money counted once."""
    from kreditflow.catalog import PD
    from kreditflow.operators import decide as D

    rows = PD.surrogate_decision_rows(spark, "/root/testdata/sf0.001").filter(F.col("tier") == 3).limit(6).withColumn("loan_id", F.lit(None).cast("long")).checkpoint()
    rows = rows.withColumns({"loan_id": F.when(F.col(D.ROW) % 2 == 0, 7).cast("long"), "pool_id": F.lit(1), "decided_at": F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz"), "trial_amount": F.lit(300.0)})
    twice = rows.union(rows.withColumn(D.ROW, F.col(D.ROW) + 1_000_000)).checkpoint()
    got = D.apply_budget(twice, budget=1000.0).collect()
    assert len(got) == twice.count() == 12
    assert Counter(r.decision for r in got) == {"APPROVED": 3, "WAITLISTED": 9}
    assert sorted(r.budget_remaining for r in got if r.decision == "APPROVED") == [100.0, 400.0, 700.0]


def test_ranges_follow_the_number_of_requests(spark, monkeypatch):
    """A small batch is one range and a large one as many as there are partitions; the outcome is the same."""
    rnd = random.Random(11)
    rows = [(rnd.randrange(3), dt.datetime(2020, 1, 1) + dt.timedelta(days=rnd.randrange(9)), i, rnd.choice([300.0, 400.0, 500.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "pool_id int, decided_at timestamp_ntz, loan_id long, trial_amount double")
    asked, plain = [], B.range_buckets
    monkeypatch.setattr(B, "range_buckets", lambda rows, group, order, n=None: asked.append(n) or plain(rows, group, order, n))
    for size in (B.ROWS_A_RANGE, 100, 1):
        monkeypatch.setattr(B, "ROWS_A_RANGE", size)
        got = {r.loan_id: (r.budget_status, r.budget_remaining) for r in B.approve_in_order(df, budget=9000.0).collect()}
        assert got == sequential(rows, 9000.0)
    assert B.approve_in_order(df.limit(0)).count() == 0
    assert asked == [1, 3, int(spark.conf.get("spark.sql.shuffle.partitions")), 1]
