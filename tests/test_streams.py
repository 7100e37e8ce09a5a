"""Streams with state by identity and with joined streams, against batch computations and in several orders."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from regolith.operators import activity
from regolith.streaming import late, statuses

TAX = [("inspection", 0.4, 30, True), ("renewal", 0.5, 60, True), ("reading", 0.1, 15, True), ("filing", 9.0, 45, False), ("closure", -0.9, 90, True), ("for_ever", 0.3, 0, True)]


def files(spark, root, frames, schema):
    """A folder that a stream reads file by file, in the order given."""
    import os
    import time

    for n, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        for f in os.listdir(root):
            if f.endswith(".parquet") and not f.startswith("n"):
                os.rename(f"{root}/{f}", f"{root}/n{n:03d}.parquet")
                os.utime(f"{root}/n{n:03d}.parquet", (time.time() - 1000 + n, time.time() - 1000 + n))
        for f in os.listdir(root):
            if f.startswith("."):
                os.remove(f"{root}/{f}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def test_sums_change_by_decay_alone():
    s = statuses.Sums(0, {30.0: 2.0})
    assert s.change("Active") == 13 and s.at(__import__("numpy").array([12, 13])).round(4).tolist() == [1.5157, 1.4811]
    # a short-lived gain over a long-lived loss: Dormant at first, Closed for good
    status, out = statuses.settle(statuses.Sums(-1, {}), "Dormant", {0: {15.0: 1.0, 90.0: -0.9}}, 400)
    assert status == "Closed" and [o[:2] for o in out] == [(3, "Closed")]
    # what does not decay stays
    assert statuses.settle(statuses.Sums(-1, {}), "Dormant", {5: {0.0: 1.5}}, 9999)[1] == [(5, "Active", 1.5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_statuses_are_the_batch_ones(spark, tmp_path, seed):
    rng = random.Random(seed)
    begin = dt.date(2024, 1, 1)
    events = [(rng.randrange(12), rng.choice(TAX)[0].upper(), begin + dt.timedelta(days=int(rng.random() ** 2 * 150))) for _ in range(500)]
    events += [(3, None, begin), (None, "renewal", begin), (4, "renewal", None), (4, "unheard of", begin)]
    schema = "ubid long, event_type string, event_date date"
    # up to ten days out of order, in files that each go on where the last one ended
    late_by = sorted(events, key=lambda e: (e[2] or begin) + dt.timedelta(days=rng.randrange(10)))
    parts = [late_by[i : i + 130] for i in range(0, len(late_by), 130)] + [[(99, "renewal", begin + dt.timedelta(days=400))]]
    stream = files(spark, str(tmp_path / "in"), parts, schema)
    tax = spark.createDataFrame(TAX, "event_type string, weight double, half_life int, is_active boolean")
    changes = late.collected(statuses.status_changes(stream, tax, "20 days"), "statuses")
    got = changes.collect()
    assert got and len({(r["ubid"], r["on_date"]) for r in got}) == len(got)
    batch = spark.createDataFrame(events, schema)
    ids = spark.range(12).withColumnRenamed("id", "ubid")
    for date in ("2024-01-20", "2024-03-10", "2024-12-01"):  # the last one lies months after the last event
        want = activity.classify(ids, batch.filter(F.col("event_date") <= F.lit(date).cast("date")), tax, date)
        assert {tuple(r) for r in statuses.on(changes, ids, date).collect()} == {(r["ubid"], r["status"]) for r in want.collect()}
    # only changes come out
    for u in range(12):
        own = [r["status"] for r in sorted((r for r in got if r["ubid"] == u), key=lambda r: r["on_date"])]
        assert all(a != b for a, b in zip(["Dormant", *own], own))
    assert any(r["on_date"] > max(e[2] for e in events if e[2]) for r in got)  # decay alone


def test_late_identities(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    events = [(i, i % 9 if i % 10 else None, at(i % 50, i % 24)) for i in range(300)]
    known = [(0, at(-3)), (1, at(0)), (2, at(10, 5)), (3, at(30)), (4, at(49)), (5, at(60)), (6, at(75)), (2, at(40))]  # 7 and 8 never come
    far = at(1000)
    e_schema, i_schema = "event_id long, ubid long, ts timestamp", "ubid long, arrived_at timestamp"
    first = {}
    for u, t in known:
        first[u] = min(t, first.get(u, t))
    want = set()
    for i, u, t in events:
        t_in = first.get(u)
        ok = t_in is not None and t_in <= t + dt.timedelta(days=20)
        wait = max(0.0, (t_in - t).total_seconds() / 86400) if ok else 20
        want.add((i, u, ok, -int(-wait // 5), None if ok else late.REASON))
    rng = random.Random(0)
    for n in range(2):
        a, b = list(events), list(known)
        if n:
            rng.shuffle(a)
            b.sort(key=lambda x: (x[0] != 2, x[1]), reverse=True)
            b.remove((2, at(40)))  # the first arrival comes first in either order
            b.append((2, at(40)))
        ev = files(spark, str(tmp_path / f"e{n}"), [a[:100], a[100:], [(-1, -1, far)], [(-2, -1, far)]], e_schema)
        ids = files(spark, str(tmp_path / f"i{n}"), [b[:3], b[3:], [(-1, far)], [(-2, far)]], i_schema)
        out = late.collected(late.bound(ev, ids, 20, 5, "200 days"), "late").filter("event_id >= 0")
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(events) and set(got) == want
    assert {w[2] for w in want} == {True, False} and {w[3] for w in want if w[2]} == {0, 1, 2, 3, 4}
