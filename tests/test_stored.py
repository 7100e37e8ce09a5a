"""Stored tables that follow changes: buckets, manifests, upserts and the read model."""

import pytest
from pyspark.sql import functions as F

from regolith.operators import readmodel, views
from regolith.sources.buckets import Conflict, Store, merge, merge_each
from regolith.sources.registry import Registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def folders(store, table):
    return store.manifest()["tables"][table]["folders"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_and_other_buckets(spark, store):
    old = spark.range(200).select("id", F.lit("old").alias("v"), F.lit(1).cast("long").alias("version"))
    assert merge(store, "t", old, "id", buckets=8) and store.versions() == [1]
    before, held = folders(store, "t"), store.read("t")
    assert merge(store, "t", spark.createDataFrame([(7, "new", 2), (900, "more", 2)], old.schema), "id")
    after = folders(store, "t")
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and store.versions() == [1, 2]
    assert store.read("t").count() == 201 and store.read("t").filter("v = 'new'").count() == 1
    # readers of the version before still have its files, until these are cleared away
    assert held.count() == 200
    assert store.vacuum(keep=1) == sum(before[b] != after[b] for b in before) and store.read("t").count() == 201 and store.versions() == [2]
    # reading some buckets reads their files only
    some = store.read("t", [3])
    assert {f.split("/store/")[1].rpartition("/")[0] for f in some.inputFiles()} == {after["3"]}


def test_two_writers(spark, store):
    t = spark.createDataFrame([(1, 1)], "id long, version long")
    merge(store, "t", t, "id")
    one, two = store.begin(), store.begin()
    for change in (one, two):
        change.replace("t", t, change.touched("t", t))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    with pytest.raises(ValueError):
        store.begin().replace("t", spark.createDataFrame([(i, 1) for i in range(50)], t.schema), [0])
    assert store.versions() == [1, 2] and rows(store.read("t")) == [(1, 1)]


def test_upserts_in_any_order(spark, tmp_path):
    import itertools

    schema = "id long, version long, v string, deleted boolean"
    batches = [[(1, 1, "a", False), (2, 1, "b", False)], [(1, 2, "c", False), (3, 2, "d", False)], [(2, 3, "b", True), (1, 0, "late", False), (None, 3, "n", False)]]
    want = [(1, 2, "c", False), (2, 3, "b", True), (3, 2, "d", False), (None, 3, "n", False)]
    for n, order in enumerate([*itertools.permutations(range(3)), (0, 1, 0, 2, 2, 1)]):
        s = Store(spark, f"file://{tmp_path}/{n}")
        done = [merge(s, "t", spark.createDataFrame(batches[i], schema), "id", token=("q", i), buckets=4) for i in order]
        assert rows(s.read("t")) == sorted(want, key=repr) and sum(done) == 3
        assert s.manifest()["done"] == {"q": {"upto": 2, "beyond": []}}
    # without tokens, versions alone make a batch that comes again harmless
    s = Store(spark, f"file://{tmp_path}/plain")
    for i in (2, 1, 0, 1):
        merge(s, "t", spark.createDataFrame(batches[i], schema), "id")
    assert rows(s.read("t")) == sorted(want, key=repr)


def test_streamed_upserts(spark, store, tmp_path):
    source = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(i, n, f"v{n}") for i in range(n, 6)], "id long, version long, v string").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second time there is nothing new
        stream = spark.readStream.schema("id long, version long, v string").option("maxFilesPerTrigger", 1).parquet(source)
        work = merge_each(store, "t", "id", "stream", buckets=4)
        stream.writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r["v"] for r in store.read("t").collect()}
    assert got == {0: "v0", 1: "v1", 2: "v2", 3: "v2", 4: "v2", 5: "v2"} and store.versions() == [1, 2, 3]
    work(spark.createDataFrame([(0, 9, "again")], "id long, version long, v string"), 1)  # a batch of a number that is done
    assert store.versions() == [1, 2, 3]


def test_one_record_touches_its_identities(spark, store):
    r = Registry(spark, SF)
    readmodel.build(store, r, buckets=16)
    assert rows(readmodel.registry(store, r.taxonomy(), views.REFERENCE_DATE)) == rows(views.computed_registry(r))
    before = {t: folders(store, t) for t in ("places", "facts", "partials", "days", "identities")}
    one = readmodel.records(r).orderBy("raw_id").limit(1)
    was = one.first()
    moved = one.withColumns({"ubid": F.col("ubid") + 1, "version": F.lit(2).cast("long")})
    wrote = readmodel.refresh(store, moved)
    assert len(wrote["places"]) == 1 and 1 <= len(wrote["facts"]) <= 2 and wrote["facts"] == wrote["partials"] and "days" not in wrote
    for t, old in before.items():
        assert {b for b in old if folders(store, t).get(b) != old[b]} <= set(map(str, wrote.get(t, [])))
    # the same as the views over tables in which the record is linked like that
    facts = store.read("facts")
    assert facts.filter(F.col("raw_id") == was["raw_id"]).first()["ubid"] == was["ubid"] + 1 and facts.count() == readmodel.records(r).count()
    whole = readmodel._summed(readmodel.records(r).withColumn("ubid", F.when(F.col("raw_id") == was["raw_id"], was["ubid"] + 1).otherwise(F.col("ubid"))))
    stored = store.read("partials")
    assert rows(stored.select(*whole.columns)) == rows(whole)
    # an older change, or the same again, is none
    assert readmodel.refresh(store, moved) == {} and readmodel.refresh(store, moved.withColumn("version", F.lit(1).cast("long"))) == {}


def test_least_values_after_losses(spark, store):
    schema = "raw_id long, version long, ubid long, source_system string, payload_name string, plain_name string, sector string, pin_code string, confidence double"
    go = lambda *x: readmodel.refresh(store, spark.createDataFrame(list(x), schema), buckets=4)
    per = lambda: {r["ubid"]: (r["payload_name"], r["confidence_score"], r["record_count"], r["source_count"]) for r in views.per_identity(store.read("partials")).collect()}
    go((1, 1, 10, "a", "Alpha", "alpha", "S", "1", 0.9), (2, 1, 10, "b", "Beta", "beta", "S", "2", 0.5), (3, 1, 10, "b", None, None, None, None, 0.7))
    assert per() == {10: ("Alpha", 0.9, 3, 2)}
    go((1, 2, 11, "a", "Alpha", "alpha", "S", "1", 0.9))
    assert per() == {10: ("Beta", 0.7, 2, 1), 11: ("Alpha", 0.9, 1, 1)}
    go((4, 2, 10, "c", "Aa", "aa", "S", "1", 0.1), (1, 3, None, "a", None, None, None, None, None))
    assert per() == {10: ("Aa", 0.7, 3, 2)}
    go((2, 4, 10, "b", "Zeta", "z", "S", "1", 0.2), (3, 1, 99, "x", "old", "old", "S", "1", 1.0))
    assert per() == {10: ("Aa", 0.7, 3, 2)} and store.read("places").count() == 4


def test_each_table_is_moved_once(spark, store, monkeypatch):
    """Random changes leave what plain counting leaves, and a write has one shuffle, after which its rows lie as they are written."""
    from collections import Counter
    from random import Random

    from regolith.sources.buckets import Change

    moved, replace = [], Change.replace

    def watched(self, table, rows, buckets):
        moved.append((table, rows._jdf.queryExecution().executedPlan().toString().count("Exchange") + ("bucket" not in rows.columns)))
        return replace(self, table, rows, buckets)

    monkeypatch.setattr(Change, "replace", watched)
    schema = "raw_id long, version long, ubid long, source_system string, payload_name string, plain_name string, sector string, pin_code string, confidence double"
    rng, newest, days = Random(5), {}, Counter()
    for n in range(4):
        batch = [(k, rng.randrange(1, 9), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["a", "b", None]), rng.choice(["N", "M", None]), "n", "S", "1", rng.random()) for k in rng.sample(range(40), 15)]
        for x in batch:
            if x[0] not in newest or x[1] > newest[x[0]][1]:
                newest[x[0]] = x
        seen = [(rng.randrange(4), "View", "2024-01-0%d" % rng.randrange(1, 4)) for _ in range(20)]
        days.update((u, e.lower(), d) for u, e, d in seen)
        readmodel.refresh(store, spark.createDataFrame(batch, schema), spark.createDataFrame(seen, "ubid long, event_type string, event_date string"), buckets=4)
        linked = [x for x in newest.values() if x[2] is not None]
        assert rows(store.read("places").select("raw_id", "version", "ubid")) == sorted(((x[0], x[1], x[2]) for x in newest.values()), key=repr)
        assert rows(store.read("facts").select("ubid", "raw_id", "source_system", "confidence")) == sorted(((x[2], x[0], x[3], x[8]) for x in linked), key=repr)
        whole = readmodel._summed(spark.createDataFrame(linked, schema))
        assert rows(store.read("partials").select(*whole.columns)) == rows(whole)
        assert {(r["ubid"], r["event_type"], str(r["event_date"])): r["n"] for r in store.read("days").collect()} == days
    assert {t for t, _ in moved} == {"places", "facts", "partials", "days"} and {n for _, n in moved} == {1}


def test_tables_of_a_database(spark):
    """Over JDBC, from the database that Spark brings along, in memory."""
    from regolith.operators import reports
    from regolith.sources import jdbc

    url = "jdbc:derby:memory:registry;create=true"
    plain = Registry(spark, SF)
    for name in ("customer", "orders", "events"):
        plain.table(name).coalesce(1).write.format("jdbc").options(url=url, dbtable=name).mode("overwrite").save()
    read = jdbc.tables(spark, url, {"customer": "c_custkey", "orders": "o_orderkey"}, part=100)
    r = Registry(spark, "", read)
    assert read("customer").rdd.getNumPartitions() > 1 and read("events").rdd.getNumPartitions() == 1
    assert rows(r.ubids()) == rows(plain.ubids())
    assert rows(reports.coverage(r)) == rows(reports.coverage(plain))
    plan = r.table("customer").filter("c_custkey = 7").select("c_name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "C_CUSTKEY" in plan.upper().split("PUSHEDFILTERS")[1]


def test_answers_hold_for_a_while(spark, tmp_path):
    from regolith.plans import cache

    now, built = [1000.0], []

    def build(status, limit=5):
        built.append((status, limit))
        return spark.range(limit).withColumn("status", F.lit(status)).withColumn("n", F.lit(len(built)))

    a = cache.Answers(spark, f"file://{tmp_path}/answers", 10, clock=lambda: now[0])
    assert a.get("list", build, "Active").count() == 5 and a.get("list", build, "Active").first()["n"] == 1
    assert a.get("list", build, "Active", limit=7).count() == 7 and a.get("list", build, "Closed").first()["n"] == 3
    # another session finds the answers
    b = cache.Answers(spark, f"file://{tmp_path}/answers", 10, clock=lambda: now[0])
    assert b.get("list", build, "Closed").first()["n"] == 3 and len(built) == 3
    now[0] += 11
    assert a.get("list", build, "Active").first()["n"] == 4
    assert a.invalidate("list") == 3 and a.invalidate("list") == 0
    assert a.get("list", build, "Active").first()["n"] == 5
    # the caller's key may leave arguments out
    c = cache.Answers(spark, f"file://{tmp_path}/own", 10, key=lambda name, *_, **__: name, clock=lambda: now[0])
    assert c.get("one", build, "x").first()["n"] == c.get("one", build, "y").first()["n"] == 6


def test_businesses_are_read_from_the_model(spark, tmp_path):
    import os
    import shutil

    for name in ("customer", "orders", "events"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    r = Registry(spark, f"file://{tmp_path}", stored=readmodel.stored)
    got = views.ubid_registry(r)
    assert rows(got) == rows(views.computed_registry(r)) and not any("orders" in f for f in got.inputFiles())
    before = readmodel.fingerprint(r)
    assert readmodel.fingerprint(r) == before
    # other files, another model
    half = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey % 2 = 0").toPandas()
    half.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    os.utime(tmp_path / "orders.parquet", (1, 1))
    spark.catalog.refreshByPath(f"file://{tmp_path}/orders.parquet")
    assert readmodel.fingerprint(r) != before and rows(views.ubid_registry(r)) == rows(views.computed_registry(r)) != rows(got)
