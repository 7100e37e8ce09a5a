"""Links at any length of chain, neighbours by an index, and first rows of hot groups."""

import random

import pytest

from regolith.operators import graph


def acting(parents):
    out = {}
    children = {}
    for i, p in parents.items():
        children.setdefault(p, []).append(i)
    for root in [i for i, p in parents.items() if p not in parents]:
        stack = [(root, False)]
        while stack:
            i, ready = stack.pop()
            if ready:
                out[i] = not any(out[c] for c in children.get(i, []))
            else:
                stack += [(i, True), *((c, False) for c in children.get(i, []))]
    return out


@pytest.mark.parametrize("shape", ["random", "chains", "broom", "caterpillar"])
def test_forest(spark, shape):
    rng = random.Random(shape)
    n = 400
    if shape == "random":
        parents = {i: rng.randrange(i) if i and rng.random() < 0.97 else -1 for i in range(n)}
    elif shape == "chains":  # with branches that join far down
        parents = {i: (i - 1 if i % 57 else rng.randrange(max(i, 1)) if i else -1) for i in range(n)}
    elif shape == "broom":  # one candidate of most
        parents = {i: (i - 1 if i < 90 else 89) if i else None for i in range(n)}
    else:
        parents = {i: (i - 2 if i % 2 == 0 else i - 1) if i else -1 for i in range(n)}
    got = graph.unmatched(spark.createDataFrame(list(parents.items()), "id long, parent long"))
    assert sorted((r["id"], r["acts"]) for r in got.collect()) == sorted(acting(parents).items())


def test_forest_without_nodes(spark):
    assert graph.unmatched(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: cuts.append(1) or f(df))
    got = graph.unmatched(spark.range(n).selectExpr("id", "nullif(id - 1, -1) AS parent"))
    # the last node acts, the one before it does not, and so on
    assert got.filter(f"acts <> ((({n - 1} - id) % 2) = 0)").count() == 0 and got.count() == n
    assert (len(cuts) - 1) / 2 < 40


def test_index_finds_what_the_exact_search_finds(spark, monkeypatch):
    import numpy as np

    from regolith.operators import vector_index, vectors

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(scale=0.5, size=16)).tolist()) for i in range(1500)]
    rows += [(i, [1.0] * 16) for i in range(1500, 2200)]  # a third of all are the same
    rows += [(3000, [0.0] * 16), (3001, None), (3002, []), (None, [1.0] * 16)]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    asked = base.filter("id % 20 = 0")
    true = vectors.nearest(asked, base)
    monkeypatch.setattr(vector_index, "SAMPLE", 500)
    index = vector_index.build(base, block=100, sample=500)
    assert index.blocks.selectExpr("sum(size(ids))").first()[0] == 2201 and index.blocks.selectExpr("max(size(ids))").first()[0] < 200
    good = vector_index.measured(index, base, asked)
    assert 1 <= good.probes < len(index.centroids)
    r = vector_index.recall_of(vector_index.search(good, asked), true).first()
    assert r["recall"] >= 0.9 and r["neighbours"] == 10 * asked.count()
    # all lists read, it is the exact search
    every = vector_index.search(index, asked, probes=10**6, block=30)
    key = lambda df: sorted((x["query_id"], x["rank"], x["id"], round(x["similarity"], 9)) for x in df.collect())
    assert key(every) == key(true)
    assert vector_index.search(vector_index.build(base.limit(0)), asked).count() == 0


def test_first_of_hot_buckets(spark):
    from regolith.operators import linkage

    n = 3000
    df = spark.range(n).selectExpr("lpad(cast((id * 7919) % 3000 AS string), 6, '0') AS id", "if(id % 2 = 0, 'hot', concat('k', id % 300)) AS key").repartition(6)
    from pyspark.sql import functions as F

    keys = {"one": (F.col("key"), 8), "two": (F.substring("id", 6, 1), 3)}
    got = {(r["a"], r["b"], r["rank"]) for r in linkage.bucket_pairs(df, keys).collect()}
    rows = [(r["id"], r["key"]) for r in df.collect()]
    want = set()
    for rank, (pick, cap) in enumerate(((lambda r: r[1], 8), (lambda r: r[0][-1], 3))):
        buckets = {}
        for r in sorted(rows):
            buckets.setdefault(pick(r), []).append(r[0])
        want |= {(a, b, rank) for ids in buckets.values() for i, a in enumerate(ids[:cap]) for b in ids[:cap][i + 1 :]}
    assert got == want
    out = {r["strategy"]: (r["buckets"], r["records"]) for r in linkage.left_out(df, keys).collect()}
    assert out["one"] == (1 + sum(len([r for r in rows if r[1] == k]) > 8 for k in {r[1] for r in rows} - {"hot"}), sum(max(0, len([r for r in rows if r[1] == k]) - 8) for k in {r[1] for r in rows}))
    # before anything is shuffled, each part keeps its first ones only
    plan = linkage.bucket_pairs(df, keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_newest_events_of_a_hot_identity(spark):
    from regolith.operators import activity

    tax = spark.createDataFrame([("a", 1.0, 30, True)], "event_type string, weight double, half_life int, is_active boolean")
    ev = spark.range(200_000).selectExpr("if(id % 10 = 0, id % 50, 7) AS ubid", "id AS event_id", "if(id % 1000 = 1, 'b', 'A') AS event_type", "date_add(date'2024-01-01', cast(id % 365 AS int)) AS event_date")
    got = {r["ubid"]: r for r in activity.newest(ev, tax, "2024-12-31", 3).collect()}
    assert got[7]["n_total"] == 200_000 - 20_000 - 200 and [x["event_id"] for x in got[7]["timeline"]] == sorted((i for i in range(200_000) if i % 10 and i % 365 == 364 and i % 1000 != 1), reverse=True)[:3]
    assert sum(r["n_total"] for r in got.values()) == 200_000 - 200


def test_pages_by_key(spark):
    import itertools

    from regolith.operators import paging

    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.choice([None, 0.5, 0.7, 0.9]), rng.choice([None, "a", "b"])) for i in range(83)], "id long, score double, name string")
    for (falls, first), (falls2, first2), falls3 in itertools.product(itertools.product([True, False], repeat=2), [(True, False), (False, True)], [True, False]):
        keys = [("score", falls, first), ("name", falls2, first2), ("id", falls3, True)]
        want = [r["id"] for r in rows.orderBy(*[paging._order(k) for k in keys]).collect()]
        got, at = [], None
        while page := paging.page(rows, keys, at, 20).collect():
            got += [r["id"] for r in page]
            at = paging.cursor(page[-1], keys)
        assert got == want


def test_pages_skip_files(spark, tmp_path):
    from regolith.operators import paging

    at = str(tmp_path / "sorted")
    spark.range(1000).selectExpr("id", "id / 10 AS score").repartitionByRange(10, "id").write.parquet(at)
    got = paging.page(spark.read.parquet(at), [("score", False, True), ("id", False, True)], {"score": 95.0, "id": 950}, 5)
    assert [r["id"] for r in got.collect()] == [951, 952, 953, 954, 955]
    assert "GreaterThanOrEqual(score,95.0)" in got._jdf.queryExecution().executedPlan().toString()


def test_search_by_trigrams(spark, tmp_path):
    from regolith.operators import search
    from regolith.sources.buckets import Store

    names = ["Acme Traders", "acme", "ACM", "100% Café", None, "a_b%c", "Traders of Acme Street", "x", "ab", "TRADERS", "Mean crace", "back\\slash"]
    rows = spark.createDataFrame([(i, names[i % len(names)], f"Plot {i}, MG Road" if i % 3 else None) for i in range(300)], "raw_id long, name string, place string")
    store, columns = Store(spark, f"file://{tmp_path}/s"), ("name", "place")
    search.index(store, rows, "raw_id", columns, buckets=32)
    for like in ("acme", "ACME TRAD", "café", "ra%rs", "a_b", "10_%Caf", "MG Road", "Plot 17", "zzz", "no such thing", "", "x", "%%", "ac_e", "%traders"):
        want = sorted(r["raw_id"] for r in rows.filter(search.matches(columns, like)).collect())
        assert sorted(r["raw_id"] for r in search.find(store, like, columns).collect()) == want, like
    found = search.find(store, "Plot 17,", columns)
    assert len(found.inputFiles()) < len(store.read("records").inputFiles()) + len(store.read("postings").inputFiles())
    assert {f.split("/files/")[1].partition("-")[0] for f in found.inputFiles()} == {"records", "postings"} and sum("records" in f for f in found.inputFiles()) <= 2


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    from regolith.operators import sketches

    rows = spark.range(60_000).selectExpr("id % 2 AS g", "id % 20000 AS v", "id % 6 AS month", "id")
    parts = sketches.by_period(rows, ["g"], F.col("month"), "v")
    got = {r["g"]: r for r in sketches.merged(parts, ["g"]).collect()}
    assert parts.count() == 6 and all(abs(r["estimate"] / 10_000 - 1) < 0.03 and r["n"] == 30_000 for r in got.values())
