"""Faults that a reviewer found at larger sizes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regolith import catalog, catalog_records
from regolith.functions import identifiers, values
from regolith.operators import graph, linkage, readmodel, search, vectors, views
from regolith.sources.buckets import Store
from regolith.sources.registry import Registry

SF = "/root/testdata/sf0.001"

#: Two names with one pseudonym.
ALIKE = ("Customer#000005836", "Customer#000059498")


def test_names_of_one_pseudonym_are_restored_apart(spark):
    def restored(*keys):
        df = spark.createDataFrame(list(zip(keys, ALIKE)), "c_custkey long, c_name string")
        return dict(map(tuple, catalog_records.restored(Registry(spark, "", tables=lambda _: df)).collect()))

    covered = spark.createDataFrame([(n,) for n in ALIKE], "n string").select(identifiers.pseudonym_name(F.col("n"))).distinct().collect()
    assert len(covered) == 1
    assert restored(2, 4) == {2: ALIKE[0], 4: ALIKE[1]}
    assert restored(2, 3) == {2: ALIKE[0], 3: covered[0][0]}


def test_negative_zero_is_shown_as_zero(spark):
    df = spark.sql("SELECT * FROM VALUES (-0.0D), (0D), (-0.5D), (-1234D), (NULL) AS t(v)")
    assert [r[0] for r in df.select(values.display(F.col("v"), "double")).collect()] == ["0", "0", "-0.500", "-1,234", "N/A"]


def test_a_task_holds_no_more_for_more_pairs_of_blocks():
    rng = np.random.default_rng(0)
    q, b = rng.normal(size=(600, 8)), rng.normal(size=(1000, 8))
    pair = {"q_ids": list(range(600)), "q_rows": [list(x) for x in q], "ids": list(range(1000)), "rows": [list(x) for x in b]}
    sizes = [x.num_rows for x in vectors._block_top(10)(iter([pa.RecordBatch.from_pylist([pair] * 3)]))]
    assert sum(sizes) == 3 * 600 * 10 and max(sizes) <= vectors.TILE * 10


def test_ties_and_what_is_no_number(spark):
    rows = [(i, [1.0, float(i // 20)]) for i in range(60)] + [(60, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = [r["id"] for r in vectors.nearest(df.filter("id = 30"), df, 5).orderBy("rank").collect()]
    assert got == [20, 21, 22, 23, 24]


def test_views_are_made_one_by_one(spark):
    def stored(_):
        raise AssertionError("the model is not needed")

    r = Registry(spark, SF, stored=stored)
    assert views.published(r, ["activity_events"])["activity_events"].count() == r.table("events").count()


def test_a_model_that_is_thrown_away_has_sums_only(spark, tmp_path):
    r, store = Registry(spark, SF), Store(spark, f"file://{tmp_path}/model")
    readmodel.build(store, r, 4, follows=False)
    assert set(store.manifest()["tables"]) == {"partials", "days", "identities"}
    got, true = readmodel.registry(store, r.taxonomy(), views.REFERENCE_DATE), views.computed_registry(r)
    assert got.exceptAll(true).isEmpty() and true.exceptAll(got).isEmpty()
    with pytest.raises(ValueError):
        readmodel.refresh(store, readmodel.records(r).withColumn("version", F.lit(2).cast("long")))


def test_growing_tables_are_not_sent_through_the_driver(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    r = Registry(spark, SF)
    assert "Broadcast" not in plan(catalog_records.review_pairs(r))
    best = spark.range(50).selectExpr("id AS seq", "id", "(id + 1) % 50 AS best_id", "'auto_match' AS decision")
    assert "Broadcast" not in plan(graph.resolve(best, spark.createDataFrame([], "id long, entity string")))


def test_trigrams_of_all_records_take_a_few_bytes_a_block(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS raw_id", "concat('Customer ', id % 7) AS name")
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    store = Store(spark, f"file://{tmp_path}/s")
    search.index(store, rows.mapInArrow(counted, rows.schema), "raw_id", ("name",), buckets=4)
    assert seen.value == 20_000  # the records are computed once
    postings = store.read("postings").filter("bits is not null")
    assert postings.count() < 1000 and {r["n"] for r in store.read("grams").filter("gram = 'cus'").collect()} == {20_000}
    assert search.find(store, "tomer 3", ("name",)).count() == rows.filter("raw_id % 7 = 3").count()


def test_words_are_taken_from_records_and_not_from_pairs(spark):
    df = catalog.scores(Registry(spark, SF))
    last = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in last and last.count("sqrt") == 0
    rows = catalog.part_records(Registry(spark, SF)).limit(40)
    plain = rows.select(*[F.col(c).alias(f"{c}_a") for c in rows.columns]).crossJoin(rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns]))
    once = linkage.prepared(rows)
    ready = once.select(*[F.col(c).alias(f"{c}_a") for c in once.columns]).crossJoin(once.select(*[F.col(c).alias(f"{c}_b") for c in once.columns]))
    got, true = (linkage.score_pairs(x).select("id_a", "id_b", "score", "reason", "evidence") for x in (ready, plain))
    assert got.exceptAll(true).isEmpty() and true.exceptAll(got).isEmpty()
