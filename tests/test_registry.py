"""Registered queries against an independent SQL engine, and functions against cases worked by hand."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regolith import catalog
from regolith.functions import identifiers, similarity, text
from regolith.operators import activity, linkage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    show = lambda v: "NULL" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "out"), [("M/s Acme Traders Pvt. Ltd.", "acme"), ("The Peenya Works", "peenya"), ("Shri Rama & Co", "rama"), ("x and co", "x and"), ("...", None), ("", None), (None, None), ("Msomething", "omething")])
def test_names(spark, raw, out):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(text.normalize_name(F.col("n"))).first()[0] == out


def test_addresses(spark):
    df = spark.createDataFrame([("12, Brigade Road,  560001",)], "a string")
    assert df.select(text.normalize_address(F.col("a"))).first()[0] == "12 brigade rd 560001"
    assert df.select(text.pincode(F.col("a"))).first()[0] == "560001"


@pytest.mark.parametrize(("word", "code"), [("ashcraft", "A226"), ("sachs", "S220"), ("robert", "R163"), ("a", "A000"), ("4x", "X000"), ("42", None)])
def test_soundex(spark, word, code):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(text.soundex_word(F.col("w"))).first()[0] == code


def test_identifiers(spark):
    df = spark.createDataFrame([("abcpk 0042 f",), ("ABCDK0042F",), ("ABC",), (None,)], "p string")
    assert [r[0] for r in df.select(identifiers.pan_ok(F.col("p"))).collect()] == [True, False, False, False]
    # the published example of a valid number, and the same with another check character
    df = spark.createDataFrame([("27AAPFU0939F1ZV",), ("27AAPFU0939F1ZW",), ("47AAPFU0939F1ZV",)], "g string")
    assert [r[0] for r in df.select(identifiers.gstin_ok(F.col("g"))).collect()] == [True, False, False]
    df = spark.createDataFrame([(4821,)], "n int")
    assert df.select(identifiers.ubid_code(F.col("n"), 2025)).first()[0] == "UBID-KA-29-2025-004821-3"


def test_similarity(spark):
    df = spark.createDataFrame([("a b c", "b c d", [1.0, 0.0], [0.0, 2.0], [], "x")], "a string, b string, u array<double>, v array<double>, e array<double>, p string")
    s = similarity
    a, b = s.tokens(F.col("a")), s.tokens(F.col("b"))
    got = df.select(s.jaccard(a, b), s.dice(a, b), s.cosine(F.col("u"), F.col("v")), s.cosine(F.col("u"), F.col("e")), s.cosine(F.col("v"), F.col("v"))).first()
    assert [round(x, 4) for x in got] == [0.5, 0.6667, 0.0, 0.0, 1.0]


def test_blocking_invariants(spark):
    data = [(f"r{i:03d}", f"acme {'abc'[i % 3]}", "SX:A250", "560001", None, None, False, False) for i in range(40)]
    df = spark.createDataFrame(data, "id string, name string, phonetic string, pincode string, pan string, gstin string, pan_valid boolean, gstin_valid boolean")
    pairs = [(r["a"], r["b"], r["strategy"]) for r in linkage.candidate_pairs(df).collect()]
    assert all(a < b for a, b, _ in pairs) and len({p[:2] for p in pairs}) == len(pairs)
    # phonetic keeps 25 of the bucket
    assert sum(s == "phonetic" for *_, s in pairs) <= 25 * 24 // 2


def test_activity(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "ubid long")
    tax = spark.createDataFrame([("a", 2.0, 30, True), ("b", -1.0, 0, True), ("c", 9.0, 9, False)], "event_type string, weight double, half_life int, is_active boolean")
    ev = spark.sql("SELECT * FROM VALUES (1L, 'A', date'2024-01-31'), (1L, 'c', date'2024-01-31'), (2L, 'b', date'2024-02-09'), (2L, 'zz', date'2024-01-01') AS t(ubid, event_type, event_date)")
    got = {r["ubid"]: (r["score"], r["status"], r["n_events"]) for r in activity.classify(ids, ev, tax, "2024-01-31").collect()}
    assert got == {1: (2.0, "Active", 1), 2: (-1.0, "Closed", 1), 3: (0.0, "Dormant", 0)}


def test_question_templates():
    from regolith.plans.questions import Question, match

    cases = {
        "show ABCPK0042F": "pan-lookup", "who is 29ABCPK0042F1Z5": "gstin-lookup", "Active factories with no inspection in the last 6 months in pin 560001": "factory-inspection",
        "businesses with PAN but GSTIN missing": "identifier-gap", "show the review queue": "review-queue", "how many active businesses by area": "status-by-area", "count of closed businesses by sector": "status-by-sector",
        "sector distribution of businesses": "sector-bands", "which department has the most records": "department-records", "list dormant shops": "status-list",
    }
    assert {q: match(q).tag for q in cases} == cases
    assert match("what is the weather") is None
    q = Question("not active factories, past 6 months, pin code: 560001")
    assert (q.statuses, q.pin, q.months) == (("Dormant", "Closed"), "560001", 6)
    assert Question("inactive ones").statuses == ("Dormant", "Closed") and Question("proactive").statuses is None


def test_gate(spark):
    from regolith.plans import gate

    ok = ["SELECT * FROM ubid_registry", "WITH x AS (SELECT ubid FROM ubid_registry) SELECT * FROM x;", "SELECT * FROM source_records sr JOIN ubid_registry u ON u.ubid = sr.ubid"]
    bad = [
        "", None, "DELETE FROM ubid_registry", "SELECT 1", "SELECT * FROM ubid_registry -- x", "SELECT 1 FROM ubid_registry; SELECT 2 FROM ubid_registry", "SELECT * FROM secret", "SELECT * FROM ubid_registry, secret",
        "SELECT * FROM ubid_registry WHERE EXISTS (SELECT 1 FROM secret)", "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "SELECT a FROM ubid_registry WHERE a IN (SELECT b FROM secret)", "SELECT * FROM ubid_registry WHERE a = '" + "x" * 2000 + "'", "SELECT * FROM ubid_registry WHERE (", "WITH x AS (SELECT 1 AS drop FROM ubid_registry) SELECT * FROM x", "SELECT (SELECT max(a) FROM secret) FROM ubid_registry",
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT 'CTE [secret]' FROM secret", "SELECT * FROM parquet.`/tmp/x`",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM ubid_registry", "SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM ubid_registry", "SELECT * FROM range(3)", "SELECT * FROM ubid_registry LATERAL VIEW explode(array(1)) t AS x",
        "SELECT * FROM ubid_registry WHERE ubid IN (SELECT max(reflect('a', 'b')) FROM source_records)", "SELECT * FROM (WITH y AS (SELECT * FROM ubid_registry) SELECT * FROM y)", "WITH x AS (SELECT try_reflect('a', 'b') FROM ubid_registry) SELECT * FROM x", "SELECT /* x */ * FROM ubid_registry", "SELECT count(*) FROM read_files('/etc')",
    ]
    assert [gate.check(spark, s).reason for s in ok] == ["OK"] * len(ok)
    assert [gate.check(spark, s).ok for s in bad] == [False] * len(bad)
    assert gate.with_limit("SELECT  *\nFROM t ;") == "SELECT * FROM t LIMIT 100" and gate.with_limit("select count(*) from t") == "select count(*) from t"
    assert gate.adapt("ae.date < CURRENT_DATE - INTERVAL '18 months' AND NOW() - INTERVAL '1 month' > date('now', '-2 months')", ()) == "ae.event_date < add_months(current_date(), -18) AND add_months(current_date(), -1) > add_months(current_date(), -2)"
    late = "SELECT * FROM ubid_registry u WHERE NOT EXISTS (SELECT 1 FROM activity_events ae WHERE ae.ubid = u.ubid AND MAX(ae.event_date) < date('now', '-18 months'))"
    assert gate.adapt(late, ()).endswith("WHERE ae.ubid = u.ubid AND ae.event_date >= add_months(current_date(), -18))") and gate.check(spark, gate.adapt(late, ())).ok
    assert "MAX(" in gate.adapt("SELECT ubid FROM activity_events ae GROUP BY ubid HAVING (MAX(ae.event_date) < date('now', '-1 months'))", ())
    assert gate.adapt("u.pincode = 1 AND u.sector ILIKE '%factories%'", ("A", "B")) == "u.pin_code = 1 AND u.sector IN ('A', 'B')"


def test_questions_that_find_nothing(spark):
    from regolith.plans.questions import Engine
    from regolith.sources.registry import Registry

    e = Engine(Registry(spark, SF), "2024-01-31", lambda q, err: "SELECT ubid FROM secret" if err is None else "SELECT ubid FROM ubid_registry")
    got = e.ask("list active businesses in pin 999999")
    assert got["mode"] == "no_exact_match_with_related" and got["related"] and "does not occur" in got["facts"][0]
    assert e.rows("anything else")[0] == "written-sql"


def turns(best, linked):
    """The sequential meaning, one by one."""
    at, out = dict(linked), {}
    for _, i, c, d in sorted(best):
        if i in at:
            out[i] = ("skipped", at[i], False)
            continue
        made = False
        if d == "new_ubid":
            at[i], made = f"new:{i}", True
        elif d == "auto_match":
            made = c not in at
            at[i] = at.setdefault(c, f"new:{i}")
        out[i] = (d, None, made)
    return {i: (o, at.get(i), m) for i, (o, _, m) in out.items()} | {i: ("linked_by_other", e, False) for i, e in at.items() if i not in out and i not in dict(linked)}


@pytest.mark.parametrize("seed", range(2))
def test_resolution_is_sequential(spark, seed):
    import random

    from regolith.operators import graph

    rng = random.Random(seed)
    ids = list(range(60))
    order = rng.sample(ids, 60)
    best = [(order.index(i), i, rng.choice([x for x in range(66) if x != i]), rng.choice(["auto_match"] * 4 + ["new_ubid", "review_queue"])) for i in ids]
    linked = [(i, f"E{i}") for i in (3, 7, 61)]
    got = graph.resolve(spark.createDataFrame(best, "seq long, id long, best_id long, decision string"), spark.createDataFrame(linked, "id long, entity string"))
    assert {r["id"]: (r["outcome"], r["entity"], r["maker"]) for r in got.collect()} == turns(best, linked)


def test_review_groups_chain(spark):
    from regolith.operators import review

    q = spark.createDataFrame([(1, 10, 11, 0.8), (2, 11, 12, 0.9), (3, 20, 21, 0.7), (4, 30, 31, 0.6)], "id int, record_a int, record_b int, confidence double")
    acts = spark.createDataFrame([(1, "confirm_match", 1), (2, "defer", 1), (2, "confirm_match", 2), (3, "confirm_non_match", 1), (4, "nonsense", 1)], "id int, decision string, seq int")
    links = spark.createDataFrame([(12, "U1", "2024-01-02"), (21, "U2", "2024-01-01")], "record int, entity string, linked_at string")
    got = {r["record"]: (r["entity"], r["decision_type"]) for r in review.apply(q, acts, links).collect()}
    assert got == {10: ("U1", "reviewer_approved"), 11: ("U1", "reviewer_approved"), 12: ("U1", "reviewer_approved"), 20: ("new:20", "reviewer_separate"), 21: ("U2", "kept")}
    assert review.parse_verdict("Confidence: 85%. NON-MATCH") == {"confidence": 85.0, "verdict": "NON-MATCH"}
    act = spark.createDataFrame([("U1", "Dormant", 0.2), ("U3", "Closed", -1.0)], "entity string, status string, score double")
    merged = spark.createDataFrame([("U1", 0.95), ("U9", 0.5)], "entity string, confidence double")
    assert {r["entity"]: (r["status"], r["score"]) for r in review.activity_after(act, merged).collect()} == {"U1": ("Active", 0.95), "U3": ("Closed", -1.0), "U9": ("Dormant", 0.5)}


def test_late_events_wait(spark):
    from regolith.streaming import activity as stream

    batch = spark.createDataFrame([(1, "a"), (9, "b")], "ubid long, event string")
    pending = spark.createDataFrame([(2, "c", 3)], "ubid long, event string, retry_count int")
    bound, waits = stream.bind(batch, pending, spark.createDataFrame([(1,), (2,)], "ubid long"))
    assert sorted(r["event"] for r in bound.collect()) == ["a", "c"] and [(r["event"], r["retry_count"]) for r in waits.collect()] == [("b", 1)]


def test_vectors_of_odd_shapes(spark):
    from regolith.operators import vectors

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [-1.0, 0.0])], "id long, v array<double>")
    got = [(r["id"], round(r["similarity"], 6)) for r in vectors.nearest(df.filter("id = 1"), df, 3, block=2).orderBy("rank").collect()]
    assert got == [(2, 1.0), (3, 0.0), (6, -1.0)]


def test_training_needs_examples(spark):
    from regolith.operators import training

    few = spark.range(50).selectExpr("id", "id % 2 AS label", "id % 2 AS x")
    assert training.train(few, ("x",)) is None
    many = spark.range(400).selectExpr("id", "id % 2 AS label", "id % 2 AS x", "id % 3 AS y")
    got = training.train(many, ("x", "y"))
    assert got["precision"] == got["recall"] == 1.0 and got["weights"]["x"] > 0.8 and abs(sum(map(abs, got["weights"].values())) - 1) < 1e-9
