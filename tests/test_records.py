"""Functions and operators on records against cases worked by hand and plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from regolith.functions import embedding, identifiers, similarity, text, values
from regolith.operators import audit, entity, linkage, matching, records, review
from regolith.operators.order import numbered
from regolith.sources import sinks


def one(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "code"), [("4x acme", "SX:X000 A250"), ("robert 42", "SX:R163"), ("42", None), ("", None), (None, None), ("Caf\u00e9", "SX:C100")])
def test_phonetic(spark, name, code):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.phonetic(F.col("n"))).first()[0] == code


def test_phonetic_with_a_further_encoder(spark):
    df = spark.createDataFrame([("robert", "RPRT"), ("42", "X"), ("robert", None)], "n string, m string")
    assert [r[0] for r in df.select(text.phonetic(F.col("n"), F.col("m"))).collect()] == ["DM:RPRT|SX:R163", "DM:X", "SX:R163"]


def test_addresses_are_parsed(spark):
    df = spark.createDataFrame([("12, 4th Cross,  Peenya Industrial Area, Bengaluru, 560058",), ("Brigade Road, 560001",), ("",), (None,), ("--",)], "a string")
    got = [r[0] for r in df.select(text.parse_address(F.col("a"))).collect()]
    # the normal form is one part
    assert (got[0]["building"], got[0]["street"], got[0]["city"], got[0]["pincode"]) == (None, None, None, "560058")
    assert got[1]["locality"] == "brigade rd" and got[2] is None and got[3] is None
    split = df.select(text.parse_address(F.col("a"), keep_commas=True)).first()[0]
    assert (split["building"], split["street"], split["city"]) == ("12", "4th cross", "bengaluru")


def plain_ratio(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return 2 * rows[-1][-1] / (len(a) + len(b)) if a or b else 1.0


def test_name_ratio(spark):
    rng = random.Random(1)
    say = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
    rows = [(say(), say()) for _ in range(60)] + [("acme tools", "tools acme"), ("", "x"), (None, "x"), ("same", "same")]
    got = spark.createDataFrame(rows, "a string, b string").select(similarity.name_similarity(F.col("a"), F.col("b"), "ratio")).collect()
    best = lambda a, b: 0.0 if not a or not b else max(plain_ratio(a, b), plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    assert [round(r[0], 9) for r in got] == [round(best(a, b), 9) for a, b in rows]


def test_normalize_record(spark):
    payloads = ['{"entity_name": "M/s Acme & Co", "name": "", "office_address": "MG Road, 560001", "pan_number": "abcpk0042f", "gstin_no": "27AAPFU0939F1ZV", "owner_name": "Shri Rama"}', "{}", "not json", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, raw_payload string")
    got = {r["id"]: r for r in records.normalize(df).collect()}
    a = got[0]
    assert (a["normalized_name"], a["pan"], a["pan_valid"], a["gstin_valid"], a["proprietor_name"], a["pincode"], a["phonetic_name"]) == ("acme", "ABCPK0042F", True, True, "rama", "560001", "SX:A250")
    assert all(got[i]["normalized_name"] is None and got[i]["pan_valid"] is False for i in (1, 2, 3))


def test_checksum_is_of_canonical_json(spark):
    payload = {"b": 1, "a": "\u00e9", "c": [1.5, None]}
    df = spark.createDataFrame([(json.dumps(payload),), (json.dumps(dict(reversed(payload.items()))),), (None,)], "p string")
    want = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
    assert [r[0] for r in df.select(records.checksum(F.col("p"))).collect()] == [want, want, None]


def test_ingest_is_idempotent(spark):
    schema = "source_system string, source_record_id string, checksum string, n int"
    batch = spark.createDataFrame([("a", "1", "x", 1), ("a", "1", "x", 2), ("a", "1", "y", 3), ("b", None, "x", 4)], schema)
    first = records.ingest(batch.limit(0), batch)
    assert first.count() == 3 and records.ingest(first, batch).count() == 0


def test_values(spark):
    df = spark.createDataFrame([("0.85",), ("87.5",), ("1",), ("",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(values.percent(F.col("v"))).collect()] == [85, 88, 100, None, None, None]
    df = spark.createDataFrame([("2024-01-05",), ("2024-13-01",), ("2024-01-05T10:00",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(values.to_date(F.col("d"))).collect()] == ["2024-01-05", "None", "None", "None"]
    assert one(spark, values.display(F.array(F.lit(1)), "array<int>")) == "[1]" and one(spark, values.display(F.lit(""), "string")) == "N/A"


def test_neighbours_stand_in_the_order_of_all_names(spark):
    # the prefix leaves blanks out, the order does not: seven names lie between the first and the last
    names = ["ab cd", *(f"ab x{i}" for i in range(7)), "abcd", "abcde"]
    df = spark.createDataFrame([(f"r{i:02d}", n) for i, n in enumerate(names)], "id string, name string")
    got = {(r["a"], r["b"]) for r in linkage.neighbour_pairs(df, F.col("name")).collect()}
    key = sorted((n, f"r{i:02d}") for i, n in enumerate(names))
    four = lambda n: n.replace(" ", "")[:4]
    want = {tuple(sorted((a[1], b[1]))) for i, a in enumerate(key) for b in key[i + 1 : i + 6] if four(a[0]) == four(b[0])}
    assert got == want and ("r00", "r08") not in got


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 50), i) for i in range(500)]
    got = {(r["k"], r["i"]): r["place"] for r in numbered(spark.createDataFrame(rows, "k int, i int"), ["k", "i"]).collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows))}


def test_score_of_embeddings_alone(spark):
    row = {"name": None, "phonetic": None, "pincode": None, "pan": None, "gstin": None}
    cols = [F.lit(v).cast("string").alias(f"{n}_{s}") for n, v in row.items() for s in "ab"]
    same = [F.array(F.lit(1.0), F.lit(2.0)).alias(f"embedding_{s}") for s in "ab"] + [text.parse_address(F.lit(None).cast("string")).alias(f"address_{s}") for s in "ab"]
    got = linkage.score_pairs(spark.range(1).select(*cols, *same)).first()
    # its weight of 0.2 grows with the tax numbers' half shared out
    assert got["score"] == 0.4 and got["reason"] == "below_review_threshold" and got["evidence"]["contributions"]["embedding_similarity"] == 0.4


def test_model_hook(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "boom")], "id int, t string")

    def load():
        calls = {"n": 0}

        def model(text_):
            calls["n"] += 1
            if text_ == "boom":
                raise RuntimeError("down")
            return [float(len(text_))]

        return model

    got = {r["id"]: list(r["v"]) for r in embedding.with_model(df, "t", "v", load, parallel=2).collect()}
    assert got == {1: [3.0], 2: [], 3: []}
    filled = {r["id"]: r["v"] for r in embedding.ensure(df.withColumn("v", F.when(F.col("id") == 3, F.array(F.lit(7.0).cast("float")))), {"v": "t"}).collect()}
    assert filled[3] == [7.0] and len(filled[1]) == embedding.DIMENSIONS and not filled[2]


def test_resolution_tables(spark):
    pairs = spark.createDataFrame([(5, 1, "auto_match", 0.95), (1, 5, "review_queue", 0.8), (7, 2, "new_ubid", 0.1)], "new_id long, best_id long, decision string, semantic_similarity double")
    held = spark.createDataFrame([("P9", 2, 7)], "pair_id string, a long, b long")
    merged = matching.merge_pairs(pairs, held)
    got = {(r["new_id"], r["best_id"]): (r["pair_id"], r["is_new"]) for r in merged.collect()}
    assert got == {(5, 1): ("new:1-5", True), (1, 5): ("new:1-5", True), (7, 2): ("P9", False)}
    queue = spark.createDataFrame([("new:1-5", 0.7, 90, "deferred", "n"), ("P9", 0.5, 1, "resolved", "n")], "pair_id string, confidence double, priority int, status string, notes string")
    now = {r["pair_id"]: (r["confidence"], r["priority"], r["status"]) for r in matching.enqueue(queue, merged).collect()}
    assert now == {"new:1-5": (0.8, 90, "deferred"), "P9": (0.5, 1, "resolved")}
    fresh = matching.enqueue(queue.limit(0), merged).collect()
    assert [(r["pair_id"], r["priority"], r["status"]) for r in fresh] == [("new:1-5", 80, "pending")]
    resolved = spark.createDataFrame([(7, "new_ubid", "new:7", True), (5, "auto_match", "new:5", True), (1, "linked_by_other", "new:5", False), (9, "skipped", "E9", False)], "id long, outcome string, entity string, maker boolean")
    recs = spark.createDataFrame([(1, "abcpk0001f", True, None, False), (5, "ABCPK0005F", True, "g", True), (7, "BAD", False, None, False)], "id long, pan string, pan_valid boolean, gstin string, gstin_valid boolean")
    made = {r["entity"]: r for r in matching.new_identities(resolved, recs, issued=41).collect()}
    assert made["new:5"]["pan"] == "ABCPK0001F" and made["new:5"]["gstin"] == "G" and made["new:7"]["pan"] is None
    assert [made[e]["ubid"][:22] for e in ("new:5", "new:7")] == ["UBID-KA-29-2024-000042", "UBID-KA-29-2024-000043"]
    links = matching.links(resolved, matching.new_identities(resolved, recs, 41), spark.createDataFrame([(5, 0.95)], "id long, similarity double"), spark.createDataFrame([(9,)], "id long"))
    assert {r["id"]: r["decision_type"] for r in links.collect()} == {7: "new_ubid", 5: "embedding_auto_match", 1: "embedding_auto_match"}


def test_pseudonyms_are_undone(spark):
    df = spark.createDataFrame([("Acme",), (" acme ",), ("Beta",), ("",)], "n string")
    table = identifiers.pseudonyms(df.filter("n <> 'Beta'"), "n")
    back = identifiers.restore(df.select(identifiers.pseudonym_name(F.col("n")).alias("who")), "who", table)
    assert sorted(r[0] for r in back.collect()) == sorted(["Acme", "Acme", "BIZ-" + hashlib.sha256(b"beta").hexdigest()[:8], "BIZ-unknown"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "topic string, value int")
    sinks.commit({"a": df, "b": df}, f"file://{tmp_path}/db")
    sinks.commit({"a": df.union(df)}, f"file://{tmp_path}/db")
    assert sinks.table(spark, f"file://{tmp_path}/db", "a").count() == 2 and sinks.table(spark, f"file://{tmp_path}/db", "b").count() == 1
    # one that cannot be computed leaves all as they were
    with pytest.raises(Exception, match="boom"):
        sinks.commit({"b": df.union(df), "c": df.select(F.raise_error(F.lit("boom")).alias("x"))}, f"file://{tmp_path}/db")
    assert sinks.table(spark, f"file://{tmp_path}/db", "b").count() == 1
    with pytest.raises(Exception, match="boom"):  # the events' own fault is no fault of the sink
        sinks.publish(df.select("topic", F.raise_error(F.lit("boom")).alias("value")), f"file://{tmp_path}/events")
    assert sinks.publish(df, f"file://{tmp_path}/events") and spark.read.json(f"file://{tmp_path}/events").count() == 1
    assert sinks.publish(df, "kafka", {"topic": "t", "kafka.bootstrap.servers": "127.0.0.1:1"}) is False


def test_queue_worker(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "n int").write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("n int").parquet(f"{tmp_path}/in")
    for _ in range(2):
        sinks.each_batch(stream, lambda df, number: seen.append((number, df.count())), f"{tmp_path}/progress").awaitTermination()
    assert seen == [(0, 5)]


def test_csv_is_quoted(spark, tmp_path):
    from regolith.operators import reports

    cols = "ubid int, business_name string, status string, sector string, pan_anchor string, gstin_anchor string, pin_code string, linked_record_count int, confidence_score double"
    reports.export_csv(spark.createDataFrame([(1, 'A, "B"', "Active", "X", None, "", "560001", 2, 0.5)], cols), f"{tmp_path}/csv")
    got = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert got["Business Name"] == 'A, "B"' and got["PAN"] == got["GSTIN"] == "N/A" and len(got) == 9


def test_written_explanations():
    got = entity.parse_explanation("Status: Active\nExplanation: busy\nLast significant event: renewal")
    assert got == {"explanation": "busy", "last_event": "renewal"} and entity.parse_explanation("free text")["explanation"] == "free text"


def test_review_locks_and_audit(spark):
    q = spark.createDataFrame([(1, "pending"), (2, "resolved")], "id int, status string")
    want = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "id int, reviewer string, at int")
    assert {r["id"]: (r["status"], r["locked_by"]) for r in review.lock(q, want).collect()} == {1: ("locked", "a"), 2: ("resolved", None)}
    rows = spark.sql("SELECT named_struct('version', 'v1') AS old, named_struct('version', 'v2') AS new")
    got = audit.threshold_changed(rows, F.lit("me")).first()
    assert (got["entity_id"], got["before_state"], got["actor"]) == ("v2", '{"version":"v1"}', "me")


def test_links_that_a_review_ends(spark):
    links = spark.createDataFrame([(1, "U1"), (2, "U2"), (3, "U3")], "record int, entity string")
    after = spark.createDataFrame([(1, "U1", "reviewer_approved"), (2, "U1", "reviewer_approved"), (3, "U9", "kept")], "record int, entity string, decision_type string")
    assert [(r["record"], r["entity"], r["unlinked_at"]) for r in review.unlinked_by(links, after, "2024-01-31").collect()] == [(2, "U2", "2024-01-31")]


def test_made_up_businesses(spark):
    from regolith.sources import generator

    rows = generator.businesses(spark.range(40)).collect()
    per = {}
    for r in rows:
        per.setdefault(r["business"], []).append(r["source_system"])
    assert len(per) == 40 and all(1 <= len(x) <= 5 and len(set(x)) == len(x) for x in per.values()) and max(map(len, per.values())) > 1
    assert sorted(map(repr, rows)) == sorted(map(repr, generator.businesses(spark.range(40)).collect()))
    pairs = generator.ambiguous_pairs(spark.range(7)).collect()
    assert len(pairs) == 14 and len({r["raw_payload"] for r in pairs}) == 14


# What the published method gives, by word: primary and secondary code.
SOUNDS = {
    "smith": ("SM0", "XMT"), "schmidt": ("XMT", "SMT"), "thompson": ("TMPSN", "TMPSN"), "catherine": ("K0RN", "KTRN"), "richard": ("RXRT", "RKRT"), "michael": ("MKL", "MXL"), "knight": ("NT", "NT"), "wright": ("RT", "RT"),
    "caesar": ("SSR", "SSR"), "chianti": ("KNT", "KNT"), "character": ("KRKTR", "KRKTR"), "architect": ("ARKTKT", "ARKTKT"), "orchestra": ("ARKSTR", "ARKSTR"), "mchugh": ("MK", "MK"), "czerny": ("SRN", "XRN"), "focaccia": ("FKX", "FKX"),
    "bellocchio": ("PLX", "PLX"), "bacci": ("PX", "PX"), "accident": ("AKSTNT", "AKSTNT"), "succeed": ("SKST", "SKST"), "edge": ("AJ", "AJ"), "edgar": ("ATKR", "ATKR"), "laugh": ("LF", "LF"), "cough": ("KF", "KF"), "hugh": ("H", "H"),
    "ghislane": ("JLN", "JLN"), "tagliaro": ("TKLR", "TLR"), "danger": ("TNJR", "TNKR"), "jose": ("HS", "HS"), "yankelovich": ("ANKLFX", "ANKLFK"), "cabrillo": ("KPRL", "KPR"), "thumb": ("0M", "TM"), "campbell": ("KMPL", "KMPL"),
    "rogier": ("RJ", "RJR"), "hochmeier": ("HKMR", "HKMR"), "island": ("ALNT", "ALNT"), "sugar": ("XKR", "SKR"), "snider": ("SNTR", "XNTR"), "school": ("SKL", "SKL"), "schenker": ("XNKR", "SKNKR"), "artois": ("ART", "ARTS"),
    "thomas": ("TMS", "TMS"), "wasserman": ("ASRMN", "FSRMN"), "arnow": ("ARN", "ARNF"), "filipowicz": ("FLPTS", "FLPFX"), "breaux": ("PR", "PR"), "zhao": ("J", "J"), "xavier": ("SF", "SFR"), "nation": ("NXN", "NXN"), "match": ("MX", "MX"),
    "bajador": ("PJTR", "PHTR"), "tichner": ("TXNR", "TKNR"), "pizza": ("PS", "PTS"), "biaggi": ("PJ", "PK"), "szymanski": ("SMNSK", "XMNSK"), "caf\u00e9": ("KF", "KF"), "42": ("", ""),
}


def test_double_metaphone(spark):
    from regolith.functions import metaphone

    assert {w: metaphone.codes(w) for w in SOUNDS} == SOUNDS
    df = spark.createDataFrame([("smith edge",), ("42",), ("",), (None,), ("Robert 42",)], "n string")
    got = [r[0] for r in df.select(text.phonetic(F.col("n"), metaphone.metaphone(F.col("n")))).collect()]
    assert got == ["DM:SM0 AJ|SX:S530 E320", None, None, None, "DM:RPRT|SX:R163"]


def test_codes_beyond_six_digits(spark):
    df = spark.createDataFrame([(999_999,), (1_000_000,), (1_000_001,), (12_345_678,)], "n long")
    got = [r[0] for r in df.select(identifiers.ubid_code(F.col("n"))).collect()]
    assert [x.split("-")[4] for x in got] == ["999999", "1000000", "1000001", "12345678"]


def test_learnt_weights_by_plain_python(spark):
    """The same penalised, balanced fit by Newton's method."""
    import numpy as np

    from regolith.operators import training

    rng = np.random.default_rng(9)
    n = 400
    x = np.column_stack([rng.random(n), rng.integers(0, 2, n), rng.normal(size=n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] + 1.5 * x[:, 1] - 0.8 * x[:, 2] - 2.2)))).astype(float)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "id long, label int, a double, b double, c double")
    got = training.train(df, ("a", "b", "c"))
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    z, beta, ridge = np.column_stack([x, np.ones(n)]), np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):  # mean loss plus half the penalty of 1 / n
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) / w.sum() + ridge / n, z.T @ (w * (p - y)) / w.sum() + ridge @ beta / n)
    share = np.abs(beta[:3]).sum()
    assert np.allclose([got["weights"][k] for k in "abc"], beta[:3] / share, atol=1e-3) and abs(got["intercept"] - beta[3]) < 1e-2
    assert 0.5 < got["precision"] <= 1 and 0.5 < got["recall"] <= 1
