"""The registry's tables, from the test tables (or any of the same shape)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event type, registry name, weight, half-life in days, active.
TAXONOMY = (("view", "inspection", 0.4, 30, True), ("purchase", "renewal", 0.5, 60, True), ("click", "utility_reading", 0.1, 15, True), ("signup", "compliance_filing", 0.3, 45, False), ("error", "closure_declaration", -0.9, 90, True))
INDUSTRIAL = ("MACHINERY", "BUILDING", "AUTOMOBILE")
SOURCES = (("1", "tax"), ("2", "municipal"), ("3", "labor"), ("4", "pollution"), ("5", "water"))


class Registry:
    """Lazily built data frames; a table's columns are those its readers need.

    tables: another reader of tables by name than that of Parquet files, such as `jdbc.tables`. stored: where the read model's
    businesses are read from instead of being computed from all records, such as `readmodel.stored`.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Callable[[str], DataFrame] | None = None, stored: Callable[[Registry], DataFrame] | None = None):
        self.spark, self.dir, self.tables, self.stored = spark, sf_dir, tables, stored

    def table(self, name: str) -> DataFrame:
        return self.tables(name) if self.tables else self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def ubids(self) -> DataFrame:
        k = F.col("c_custkey")
        pan = F.when(k % 5 != 0, F.concat(F.lit("ABCPK"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F")))
        gstin = F.when(k % 3 == 0, F.concat(F.lit("29ABCPK"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z5")))
        made = F.date_add(F.lit("2023-01-01").cast("date"), (k % 365).cast("int"))
        return self.table("customer").select(k.alias("ubid"), pan.alias("pan"), gstin.alias("gstin"), (k % 50 != 49).alias("is_canonical"), made.alias("created_on"), F.date_add(made, (k % 90).cast("int")).alias("updated_on"))

    def raw_records(self) -> DataFrame:
        source = F.lit("other")
        for digit, name in SOURCES:
            source = F.when(F.substring("o_orderpriority", 1, 1) == digit, name).otherwise(source)
        k, owner = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        name = F.when(k % 40 != 7, F.concat(F.lit("Customer "), owner))
        address = F.when(k % 6 != 1, F.concat(F.lit("Plot "), (k % 90).cast("string"), F.lit(", MG Road, "), (k % 25 + 560000).cast("string")))
        return self.table("orders").select(
            k.alias("raw_id"), F.col("o_custkey").alias("owner"), source.alias("source_system"), F.concat(F.upper(F.substring(source, 1, 3)), F.lit("-"), k.cast("string")).alias("source_record_id"), F.col("o_orderdate").alias("extracted_at"),
            F.to_json(F.struct(name.alias("name"), address.alias("address"))).alias("raw_payload"),
        )

    def identifiers(self) -> DataFrame:
        """The tax numbers that each raw record states: some none, some those of another identity."""
        k, owner = F.col("o_orderkey"), F.col("o_custkey")
        pan = lambda n: F.concat(F.lit("ABCPK"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("F"))
        return self.table("orders").select(k.alias("raw_id"), F.when(k % 9 == 0, None).when(k % 11 == 0, pan(owner + 1)).otherwise(pan(owner)).alias("pan"), F.when((owner % 3 == 0) & (k % 4 != 0), F.concat(F.lit("29"), pan(owner), F.lit("1Z5"))).alias("gstin"), F.when(k % 3 == 0, 12.9 + (k % 10) / 100.0).alias("latitude"), F.when(k % 3 == 0, 77.5 + (k % 7) / 100.0).alias("longitude"))

    def pairs(self) -> DataFrame:
        """Candidate pairs of raw records with score, review and decision."""
        k = F.col("o_orderkey")
        o = self.table("orders").select("o_orderkey")
        both = o.filter(k % 10 == 0).join(o.select((k - 5).alias("o_orderkey")), "o_orderkey")
        decision = F.when(k % 30 == 0, "confirm_match").when(k % 30 == 10, "confirm_non_match")
        return both.select(
            k.alias("pair_id"), k.alias("a"), (k + 5).alias("b"), F.when(k % 20 == 0, "pan_exact").otherwise("phonetic").alias("strategy"), (F.lit(0.5) + (k % 50).cast("double") / 100.0).alias("score"),
            F.when(decision.isNotNull(), "resolved").when(k % 70 == 0, "locked").otherwise("pending").alias("review_status"), decision.alias("reviewer_decision"), F.when(k % 40 == 0, "separate").otherwise("review_queue").alias("decision_type"),
        )

    def overrides(self) -> DataFrame:
        """Statuses that reviewers set by hand."""
        k = F.col("c_custkey")
        return self.table("customer").filter(k % 29 == 5).select(k.alias("ubid"), F.when(k % 2 == 0, "Active").otherwise("Closed").alias("override"))

    def audits(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").filter(k % 3 == 0).select(k.alias("id"), F.col("o_custkey").alias("ubid"), F.when(k % 2 == 0, "record_linked").otherwise("decision_made").alias("action"), F.lit("system").alias("actor"), F.lit("ubid").alias("entity_type"), F.to_date("o_orderdate").alias("created_at"))

    def normalized(self) -> DataFrame:
        c = self.table("customer").select(F.col("c_custkey").alias("owner"), F.lower("c_name").alias("normalized_name"), (F.col("c_nationkey") + 560000).cast("string").alias("pincode"), F.col("c_mktsegment").alias("sector"))
        return self.raw_records().select("raw_id", "owner").join(c, "owner").drop("owner")

    def links(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(k.alias("raw_id"), F.col("o_custkey").alias("ubid"), (F.lit(0.5) + (k % 50).cast("double") / 100.0).alias("confidence"), F.when(k % 20 == 0, F.col("o_orderdate")).alias("unlinked_at"), F.col("o_orderdate").alias("linked_at"), F.when(k % 3 == 0, "auto_link").otherwise("reviewer_approved").alias("decision_type"))

    def events(self, rows: DataFrame | None = None) -> DataFrame:
        """From the events table, or from `rows` of its columns (a stream)."""
        kind = F.lit(None).cast("string")
        for name, registry, *_ in TAXONOMY:
            kind = F.when(F.col("event_type") == name, registry).otherwise(kind)
        return (self.table("events") if rows is None else rows).select("event_id", F.col("user_id").alias("ubid"), kind.alias("event_type"), F.to_date("ts").alias("event_date"), F.get_json_object("props", "$.k").alias("outcome"), F.col("ts").alias("ingested_at"))

    def taxonomy(self) -> DataFrame:
        rows = ", ".join(f"('{n}', {w}D, {h}, {str(on).lower()})" for _, n, w, h, on in TAXONOMY)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_type, weight, half_life, is_active)")

    def review_records(self) -> DataFrame:
        """Parts as records under review: some share a tax number or PIN with the part 25 keys on, some lack them."""
        k = F.col("p_partkey")
        two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
        pan = F.when(k % 3 == 0, None).otherwise(F.concat(F.lit("ABCPK00"), F.when(k % 4 == 0, two(70)).otherwise(two(25)), F.lit("F")))
        return self.table("part").select(
            k.alias("record"), "p_brand", F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("address"), pan.alias("pan"), F.when(k % 6 < 3, F.concat(F.lit("G"), two(25))).alias("gstin"),
            F.concat(F.lit("5600"), F.when(k % 8 == 0, two(40)).otherwise(two(5))).alias("pincode"), F.col("p_type").alias("sector"),
        )

    def review_queue(self) -> DataFrame:
        k = F.col("p_partkey")
        p = self.table("part").select("p_partkey", "p_brand")
        pairs = p.join(p.select((k - 25).alias("p_partkey"), "p_brand").hint("merge"), ["p_partkey", "p_brand"])
        return pairs.select(
            k.alias("id"), k.alias("record_a"), (k + 25).alias("record_b"), (F.lit(0.5) + (k % 50).cast("double") / 100.0).alias("confidence"), (k % 50 + 50).cast("int").alias("priority"),
            F.when(k % 5 == 0, "resolved").when(k % 7 == 0, "locked").otherwise("pending").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("queued_at"),
        )

    def review_actions(self) -> DataFrame:
        """What reviewers decided about every fifth item."""
        i = F.col("id")
        return self.review_queue().filter(i % 5 == 0).select("id", F.when(i % 3 == 0, "confirm_match").when(i % 3 == 1, "confirm_non_match").otherwise("defer").alias("decision"), F.lit(1).alias("seq"))

    def review_links(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").filter(k % 4 == 0).select(k.alias("record"), F.concat(F.lit("U"), (k % 100).cast("string")).alias("entity"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("linked_at"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
