"""Businesses made up by rule for given keys: a payload by department for each, the same for the same key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.sources.registry import SOURCES

WORDS = ("Sapthagiri", "Nandi", "Kaveri", "Malnad", "Deccan", "Sahyadri", "Tunga", "Bhadra")
TRADES = ("Engineering Works", "Chemicals", "Electronics", "Logistics", "Tools", "Plastics", "Textiles", "Foods")
FORMS = ("Pvt Ltd", "& Co", "LLP", "Enterprises")


def _pick(values: tuple[str, ...], seed: str, *of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(len(values))) + 1).cast("int"))


def businesses(keys: DataFrame, seed: str = "registry") -> DataFrame:
    """(business, source_system, source_record_id, raw_payload) for keys (id): each business is known to 1 to 5
    departments, which write its name differently; some leave out its tax number."""
    b = F.col("business")
    base = keys.select(F.col("id").cast("long").alias("business"))
    base = base.withColumns({"stem": F.concat_ws(" ", _pick(WORDS, seed + "w", b), F.concat(F.lit("No"), b.cast("string")), _pick(TRADES, seed + "t", b)), "n": F.pmod(F.xxhash64(F.lit(seed), b), F.lit(len(SOURCES))) + 1})
    names = F.array(*[F.lit(name) for _, name in SOURCES])
    rows = base.withColumn("source_system", F.explode(F.slice(names, F.lit(1), F.col("n").cast("int")))).drop("n")
    s = F.col("source_system")
    name = F.concat_ws(" ", F.col("stem"), _pick(FORMS, seed + "f", b, s))
    pan = F.concat(F.lit("ABCPK"), F.lpad((b % 10000).cast("string"), 4, "0"), F.lit("F"))
    stated = F.pmod(F.xxhash64(F.lit(seed + "p"), b, s), F.lit(10)) < 7
    address = F.concat(F.lit("Plot "), (b % 90 + 1).cast("string"), F.lit(", MG Road, "), (b % 99 + 560001).cast("string"))
    body = F.to_json(F.struct(name.alias("name"), address.alias("address"), F.when(stated, pan).alias("pan")))
    return rows.select("business", "source_system", F.concat(F.upper(F.substring(s, 1, 3)), F.lit("-"), b.cast("string")).alias("source_record_id"), body.alias("raw_payload"))


def ambiguous_pairs(keys: DataFrame, seed: str = "registry") -> DataFrame:
    """(pair, side, raw_payload) for keys (id): records of two businesses at one address whose names differ in one word, without numbers."""
    p = F.col("pair")
    rows = keys.select(F.col("id").cast("long").alias("pair"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    name = F.concat_ws(" ", _pick(WORDS, seed + "x", p), _pick(TRADES, seed + "y", p), F.when(F.col("side") == "a", "Pvt Ltd").otherwise("Unit Two Pvt Ltd"))
    address = F.concat(F.lit("Plot "), (p + 1).cast("string"), F.lit(", Peenya Industrial Area, 560058"))
    return rows.select("pair", "side", F.to_json(F.struct(name.alias("name"), address.alias("address"))).alias("raw_payload"))
