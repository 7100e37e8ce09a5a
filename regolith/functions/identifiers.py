"""Tax identifiers and registry codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the identifiers' formats.
PAN_PATTERN, PAN_KINDS = "^[A-Z]{5}[0-9]{4}[A-Z]$", tuple("ABCFGHLJPT")
GSTIN_PATTERN, BASE36 = "^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def clean(value: Column) -> Column:
    return F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))


def pan_ok(value: Column) -> Column:
    c = clean(value)
    return F.coalesce(c.rlike(PAN_PATTERN) & F.substring(c, 4, 1).isin(*PAN_KINDS), F.lit(False))


def gstin_check_character(first14: Column) -> Column:
    def locate(i):
        return (F.instr(F.lit(BASE36), F.substring(first14, i, F.lit(1))) - 1) * F.when(i % 2 == 0, 2).otherwise(1)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda t, i: t + F.floor(locate(i) / 36).cast("int") + locate(i) % 36)
    return F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))


def gstin_ok(value: Column) -> Column:
    c = clean(value)
    return F.coalesce(c.rlike(GSTIN_PATTERN) & (F.substring(c, 15, 1) == gstin_check_character(c)), F.lit(False))


def check_digit(digits: Column) -> Column:
    """Every second digit from the last but one is doubled; what brings the sum of digits to a multiple of ten."""
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    n = F.length(digits)
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, i: t + F.when((n - i) % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return (10 - total % 10) % 10


def ubid_code(sequence: Column, year: int = 2024) -> Column:
    number = sequence.cast("string")
    six = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)  # more digits stay as they are
    return F.concat(F.lit(f"UBID-KA-29-{year}-"), six, F.lit("-"), check_digit(F.concat(F.lit(f"29{year}"), six)).cast("string"))


def hashed(value: Column, n: int) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(value)), 256), 1, n)


def pseudonym_name(name: Column) -> Column:
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "BIZ-unknown").otherwise(F.concat(F.lit("BIZ-"), hashed(name, 8)))


def pseudonym_address(address: Column) -> Column:
    found = F.regexp_extract(address, r"\b(\d{6})\b", 1)
    pin = F.when(found != "", found).otherwise("XXXXXX")
    return F.when(F.coalesce(address, F.lit("")) == "", "ADDR-none").otherwise(F.concat(F.lit("ADDR-"), hashed(address, 6), F.lit(", PIN-"), pin))


def has_pan(text: Column) -> Column:
    return F.coalesce(text.rlike("[A-Z]{5}[0-9]{4}[A-Z]"), F.lit(False))


def pan(value: Column) -> Column:
    """struct(value, valid): cleaned, and whether it has the form; null and false for null or empty."""
    return F.struct(F.when(F.coalesce(value, F.lit("")) != "", clean(value)).alias("value"), pan_ok(value).alias("valid"))


def gstin(value: Column) -> Column:
    return F.struct(F.when(F.coalesce(value, F.lit("")) != "", clean(value)).alias("value"), gstin_ok(value).alias("valid"))


def _tail(value: Column, mark: str, n: int) -> Column:
    """The last n characters behind a mark; empty values stay as they are."""
    return F.when(F.coalesce(value, F.lit("")) == "", value).otherwise(F.concat(F.lit(f"{mark}-"), F.when(F.length(value) >= n, F.substring(value, -n, n)).otherwise("X" * n)))


def pseudonym_record(name: Column, address: Column, pan: Column, gstin: Column, director: Column | None = None) -> Column:
    """A record's fields as they may leave the house; PIN code, sector and district need no cover."""
    fields = [pseudonym_name(name).alias("name"), pseudonym_address(address).alias("address"), _tail(pan, "PAN", 4).alias("pan"), _tail(gstin, "GST", 6).alias("gstin")]
    return F.struct(*fields, *[] if director is None else [pseudonym_name(director).alias("director")])


def pseudonyms(names: DataFrame, name_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, pseudonym, name): the table that authorised readers join to undo pseudonyms; of equal ones the smallest name.

    A pseudonym has 32 bits, so among some ten thousand names two share one: the records' keys `by` keep them apart."""
    return names.select(*by, pseudonym_name(F.col(name_col)).alias("pseudonym"), F.trim(F.col(name_col)).alias("name")).filter("name <> ''").groupBy(*by, "pseudonym").agg(F.min("name").alias("name"))


def restore(df: DataFrame, column: str, table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The column with known pseudonyms undone, those of the same record if the table has keys `by`; others stay."""
    known = table.select(*by, F.col("pseudonym").alias(column), F.col("name").alias("_restored"))
    return df.join(known, [*by, column], "left").select(*df.columns, "_restored").withColumn(column, F.coalesce("_restored", column)).drop("_restored")
