"""Tolerant readings and displays of single values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def to_date(value: Column) -> Column:
    """A date of a date, a timestamp or an ISO text of just a date; null for anything else."""
    return F.when(value.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value.cast("string"), "yyyy-MM-dd"))


def date_text(value: Column) -> Column:
    """What stands before a T or blank; empty for null."""
    return F.coalesce(F.regexp_extract(value.cast("string"), "^([^T ]*)", 1), F.lit(""))


def months_before(date: Column, n: int) -> Column:
    return F.add_months(date, -n)


def json_field(text: Column, name: str, fallback: Column | None = None) -> Column:
    """A field of a JSON object; the fallback (null) for null, broken or other JSON."""
    found = F.get_json_object(text, f"$.{name}")
    return found if fallback is None else F.coalesce(found, fallback)


def json_or(text: Column, schema: str, fallback: Column) -> Column:
    """Parsed JSON, or the fallback where it is null or does not parse."""
    valid = F.try_parse_json(text).isNotNull()
    return F.when(valid, F.from_json(text, schema)).otherwise(fallback)


def append(values: Column, item: Column) -> Column:
    """The array with one item more; a null array counts as empty."""
    return F.when(values.isNull(), F.array(item)).otherwise(F.array_append(values, item))


def percent(value: Column) -> Column:
    """Shares up to 1 and percentages alike in whole per cent, halves to even; null for what is no number."""
    n = value.try_cast("double")
    return F.bround(F.when(n <= 1, n * 100).otherwise(n)).cast("int")


def share_of(part: Column, whole: Column) -> Column:
    """Per cent, at most 100; nothing of nothing is 0."""
    return F.least(F.lit(100.0), part / F.greatest(whole, F.lit(1)) * 100)


def display(value: Column, kind: str) -> Column:
    """Text for a table's cell: N/A for null and empty, grouped whole numbers, three places, objects as JSON."""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        shown = F.format_number(value, 0)
    elif kind in ("double", "float") or kind.startswith("decimal"):
        # a negative zero is shown as zero
        shown = F.when(value == 0, "0").when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.replace(F.format_number(value, 3), F.lit(","), F.lit("")))
    elif kind.startswith(("struct", "array", "map")):
        shown = F.to_json(value)
    else:
        shown = F.when(value.cast("string") != "", value.cast("string"))
    return F.coalesce(shown, F.lit("N/A"))


def address_line(parsed: Column, payload_address: Column, pincode: Column, parts: tuple[str, ...] = ("building", "street", "locality", "city", "pincode", "raw")) -> Column:
    """The parsed address in one line, else the payload's, else the PIN code, else N/A."""
    line = F.concat_ws(", ", *[F.when(parsed[p] != "", parsed[p]) for p in parts])
    return F.coalesce(first_value(line, payload_address, pincode), F.lit("N/A"))
