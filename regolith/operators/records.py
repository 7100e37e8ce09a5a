"""Raw records: payloads to normalised records, checksums, and ingest that repeats nothing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regolith.functions import identifiers, text, values

# The names that a payload's fields go by, first choice first.
FIELDS = {
    "name": ("name", "business_name", "entity_name", "trade_name"), "address": ("address", "registered_address", "office_address"), "pan": ("pan", "pan_number"),
    "gstin": ("gstin", "gst_number", "gstin_no"), "proprietor": ("proprietor_name", "owner_name", "partner_name", "contact_person"), "sector": ("sector", "business_activity"),
}


def field(payload: Column, name: str) -> Column:
    """The first non-empty field of the payload among the names that it goes by."""
    return values.first_value(*[F.get_json_object(payload, f"$.{n}") for n in FIELDS[name]])


def normalize(raw: DataFrame, payload_col: str = "raw_payload", keep_commas: bool = False, metaphone=None) -> DataFrame:
    """Raw records with normalized_name, phonetic_name, parsed_address, pincode, pan, pan_valid, gstin, gstin_valid,
    proprietor_name and sector.

    The payload is read once and each field cleaned once: what follows uses the columns, not the expressions again.
    Fields that are missing, and all of a payload that is null or no JSON object, are null (validity false).
    """
    p = F.col(payload_col)
    out = raw.withColumns({f"_{n}": field(p, n) for n in FIELDS})
    out = out.withColumns({"normalized_name": text.normalize_name(F.col("_name")), "parsed_address": text.parse_address(F.col("_address"), keep_commas), "proprietor_name": text.normalize_name(F.col("_proprietor")), "_p": identifiers.pan(F.col("_pan")), "_g": identifiers.gstin(F.col("_gstin")), "sector": F.col("_sector")})
    name = F.col("normalized_name")
    out = out.withColumns({"phonetic_name": text.phonetic(name, metaphone(name) if metaphone else None), "pincode": F.col("parsed_address.pincode"), "pan": F.col("_p.value"), "pan_valid": F.col("_p.valid"), "gstin": F.col("_g.value"), "gstin_valid": F.col("_g.valid")})
    return out.drop("_p", "_g", *[f"_{n}" for n in FIELDS])


@F.pandas_udf(StringType())
def _canonical(payload: pd.Series) -> pd.Series:
    """Sorted keys, a blank after comma and colon, ASCII only."""

    def tidy(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), sort_keys=True)
        except ValueError:
            return json.dumps(x)

    return payload.map(tidy)


def checksum(payload: Column) -> Column:
    """SHA-256 of the payload's canonical JSON, so that the order of its fields does not matter."""
    return F.sha2(_canonical(payload), 256)


def ingest(held: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("source_system", "source_record_id", "checksum")) -> DataFrame:
    """What of a batch is new: once each, and not held already. Running a batch again adds nothing."""
    fresh = batch.dropDuplicates(list(keys))
    held = held.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return fresh.join(held, on, "left_anti")
