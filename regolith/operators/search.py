"""Substring search by trigrams: stored postings are intersected, and what is left is looked at.

Three stored tables (`sources.buckets`): the records by id; the postings; and by trigram how many records have it in one of
the searched columns. Postings are kept by blocks of records (an Arrow batch): a row is a trigram, a block and one bit for
each of its records, compressed, and a block's ids are a row of the same table under the block's name. So a trigram that
all records have costs a few bytes a block, not an id a record. A search reads the buckets of its rarest trigrams, of the
blocks where these meet and of the records that have all of them; the condition itself is then tested on those records,
so the rows are those of a scan.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import defaultdict
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from regolith.sources.buckets import Store

#: Trigrams of a search that are looked up, the rarest ones.
LOOKED_UP = 4
GRAM = 3


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _posted(batches):
    """One row for each trigram of a batch, and one with the batch's ids; texts are in lower case."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, places = uuid.uuid4().hex, defaultdict(list)
        for place, texts in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
            for gram in set().union(*[grams(t) for t in texts if t]):
                places[gram].append(place)
        bits = [zlib.compress(np.packbits(np.bincount(at, minlength=batch.num_rows).astype(bool)), 1) for at in places.values()]
        ids = batch.column(0)
        own = pa.ListArray.from_arrays(pa.array([0, *[None] * len(bits), len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([block, *places]), pa.array([block] * (len(bits) + 1)), pa.array([0, *map(len, places.values())], pa.int64()), pa.array([None, *bits], pa.binary()), own], ["gram", "block", "n", "bits", "ids"])


@F.pandas_udf(ArrayType(IntegerType()))
def _shared(bits: pd.Series) -> pd.Series:
    """The places (from 1) that all of a block's bits have."""
    every = lambda x: reduce(np.bitwise_and, [np.frombuffer(zlib.decompress(b), np.uint8) for b in x])
    return bits.map(lambda x: (np.flatnonzero(np.unpackbits(every(x))) + 1).astype(np.int32))


def matches(columns: tuple[str, ...], like: str) -> Column:
    """Whether one of the columns has the text somewhere, whatever its case; % and _ are wildcards."""
    return reduce(or_, [F.coalesce(F.col(n), F.lit("")).ilike(f"%{like}%") for n in columns])


def index(store: Store, records: DataFrame, id_col: str, columns: tuple[str, ...], buckets: int = 64) -> None:
    """Store records, postings and counts as one version. The records are computed once; postings come from the stored ones."""
    change = store.begin()
    change.create("records", records.schema, id_col, buckets)
    change.replace("records", records, range(buckets))
    texts = change.read("records").select(F.col(id_col).alias("id"), *[F.lower(F.col(n)).alias(f"t{i}") for i, n in enumerate(columns)])
    postings = texts.mapInArrow(_posted, f"gram string, block string, n long, bits binary, ids array<{records.schema[id_col].dataType.simpleString()}>")
    change.create("postings", postings.schema, "gram", buckets)
    change.replace("postings", postings, range(buckets))
    counts = change.read("postings").filter("bits is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    change.create("grams", counts.schema, "gram", buckets)
    change.replace("grams", counts, range(buckets))
    change.commit()


def asked_grams(like: str) -> list[str]:
    """The trigrams that every match has: those of the text between wildcards, as Spark lower-cases it."""
    pieces = re.split(r"%|_|\\.?", like)
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def find(store: Store, like: str, columns: tuple[str, ...]) -> DataFrame:
    """The records of which a column has the text. Without a trigram in it all records are looked at."""
    change = store.begin()
    low = store.spark.range(1).select(F.lower(F.lit(like))).first()[0]
    wanted = asked_grams(low)
    if not wanted:
        return change.read("records").filter(matches(columns, like))
    asked = store.spark.createDataFrame([(g,) for g in wanted], "gram string")
    counts = change.read("grams", change.touched("grams", asked)).filter(F.col("gram").isin(wanted)).orderBy("n", "gram").limit(LOOKED_UP)
    known = [r["gram"] for r in counts.collect()]
    if len(known) < min(len(wanted), LOOKED_UP):  # one of them is nowhere
        return change.read("records", [])
    asked = asked.filter(F.col("gram").isin(known))
    found = change.read("postings", change.touched("postings", asked)).filter(F.col("gram").isin(known) & F.col("bits").isNotNull())
    met = found.groupBy("block").agg(F.collect_list("bits").alias("bits")).filter(F.size("bits") == len(known)).select("block", _shared("bits").alias("places")).filter(F.size("places") > 0)
    blocks = change.read("postings", change.touched("postings", met.select(F.col("block").alias("gram")))).filter("bits is null").select("block", "ids")
    ids = met.join(blocks.hint("merge"), "block").select(F.explode(F.transform("places", lambda i: F.element_at("ids", i))).alias("id"))
    key = change.next["tables"]["records"]["key"]
    where = sorted(r[0] for r in ids.select(change.bucket("records", F.col("id")).alias("b")).distinct().collect())
    return change.read("records", where).join(ids.withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left_semi").filter(matches(columns, like))
