"""A training corpus from documents: language, near copies, benchmark passages, source weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a data frame, which is written and read again as the next one's docs.
All but the last return the columns of documents, whatever their names.

Defined results: a row is judged by its own text, or named by its id and the hash of its text, since ids may be null or
repeat. Null and wordless texts have no language and go in the first stage. Repeated rows are near copies of each other,
so one stays; documents of no words take no part in the mix. Texts of any length are read whole. Empty tables pass
through all stages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regolith.llm import decontaminate, langid, mixing, simhash, tokens
from regolith.llm.common import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go, and so do ambiguous ones of which no language has half the share."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id (null last)."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, and one row per document read back from them."""
    return tokens.token_table(docs)


STAGES = [
    ("language identification", identify_language),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token output", write_tokens),
]

#: Learnt classifiers and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
