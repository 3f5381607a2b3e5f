"""From raw documents to training shards: quality rules, near duplicates,
benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on,
columns unchanged; the last adds ``shard`` and ``slot``. The text moves once
per stage at most twice; all decisions are made on narrow rows.

Near duplicates are those of five-word shingles with a Jaccard similarity of
0.8 or more (the query of the join operator itself takes four and 0.85).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acrewise.llm import decontaminate, jaccard_join, mixture, quality, shards
from acrewise.llm.common import scratch, stored, table

NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.sample(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.interleave(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the
    shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, folder, f"stage{i}")
    return docs


ORACLE_SQL = f"""
WITH RECURSIVE {quality.sql_judge("documents")},
s1 AS (SELECT documents.* FROM documents JOIN judged USING (doc_id) WHERE kept),
{jaccard_join.sql_classes("s1", NEAR_WORDS, NEAR_PERCENT)},
s2 AS (SELECT s1.* FROM s1 JOIN j_classes USING (doc_id) WHERE doc_id = component_id),
{decontaminate.sql_leaks("s2")},
s3 AS (SELECT * FROM s2 WHERE doc_id NOT IN (SELECT doc_id FROM l_leaks)),
{mixture.sql_mix("s3")},
s4 AS (SELECT doc_id, text, lang, source, n_chars FROM m_mixed WHERE selected)
{shards.sql_interleave("s4")}"""
