"""The corpus pipeline: five stages over ``documents``, each writing what it keeps.

1. toxicity: documents that the classifier rejects go;
2. near duplicates: one document of each component of similar ones stays;
3. benchmark decontamination: documents with a verified overlap go;
4. mixing: rows are repeated or left out so that sources meet their targets;
5. token ids: the mix is encoded and written, and read back per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import decontamination, jaccard, mixing, tokenids, toxicity
from orderlens.llm.common import scratch, table
from orderlens.operators.settle import release, stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.read(tokenids.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("token ids", token_ids),
]

# The toxicity model and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and reread.

    What a stage staged on its way, and the result it started from, is deleted once its own
    result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, function in STAGES:
        with scratch():
            docs = stage(function(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
