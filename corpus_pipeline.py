"""Documents to packed token sequences in four stages; each works on what the one before it kept.

Language identification drops documents in no language, near-duplicate removal keeps one document of each group,
decontamination drops documents that hold benchmark passages, and packing cuts what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, language, packing, simhash
from lodestone.llm.queries import tokenizer_path
from lodestone.session import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), keep_ids=False)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: No SQL: language identification, fingerprints and token ids can't be expressed. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
