"""A filtering and packing pipeline over ``documents``, one corpus operator a stage.

Every stage but the last returns the columns of ``documents``; a stage works on all rows that the one before it kept, read again from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontam, linededup, packing, simhash, toxicity
from larder.llm.queries import PACKING, TOKENIZER, read
from larder.llm.staging import remove, scope, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.5; learnt from the labelled ones among them that aren't held out."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of two or more lines, and of single lines of 50 words or more, go from the texts; ``n_chars`` follows the text.

    A document goes only if nothing of its text is left; what is left of any other stays, and near copies are the next stage's.
    """
    return linededup.without_repeats(docs, length_col="n_chars", run=2, alone=50)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), limit=2048, end_id=0, **PACKING)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: The learnt classifier can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for k, (name, step) in enumerate(STAGES):
        with scope() as staged:
            docs = step(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stage(docs, name.replace(" ", "-"))
        if k < len(STAGES) - 1:
            # This stage's documents are written: its intermediate tables and the documents it read are no longer needed.
            remove(spark, before + staged[:-1])
            before = staged[-1:]
    return docs
