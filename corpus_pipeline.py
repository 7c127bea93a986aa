"""A corpus pipeline: from raw documents to packed training sequences, by five of the operators in lumenfold.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Between stages the
documents are written as Parquet to the shared folder and read again.

1. toxicity: learns from the labelled rows that aren't held out; documents it predicts to be toxic go.
2. quality: the weak-label model of this stage's own documents; documents it rejects go.
3. near_duplicates: one document of each class of copies and near copies stays.
4. secrets: found secrets are replaced by a mark in the text; n_chars follows. No document goes.
5. packing: pieces of token sequences, for every document that is left.

What a stage makes of odd input is what its operator's docstring says. In short: null and empty texts pass the first
stage, go in the second (they hold nothing to train on) and would else be copies of each other and be packed as an
end id alone; repeated rows and null ids are documents like others, of which the third stage keeps one of each class,
of equal ids the one of the lesser hash; very long texts are worked on whole; an empty table gives an empty one;
columns beside those of documents pass through the first four stages, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import ship
from lumenfold.llm import jaccard, packing, quality, secrets, toxicity
from lumenfold.llm.common import drop_written, table, unused, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    score, toxic = unused(docs, "score", "toxic")
    scored = toxicity.score(docs, model, keep_columns=tuple(docs.columns), names=(score, toxic))
    return scored.where(F.col(toxic) == 0).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    score, keep = unused(docs, "score", "keep")
    scored = quality.score(docs, quality.train(docs), keep_columns=tuple(docs.columns), names=(score, keep))
    return scored.where(F.col(keep)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.survivors(docs).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained models nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_written(last)  # so that the shared folder holds two stages at most
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
