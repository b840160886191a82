"""From documents to training ids: each stage works on all that the one before kept.

1. quality rules: documents that the rules reject go;
2. line dedup: common lines go, except in the largest doc_id that holds them;
3. near-dedup: one document of each class of near copies stays;
4. mixing: sources are repeated towards their temperature weights;
5. encoding: the ids of a sentencepiece model, with an end id.

Defined results: a document without words, null or empty, is rejected by the
first stage; rows that repeat a doc_id are one document to the second and third
stage, of which one row stays; a null doc_id is never a copy and stays; a null
source is a source; columns beyond those of documents are left out, whatever
their names; empty tables give an empty result.

All stages but the last return the columns of documents; a stage that changes
texts sets n_chars anew. Every stage's result is written to the shared folder
and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import line_dedup, mixing, near_dup, pieces, quality
from quadloom.llm.queries import PIECE_MODEL, tokenizer_file
from quadloom.llm.workspace import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_dups(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_file(PIECE_MODEL), end=True)
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL cannot encode with the model; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
