"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing to target weights, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and gives a frame, which is written
as Parquet to the shared folder and reread as the next one's docs.  All but the last give the columns of
documents.  Every stage works on all rows its predecessor kept:

1. language: rows that the identifier rejects (`und`: null text, or no letter) go; a short text that several
   languages could have written is no reject;
2. toxicity: rows that score at least their language's threshold go;
3. near_duplicates: one row of each group linked at a similarity of 0.80 stays, one with the smallest id;
4. mixing: rows are repeated as often as the mix takes them, down to not at all;
5. bpe: ids of each row as little-endian 32-bit integers, their number, and the text they decode to.

Models are fitted on what a stage is given: the language model on its documents, the classifier on those with
labels.  A table without labelled documents has no toxic ones that could be told, and passes.  Null texts end
at the first stage; columns beside those of documents are dropped.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, langid, mixing, neardup, toxicity
from veilframe.llm.common import ASCII_SPACE, Scratch, table, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the trained stages; the tests hold each stage against a plain version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    return docs.where(langid.predictor(spark, model)(F.col("text"))["lang"] != langid.UNKNOWN).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages = langid.fit(docs, F.lit(True), docs_per_lang=500)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True), languages=languages)
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: its smallest id, of that the least text hash, of that the least row.

    Rows without an id or a word link with nothing and all stay.
    """
    found = neardup.near_duplicates(docs, percent=80).where("group is not null")
    winners = found.groupBy("group").agg(F.min(F.struct("doc_id", F.col("text_hash").alias("_h"))).alias("w")).select("w.*")
    own = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    loose = F.col("doc_id").isNull() | (F.trim(F.coalesce("text", F.lit("")), F.lit(ASCII_SPACE)) == "")
    one = own.where(~loose).join(winners, ["doc_id", "_h"]).groupBy("doc_id", "_h").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return one.unionByName(own.where(loose).drop("_h")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are mixed by a hash of the whole row, as ids may be null or stand for several texts.

    Equal rows share their copies, so one of them is repeated as often as all of them are due.
    """
    own = docs.select(*COLUMNS).withColumn("_r", F.xxhash64(*COLUMNS))
    mixed = mixing.mix(own, doc_id="_r", size=F.size(words(F.col("text"))))
    due = mixed.groupBy(F.col("doc_id").alias("_r")).agg(F.sum("copies").alias("_n")).where("_n > 0")
    one = own.join(due, "_r").groupBy("_r", "doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r"), F.first("_n").alias("_n"))
    return one.select("r.*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_k")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline-" + hashlib.sha1(sf_dir.encode()).hexdigest()[:8])
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
