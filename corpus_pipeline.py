"""Corpus pipeline: quality classifier, near duplicates, decontamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; ``run`` writes each result as Parquet in the shared folder
and reads it again as the next stage's ``docs``.  Rows that a stage drops are
named by doc_id (null-safe) and a hash of the whole row, so that a decision
holds for rows without an id and not for others that share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow.llm import jaccard_join, pii, quality_cotrain
from visiflow.llm import queries as llm
from visiflow.llm.common import read, row_key, write_table


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", row_key(docs))


def _without(keyed: DataFrame, decisions: DataFrame, dropped) -> DataFrame:
    """The rows of ``keyed`` (doc_id, _key) without a decision ``dropped``."""
    gone = write_table(decisions.filter(dropped).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of")).distinct(), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of"))
    return keyed.join(gone.hint("merge"), same, "left_anti").drop("_key")      # both sides grow with the corpus


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    keyed = _keyed(docs)
    return _without(keyed, quality_cotrain.score_quality(keyed, read(spark, sf_dir, "labels"), also=("_key",)), ~F.col("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, once (one without an id only if none has one).

    Rows without words are no near duplicates: those that share an id and the text stay once, those without an id all stay.
    """
    keyed = _keyed(docs)
    rows = jaccard_join.jaccard_groups(keyed, with_first=("_key",)).filter("first is not null")
    alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    left = _without(keyed.filter(~alone), rows.groupBy("doc_id", "_key").agg(F.max("first").alias("stays")), ~F.col("stays"))
    once = left.withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).drop("_same")
    return once.unionByName(docs.filter(alone))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    keyed = _keyed(docs)
    return _without(keyed, llm.contamination(keyed, read(spark, sf_dir, "benchmark"), key="_key"), F.col("contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars is that of the new text."""
    done = pii.redact(pii.find_pii(docs, out="_pii"), spans="_pii").drop("_pii")
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, as counts and digests."""
    return llm.bpe_digests(docs)


STAGES = [("quality_classifier", classify_quality), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("personal_data", redact_personal_data), ("byte_bpe", encode_tokens)]

#: The stages learn a classifier and iterate over links; SQL cannot express that (brute-force tests instead).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = write_table(out, f"stage{k}-{name}") if k + 1 < len(STAGES) else out
    return docs
