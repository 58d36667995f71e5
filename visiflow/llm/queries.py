"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow.llm import (bpe, collocations, decontam, jaccard_join, langid, licenses, pii, quality_cotrain, quality_rules, spelling,
                          substring_dedup, token_files, warc)
from visiflow.llm import oracles
from visiflow.llm.common import read
from visiflow.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def register(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle.strip()
        return fn
    return add


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text, decoded again; the digests of both."""
    ids = bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, RANKS).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text of documents, and the way back."""
    return bpe_digests(read(spark, sf_dir, "documents"))


@register(oracles.QUALITY_RULES)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition and symbol counts, divergence from the language references, and the verdict."""
    rows = quality_rules.judge(read(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


@register(oracles.PII)
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents: base spans by kind, and all spans of the method."""
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s.base)
    count = lambda kind: F.size(F.filter("pii", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k.name) for k in pii.KINDS if k.base),
                        F.sha2(pii.spans_text(base).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, key: str | None = None) -> DataFrame:
    """One row per document: words hit, items found, verdict; and the column ``key``, if one is named."""
    found = decontam.find_contamination(docs, items, key=key)
    ids = F.sort_array(F.array_distinct(F.transform(F.filter("matches", lambda m: m.item_id.isNotNull()), lambda m: m.item_id.cast("string"))))
    hit = decontam.hit_words(F.col("matches")).cast("long")
    return found.select("doc_id", *([key] if key else []), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near"))


@register(oracles.DECONTAMINATION)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against benchmark: exact matches of ten-word windows, and items only found in proximity."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register(oracles.WARC)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as monolithic gzip archives, normalised to one member per record, read back by the sidecar index."""
    folder = shared_path(spark, f"llm/warc-{uuid.uuid4().hex}")
    warc.write_monolithic(warc.with_revisits(read(spark, sf_dir, "pages")), f"{folder}/whole")
    manifest = warc.normalise(spark, f"{folder}/whole", f"{folder}/members")
    return warc.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register()
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    model = langid.fit_languages(docs.filter(~F.col("held_out")))
    return langid.predict_languages(docs, model, keep=("doc_id", "held_out"))


@register(oracles.SUBSTRING)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word covered by a window of 20 words that also starts earlier goes."""
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register()
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate group and its number of links (five-word shingles, 0.8)."""
    return jaccard_join.jaccard_groups(read(spark, sf_dir, "documents"))


@register()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the license templates that its whole text contains."""
    found = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                        F.array_join(F.transform("licenses", lambda x: x.license), ",").alias("licenses"),
                        F.array_max(F.transform("licenses", lambda x: x.containment)).alias("best_containment"))


@register()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels by co-training, and whether it is kept."""
    return quality_cotrain.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register(oracles.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of every language of documents."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


@register(oracles.SPELLING)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with its number of near words, its form and its root."""
    forms = spelling.spelling_forms(spelling.vocabulary(read(spark, sf_dir, "documents")))
    return forms.select("word", "n", "n_near", "form", "form_n", "root")


@register()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as token ids in flat files, read back: where it starts, its length and checksum."""
    folder = shared_path(spark, f"llm/tokens-{uuid.uuid4().hex}")
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), TOKENIZER, folder, end_id=1)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
