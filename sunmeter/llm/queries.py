"""The operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmeter.llm import (
    bpe, chunked_bpe, embeddings, fill_middle, html_text, licenses, line_dedup, mixing, oracles,
    quality, secrets, simhash, spelling, toxicity,
)
from sunmeter.llm.common import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers lie; read by the driver only."""
    return importlib.import_module("public_tokenizers").path(name)


def vocabulary_pattern() -> str:
    """The pattern by which the public tokenizers cut a text into pieces."""
    return importlib.import_module("public_tokenizers").PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is 1 where a license's own wording was accepted, 0.5 for a base phrase only."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(
            F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: ~m["base"]), 1.0)
        .when(F.size("matches") > 0, 0.5).otherwise(0.0).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"), report="removed")
    lines = F.aggregate("removed", F.lit(0).cast("long"), lambda n, part: n + part["lines"])
    return rows.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed_chunks"),
        lines.alias("n_removed_lines"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = quality.apply_policy(rows).withColumn("base_failed", quality.fails("base"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_bits")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "n_blocks")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    plain = F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.joined_text(base), 256).alias("base_sha256"),
        secrets.joined_text(secrets.ordered(F.concat(plain, "live_spans"))).alias("spans"),
        F.size("live_spans").cast("long").alias("n_live"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(vocabulary_path())
    rows = bpe.encode(table(spark, sf_dir, "documents"), vocabulary)
    return rows.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.transform(table(spark, sf_dir, "documents"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"))


def thinned(runs: DataFrame, one_in: int = 31) -> DataFrame:
    """``runs`` (id, word) as a careless writer has them: of one word in so many a letter is missing.

    Which word and which letter follow from the checksum of id and word; a null id is empty.
    """
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    rows = runs.select("word", F.crc32(name).alias("sum"), F.length("word").alias("chars"))
    place = (F.col("sum") % F.col("chars")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), place),
                    F.substring("word", place + 2, F.col("chars")))
    return rows.select(
        F.when(F.col("sum") % one_in == 0, less).otherwise(F.col("word")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    runs = runs.filter(F.length("word") >= spelling.LEAST_CHARS)  # no word gets longer
    return spelling.variants(spelling.count_words(thinned(runs)))


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = chunked_bpe.load_vocabulary(
        vocabulary_path("byte_bpe_multi_50k.tiktoken"), vocabulary_pattern())
    rows = chunked_bpe.encode(table(spark, sf_dir, "documents"), vocabulary)
    return rows.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {query.__name__: query for query in (
    op1_license_scan, op2_toxicity, op3_line_dedup, op4_quality_rules, op5_simhash_groups,
    op6_html_text, op7_source_mix, op8_secret_scan, op9_bpe_codec, op10_embedding_groups,
    op11_fill_middle, op12_spelling_variants, op13_chunked_bpe,
)}
ORACLES = oracles.ORACLES
