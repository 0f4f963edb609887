"""The registered queries of this package: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import archives, centroids, domtext, exact, licenses, mixing, perplexity, ranked, repeats, secrets, simhash, statements, tiling, urlrules
from tamis.llm.common import read


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(read(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_licenses", "containment")


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(read(spark, folder, "documents"))
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(told(F.filter("secrets", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"),
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = tiling.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "coverage")


def op6_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(read(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("has_repeats"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
    )


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = perplexity.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"
    )


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = urlrules.judge(read(spark, folder, "pages"), read(spark, folder, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return domtext.extract(read(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    records = archives.read_archives(archives.write_archives(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    found = ranked.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.withColumnRenamed("query_id", "item_id")


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.classes(read(spark, folder, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(read(spark, folder, "embeddings")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    build.__name__: build
    for build in (
        op1_license_scan, op2_source_mix, op3_simhash, op4_secrets, op5_decontamination, op6_repeated_strings,
        op7_quality_rules, op8_url_rules, op9_main_text, op10_archives, op11_ranked_search, op12_exact_dedup, op13_centroids, pipeline,
    )
}

STATEMENTS: dict[str, str] = {
    "op1_license_scan": statements.LICENSES, "op2_source_mix": statements.MIX, "op10_archives": statements.ARCHIVES,
    "op11_ranked_search": statements.RANKED, "op12_exact_dedup": statements.EXACT, "op13_centroids": statements.CENTROIDS,
}
