"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; between stages the documents are written
and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import mixing, perplexity, secrets, simhash, tiling
from tamis.llm.common import SPACE, WORD, free_name, read
from tamis.session import written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a number of their own, so that rows with equal or missing ids stay apart; and the number's name.

    Rows of a Parquet table have a place, file and row, that is the same in every scan. Other tables are numbered and written.
    """
    number = free_name(docs, "row_number")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(number, place), number
    except AnalysisException:  # not a scan of files
        return written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def _only(rows: DataFrame, number: str, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose number is in the one column of ``kept``."""
    return rows.join(kept.toDF(number), number, "left_semi").select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity band of their language reject go."""
    rows, number = _numbered(docs)
    judged = perplexity.judge(rows, read(spark, sf_dir, "labels"), row_column=number)
    return _only(rows, number, judged.where("kept").select("row"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest doc_id stays (the first row of it, if repeated)."""
    rows, number = _numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col(number).alias("number"))
    named = rows.select(order.alias("doc_id"), "text")
    first = simhash.near_duplicates(named).select(F.col("component_id.number")).distinct()
    return _only(rows, number, first, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    name = free_name(docs, "text_key")
    found = tiling.contaminated_keys(docs, read(spark, sf_dir, "benchmark")).toDF(name)
    return docs.withColumn(name, tiling.key(F.col("doc_id"), F.col("text"))).join(found, name, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, with its epoch and the words taken of it.

    Documents that the budget leaves out go. At the cut of a budget a document is taken in part: its first words_taken words.
    """
    rows, number = _numbered(docs)
    taken = mixing.mix(rows, id_column=number, key_column="doc_id").where("rounds > 0 or part > 0")
    times = F.concat(
        F.array_repeat(F.col("size"), F.col("rounds").cast("int")),
        F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")),
    )
    added, taken_words, cut = free_name(docs, "epoch"), free_name(docs, "words_taken"), free_name(docs, "cut")
    counted = taken.select(F.col("doc_id").alias(number), "size", F.posexplode(times).alias(added, taken_words)).withColumn(
        cut, F.col(taken_words) < F.col("size")
    ).drop("size")
    # Each word with the white space before it.
    words = F.regexp_extract_all("text", F.lit(f"(?:{SPACE})?{WORD}"), F.lit(0))
    first_words = F.array_join(F.slice(words, 1, F.col(taken_words).cast("int")), "")
    return rows.join(counted, number).withColumn("text", F.when(F.col(cut), first_words).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.col(cut), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns, added, taken_words)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("source_mix", source_mix),
]

#: Fingerprints, tilings, tokenizers and language models are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
