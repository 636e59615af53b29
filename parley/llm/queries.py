"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.collocations import collocations
from parley.llm.exact_dedup import exact_dedup, normal_form
from parley.llm.langid import TrainingOptions, predict_languages, trained_network, training_windows
from parley.llm.line_dedup import drop_shared_lines
from parley.llm.lm import lm_scores
from parley.llm.mixing import mix_plan
from parley.llm.ngram_join import ngram_components
from parley.llm.packing import pack_documents
from parley.llm.passages import repeated_passages
from parley.llm.quality import quality_rules
from parley.llm.token_files import read_documents, write_token_files
from parley.llm.urls import url_host, url_verdicts
from parley.llm.vector_codes import codebooks_digest, vector_codes, with_label_errors
from parley.plans.tables import table


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"))
    return found.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_token_files(table(spark, sf_dir, "documents"), tokenizer()))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a time of fetching in January 2024, which the table lacks: it follows from the URL."""
    pages = spark.read.schema("page_id bigint, url string").parquet(f"{sf_dir}/pages.parquet")
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + _number(F.col("url")) % 2_592_000))


def _number(text):
    """A number below 16^6 that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("bigint")


def _list_changes(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: some domains and some paths come, go and come back."""
    hosts = pages.select(url_host(F.col("url")).alias("host")).filter("host is not null").distinct()
    number = _number(F.col("host"))
    day = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)
    changes = F.array(
        F.struct(F.lit("add").alias("action"), day(number % 10).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(10 + number % 7).alias("at")),
        F.struct(F.lit("add").alias("action"), day(20 + number % 9).alias("at")),
    )
    kind = F.when(number % 3 == 0, "domain").when(number % 3 == 1, "prefix")
    # A domain entry covers the last three labels, as in spam-farm.example.org.
    pattern = F.when(number % 3 == 0, F.substring_index("host", ".", -3)).otherwise(F.concat("host", F.lit("/en")))
    entries = hosts.filter(kind.isNotNull()).select(kind.alias("kind"), pattern.alias("pattern"), F.explode(changes).alias("c"))
    return entries.select("kind", "pattern", "c.action", "c.at").distinct()


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return url_verdicts(pages, _list_changes(pages))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", normal_form(F.col("text")).alias("text"))
    docs = docs.withColumn("text_sha256", F.sha2("text", 256))
    found = exact_dedup(docs, key=F.col("text"), keep=("doc_id", "text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("cut")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    options = TrainingOptions()
    learned = docs.filter(~F.coalesce(held_out, F.lit(False)))
    windows = training_windows(learned, options, F.col("text"), F.col("lang"), F.col("doc_id"))
    network = trained_network(windows, options)
    asked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return predict_languages(asked, network, ("doc_id", "held_out"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mix_plan(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{sf_dir}/embeddings.parquet")
    found = vector_codes(vectors)
    codes = with_label_errors(found.codes).select("vec_id", "code", "error", "label_error")
    return codes.withColumn("codebooks_sha256", F.lit(codebooks_digest(found.codebooks)))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_shared_lines(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
