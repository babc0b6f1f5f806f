"""The thin queries opN_<name>: each applies its operator, with production parameters,
to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, fingerprint, langid, lexical_search, mixing, ngram_jaccard, packing, piece_codec, resampling, secrets, topk_search, url_filter, warc_revisit
from .common import documents, id_remainder


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(documents(spark, sf_dir), words=4, num=85, den=100)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_revisit.records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    headers = F.expr("array_join(transform(array_sort(map_entries(headers)), e -> concat(e.key, '=', e.value)), ';')")
    return warc_revisit.resolve_revisits(records).withColumn("headers", headers)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("source")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = id_remainder("doc_id", 4)
    return langid.identify_split(documents(spark, sf_dir), rest != 2, F.coalesce(rest == 2, F.lit(False)))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = id_remainder("doc_id", 10)
    return context_mixing.score_split(documents(spark, sf_dir), rest != 0, F.coalesce(rest == 0, F.lit(False)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.rank_documents(documents(spark, sf_dir), items, k=50)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.digest_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_jaccard, op3_warc_revisits, op4_packing, op5_exact_top_k, op6_mixing, op7_fingerprints,
        op8_language_id, op9_context_mixing, op10_secrets, op11_lexical_search, op12_sentencepiece, op13_resampling,
    )
}
