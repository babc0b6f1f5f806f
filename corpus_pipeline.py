"""A corpus pipeline: language ID, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, mixing, ngram_jaccard, packing, secrets
from gridloom.llm.common import discard, materialize, sized, with_row_keys

#: Packing tokenizes and mixing samples; SQL can't express the stages.
ORACLE_SQL = None


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: ``und`` (null, no letters) and ambiguous ones go.

    Repeated rows and ties are judged alike, texts whole; null languages aren't learned,
    with nothing learned all go; an empty table stays empty; further columns stay as they
    are, whatever their names.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five words, similarity 0.8): that of the smallest id,
    null ids last, of equal ids the first row.

    Rows are told apart by keys of their own, as ids may be null or repeat: different
    texts under one id are different documents. Null, empty and wordless texts are in no
    group and stay; texts are compared whole; an empty table stays empty; further columns
    stay as they are, whatever their names.
    """
    keyed, key = with_row_keys(docs, "near-copies-rows")
    found = ngram_jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"))
    found = materialize(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "near-copies")
    groups = materialize(found.groupBy("component").count().filter("count > 1").select("component"), "near-copies-groups")
    grouped = materialize(found.join(sized(groups), "component"), "near-copies-grouped")
    ids = keyed.select(F.col(key).alias("row"), "doc_id")
    grouped = materialize(ids.join(sized(grouped), "row"), "near-copies-ids")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = grouped.groupBy("component").agg(F.min_by("row", order).alias("row")).select("row")
    gone = materialize(grouped.join(kept, "row", "left_anti").select(F.col("row").alias(key)), "near-copies-gone")
    discard(found, groups)
    return keyed.join(sized(gone), key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts give way to their kind in brackets.

    Null texts stay null; texts are scanned whole, repeated rows alike; an empty table
    stays empty; further columns stay as they are, whatever their names.
    """
    return secrets.redact_documents(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the mix takes them: sources near their target weights.

    A row for each copy, and one with the first words where a part is taken. Documents
    without words stay out, since the mix takes none of theirs. Rows are told apart by
    keys of their own; a null source is a source; ties are broken by the key; an empty
    table stays empty; further columns stay as they are, whatever their names.
    """
    keyed, key = with_row_keys(docs, "mix-rows")
    return mixing.apply_mix(keyed, mixing.mix_sources(keyed, key=key), key).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, every window at the mixture's proportions.

    Null texts give their end token; repeated rows are packed each by itself; a null id
    stays null; long texts are cut; further columns are ignored; an empty table gives no
    rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_to_weights),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again. A stage's table goes
    once the next one stands; the last stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(docs)
        docs = made
    return docs

