"""A corpus, cleaned and stored as token ids, in five stages.

Each stage takes all the documents its predecessor kept and returns the columns of ``documents``; the
last one writes them as token ids and returns one row per stored document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import decontaminate, mixing, parity_join, quality, queries, token_store
from scorewright.scale import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL has the tokenizer of the last stage; the tests hold every stage against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: the documents that no rule rejects."""
    return quality.keep(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the smallest doc_id, once."""
    return parity_join.first_of_groups(docs.select(COLUMNS))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: the documents that hold no window of any item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_items(docs, items).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(found["doc_id"]) & (hashed["text_hash"] == found["text_hash"])
    return hashed.join(found, same, "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: every document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS, mixing.size_of(F.col("text")).alias("size")))
    times = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return mixed.where("repeats > 0").withColumn("_copy", times).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID / binary output."""
    return token_store.store(docs, queries.vocabulary(), end_id=queries.END_ID).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, every stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
