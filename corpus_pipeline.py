"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

toxicity: documents whose score reaches 0.7 go.  line dedup: repeated and nearly repeated lines
are cut; a document that loses lines and has none but blank ones left goes.  n-gram Jaccard join: the document with the
smallest id of each group stays.  benchmark decontamination: contaminated documents go.
SentencePiece: every document left is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontamination, jaccard_join, line_dedup, sentencepiece_bpe
from feedloom.llm import toxicity as tox
from feedloom.llm.common import remainder, saved
from feedloom.llm.queries import TOXIC, piece_model, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rejected documents up to which their keys are broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` but those named by (doc_id, h) in `gone`; h is a hash of the text."""
    gone = saved(gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__h")), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where((remainder(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    model = tox.fitted(docs.select("doc_id", "text"), labels)
    return docs.where(tox.score(F.col("text"), model) < TOXIC).select(COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "rows")
    groups = saved(jaccard_join.joined(rows.select("__row", "text"), "__row").where("n_links > 0").select("__row", "component_id"), "groups")
    named = groups.join(rows.select("__row", F.struct("doc_id", F.xxhash64("text").alias("h"), "__row").alias("name")), "__row")
    # null ids come last, as they cannot be ordered among the others
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("name.doc_id").isNull().alias("none"), "name")).alias("first"))
    stay = saved(first.select(F.col("first.name.__row").alias("__row")), "stay")
    gone = saved(groups.select("__row").join(stay, "__row", "left_anti"), "later")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, "__row", "left_anti").select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = decontamination.contamination(keyed, read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id", "h")).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece_bpe.tokenized(docs.select(COLUMNS), piece_model())
    return out.select("doc_id", "lang", "source", "n_chars", "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL expresses neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
