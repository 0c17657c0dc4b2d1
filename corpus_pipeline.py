"""From documents to token ids: drop toxic ones and near-duplicates, mask secrets, mix sources, encode.

Every stage works on all rows its predecessor kept, is written as Parquet and
read again; all but the last return the columns of documents. Rows: as each
operator says for nulls, empty and repeated rows; an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import lattice, mixing, secrets, simhash, toxicity
from molframe.llm.registry import table, word_count
from molframe.plans.lineage import cut

#: Documents that score as much or more are dropped.
TOXIC = 0.7
MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    texts = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    trainable = toxicity.fold(F.col("doc_id")) != 1
    scored = toxicity.score_documents(texts, labels, "doc_id", "text", "toxic", trainable)
    return scored.filter(F.col("toxicity.score") < TOXIC).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    return simhash.keep_one(rows, "doc_id", "text").select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every value found is replaced in the text, except copied examples."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("doc"))
    found = secrets.scan_secrets(rows, "doc_id", "text", owner="source", repo="doc_id", keep=("doc",))
    masked = secrets.redact(F.col("doc.text"), F.col("owned"))
    return found.select(F.col("doc").withField("text", masked).alias("doc")).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    size = word_count(F.col("text")).alias("words")
    rows = docs.select("doc_id", "source", size, F.struct("*").alias("doc"))
    decided = mixing.fair_mix(rows, "doc_id", "source", "words").select(
        *[F.col(c).alias(f"_{c}") for c in mixing.KEYS], "copies"
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("words") == F.col("_size"))
    )
    taken = rows.join(decided.filter("copies > 0"), same)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids`` of every document."""
    pieces = lattice.read_pieces(public_tokenizers.path(MODEL))
    return lattice.encode(docs, "doc_id", "text", pieces).select("doc_id", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A fitted model and piece paths are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
