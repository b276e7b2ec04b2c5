"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, pieces, simhash, store, substring, toxicity
from tidewatch.llm.queries import learning, table
from tidewatch.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.3, by models of the labelled ones."""
    store.prepare(ship(spark))
    scored = toxicity.score(docs, learning(table(spark, sf_dir, "labels")))
    return scored.where("toxicity < 0.3").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that fingerprints link; rows without an id stay."""
    store.prepare(ship(spark))
    found = simhash.near_duplicates(docs)
    copies = found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word runs that an earlier one has; texts that lose nothing stay as they are."""
    store.prepare(ship(spark))
    left = substring.remove_repeats(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    store.prepare(ship(spark))
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, and whether they spell it again."""
    store.prepare(ship(spark))
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), spelled="decoded")
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return out.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), same.alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("piece_encoding", encode),
]

#: SQL cannot state the learned and sampled stages; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir))
    return docs
