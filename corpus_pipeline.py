"""The corpus pipeline: five stages over ``documents``, each one operator.

Stages read what their predecessor wrote and return the columns of documents;
the last returns the encoding.

Defined cases: null and empty texts pass every stage and stand alone among near
copies; texts are worked on whole, however long; rows that repeat an id count
as documents of their own, as do rows without one, so exact and near copies
among them go too (a row with an id of its own stays before these); a null
source is a source; an empty table stays empty; further columns are kept up to
the last stage, whatever their names.
  Order of the mixing stage: rows are written in
schedule order, range by range, so that files by name and rows within them
follow the schedule; the last stage turns both into the column position.
"""

from __future__ import annotations

from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.llm import common, jaccard_join, mixing, secret_scan, sentence_pieces, toxicity

ORACLE_SQL = None  # trained models and a schedule: tested against brute force
#: Near copies: words per shingle, least common hundredths.
WORDS, PERCENT = 5, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; clean ones, and those
    without a word, all stay."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    score, rejected = common.fresh(docs, "_score", "_rejected")
    return toxicity.score(docs, model, (score, rejected)).where((F.col(rejected) == 0) | ~F.coalesce("text", F.lit("")).rlike(r"(?U)\w")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = common.stored(ids.where("doc_id IS NULL OR n > 1").select("doc_id"))
    if odd.isEmpty():
        return kept(docs)
    # rows without an id of their own get one beyond all others
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    (own,) = common.fresh(docs, "_own")
    same = docs["doc_id"].eqNullSafe(odd["doc_id"])
    plain = docs.join(odd, same, "left_anti")
    extra = docs.join(odd, same, "left_semi").withColumn(own, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id() + F.lit(last + 1))
    both = common.stored(plain.withColumn(own, F.col("doc_id")).unionByName(extra))
    return kept(both).withColumn("doc_id", F.col(own)).select(*docs.columns)


def kept(docs: DataFrame) -> DataFrame:
    """docs, whose ids are their own, without all but the first of a component."""
    others = jaccard_join.join(docs, WORDS, PERCENT).where("doc_id != component_id").select("doc_id")
    return jaccard_join.only(docs, common.stored(others), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks out every secret found (by asterisks: lengths stay)."""
    return secret_scan.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, ordered by their slot in the schedule."""
    block, slot, place = common.fresh(docs, "_block", "_slot", "_place")
    scheduled = mixing.schedule(docs, into=(block, slot, place))
    return scheduled.repartitionByRange(slot, place).sortWithinPartitions(slot, place).select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, as read from files, with position: each row's
    number over all files by name, which Spark numbers by range."""
    files = docs.groupBy(F.col("_metadata.file_name").alias("file")).count().orderBy("file").collect()  # one row per file
    before = dict(zip([f["file"] for f in files], accumulate((f["count"] for f in files), initial=0)))
    starts = docs.sparkSession.createDataFrame(list(before.items()), "file string, start bigint")
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(F.broadcast(starts), "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("position"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding (the best path's ids and the other paths' changes of them)
    and each document's position in the schedule."""
    return sentence_pieces.encode(placed(docs), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, keep=("position",))


STAGES = [("toxicity", toxic), ("jaccard_join", near_copies), ("secret_scan", secrets), ("mixing", mixed), ("sentence_pieces", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = common.stored(stage(spark, docs, sf_dir))
        common.discard(docs)
        docs = done
    return docs
