"""Shared helpers: table access, shared-folder writes, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod 4 is this are held out of all training.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4 (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 4


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row is in the held-out fold; a null id counts as held out."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(True))


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with marks behind those that docs has (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Only where the session leaves that setting empty and is local (tests, one
    machine) is a temporary folder chosen, once per session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verstore-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/verstore-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage so
    that lost executors cost a re-read, not a recomputation."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing will read it again."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Splits a batch so that each piece has about most_bytes of text (one
    longer text stays whole), which bounds a Python worker's memory."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    slot = np.cumsum(size.astype(np.int64)) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
