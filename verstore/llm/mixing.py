"""Operator 6, mixing sources to target weights by Pfair scheduling.

Each source is dealt in blocks of BLOCK documents.  With weight w, its k-th
block is released at slot floor((k-1)/w), due at slot ceil(k/w), and
earliest-deadline-first gives every slot to a released block: after any t
slots each source has had w*t blocks, off by less than one.

Weights are taken as exact fractions and never rounded, so the bound holds over
a whole phase.  The driver takes one step per block and keeps 8 bytes for each;
from BLOCK x BLOCKS rows on blocks grow with the table, so that these stay at
BLOCKS or so.  Sources are as few as fit there with a row each.  When a source
ends, the others' weights are scaled up and a new phase begins; so all rows are
scheduled, each once.

A row's number within its source comes from its hash (of all columns, so that
rows without an id are spread too): counted by (source, hash range), summed up
over ranges, then numbered within each range, so that a source with most of
all rows is never in one task.

Defined cases: a null source is a source of its own; null ids and repeated
rows are kept (equal rows in any order); weights default to each source's
share to the power TEMPERATURE; sources without weight get the smallest one;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import floor, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import common

#: Documents per block; slots per period of whole-slot weights; flattening of shares; rows per hash range; blocks per row of the schedule.
BLOCK, PERIOD, TEMPERATURE, RANGE_ROWS, CHUNK = 16, 1024, 0.5, 1024, 1024
#: Blocks of one schedule, at most (and one more per source): beyond BLOCK x BLOCKS rows blocks grow.
BLOCKS = 1 << 22


def quantised(weights: dict, period: int) -> dict:
    """Slots of each source in a period (at least 1), by largest remainders:
    whole-slot weights for a schedule that repeats (``schedule`` has exact ones)."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: max(Fraction(1), Fraction(w) / Fraction(total) * period) for s, w in weights.items()}
    scale = Fraction(period) / sum(exact.values())
    got = {s: max(1, floor(x * scale)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] * scale - got[s]), str(s)))
    gap, i = period - sum(got.values()), 0
    while gap:
        s = order[i % len(order)]
        if gap > 0 or got[s] > 1:
            got[s] += 1 if gap > 0 else -1
            gap += -1 if gap > 0 else 1
        i += 1
    return got


def dealt(weights: dict) -> Iterator:
    """The source of each slot, without end: EDF over released blocks, by whole
    numbers as weights."""
    total = sum(weights.values())
    release = lambda s, k: (k - 1) * total // weights[s]
    due = lambda s, k: -(-k * total // weights[s])
    waiting = [(0, due(s, 1), str(s), i, s, 1) for i, s in enumerate(weights)]
    heapq.heapify(waiting)
    ready: list = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, *rest = heapq.heappop(waiting)
            heapq.heappush(ready, tuple(rest))
        _, name, i, s, k = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, (release(s, k + 1), due(s, k + 1), name, i, s, k + 1))
        t += 1


def period_slots(counts: dict) -> list:
    """The source of each slot of one period of whole-slot weights."""
    return list(islice(dealt(counts), sum(counts.values())))


def whole(weights: dict) -> dict:
    """Whole numbers in exactly the weights' proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def block_slots(blocks: dict, weights: dict) -> dict:
    """The slot of each block of each source, phase after phase.

    A phase ends at the slot where a source has had its last block.
    """
    left = {s: n for s, n in blocks.items() if n}
    out = {s: array("q") for s in left}
    slot = 0
    while left:
        for s in dealt(whole({s: weights[s] for s in left})):
            out[s].append(slot)
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    return out


def schedule(docs: DataFrame, weights: dict | None = None, block: int | None = None, into: tuple[str, str, str] = ("block", "slot", "place")) -> DataFrame:
    """docs with block (in its source), slot and place in the slot, in columns
    that replace any of the same names."""
    docs = docs.drop(*into)
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}  # one row per source
    total = sum(sizes.values())
    block = block or max(BLOCK, -(-total // BLOCKS))
    if weights is None:
        weights = {s: (n / total) ** TEMPERATURE for s, n in sizes.items()}
    low = min([w for w in weights.values() if w > 0], default=1.0)
    weights = {s: weights.get(s) or low for s in sizes}
    plan = block_slots({s: -(-n // block) for s, n in sizes.items()}, weights)
    ranges = max(1, -(-max(sizes.values(), default=1) // RANGE_ROWS))
    # the row as one column, so that no name of it clashes; one key for the window and the join, so that whole rows move once
    hashed = ["doc_id", *(f.name for f in docs.schema.fields if f.name != "doc_id" and not isinstance(f.dataType, MapType))]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("h"), "source", F.col("doc_id").alias("id"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("k"))
    rows = rows.withColumn("r", F.pmod(F.shiftrightunsigned("h", 20), F.lit(ranges)))
    before = rows.groupBy("k", "r").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("k", "r", (F.sum("n").over(Window.partitionBy("k").orderBy("r")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("k", "r").orderBy("h", "id", *(f"row.{c}" for c in ("text",) if c in docs.columns))
    rows = rows.withColumn("i", F.row_number().over(inside) - 1).join(before, ["k", "r"]).withColumn("at", F.col("before") + F.col("i"))
    rows = rows.withColumn("blk", F.expr(f"at div {block}")).withColumn("plc", F.col("at") % block)
    parts = [(s, c, at[c * CHUNK : (c + 1) * CHUNK]) for s, at in plan.items() for c in range(-(-len(at) // CHUNK))]
    columns = [pa.array(x, t) for x, t in zip(zip(*parts) if parts else ([], [], []), (pa.string(), pa.int64(), pa.list_(pa.int64())))]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, names=["p_source", "p_chunk", "p_at"]))
    # 8 bytes per block of BLOCK rows
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("p_source")) & (F.expr(f"blk div {CHUNK}") == F.col("p_chunk")))
    slot = F.element_at("p_at", (F.col("blk") % CHUNK + 1).cast("int"))
    return rows.select("row.*", F.col("blk").alias(into[0]), slot.cast("bigint").alias(into[1]), F.col("plc").cast("int").alias(into[2]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(common.table(spark, sf_dir, "documents").select("doc_id", "source"))
