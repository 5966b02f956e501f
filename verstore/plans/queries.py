"""Registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts, maintenance, replication, resolve
from ..sources import changelog
from ..store import manifest
from . import scenarios

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LOG = "(SELECT printf('user-%08d', user_id) AS key, event_id + 1 AS commit_ts, CASE WHEN event_type <> 'error' THEN value END AS value, event_type, event_id FROM events)"
OPS = "(SELECT event_id // 5 AS tx, event_id // 5 + 1 AS cts, event_id // 5 - (event_id // 5) % 4 AS snap, event_id % 5 AS seq, printf('user-%08d', user_id) AS key, CASE WHEN event_type <> 'error' THEN value END AS value, event_type IN ('view', 'click') AS is_read FROM events)"


def _newest(where: str = "TRUE") -> str:
    return f"(SELECT * FROM (SELECT key, value, commit_ts, event_type, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS n FROM {LOG} WHERE {where}) WHERE n = 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return changelog.change_log(changelog.events(spark, sf_dir), *extra)


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.transactions(changelog.events(spark, sf_dir))


@query(f"SELECT key, value, commit_ts FROM {_newest()} WHERE value IS NOT NULL")
def snapshot_view(spark, sf_dir):
    return resolve.live(resolve.newest(_log(spark, sf_dir)))


@query(f"SELECT key, value, commit_ts FROM {_newest('commit_ts <= 5000')} WHERE value IS NOT NULL")
def as_of_view(spark, sf_dir):
    return resolve.live(resolve.as_of(_log(spark, sf_dir), 5000))


@query(f"SELECT key, value, commit_ts FROM {_newest()} WHERE key = 'user-00000007' AND value IS NOT NULL")
def point_get(spark, sf_dir):
    found = changelog.within(changelog.events(spark, sf_dir), "user-00000007", "user-00000008")
    return resolve.live(resolve.newest(changelog.change_log(found)))


@query(f"SELECT a.key AS key, n.key IS NOT NULL AS found, n.value AS value FROM (SELECT DISTINCT printf('user-%08d', c_custkey) AS key FROM customer) a LEFT JOIN (SELECT * FROM {_newest()} WHERE value IS NOT NULL) n ON a.key = n.key")
def multi_get(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(changelog.key_of("c_custkey").alias("key"))
    return resolve.multi_get(_log(spark, sf_dir), asked)


@query(f"SELECT key, value, commit_ts FROM {_newest()} WHERE value IS NOT NULL AND key >= 'user-00000010' AND key < 'user-00000050'")
def range_scan(spark, sf_dir):
    found = changelog.within(changelog.events(spark, sf_dir), "user-00000010", "user-00000050")
    return resolve.live(resolve.newest(changelog.change_log(found))).orderBy("key")


@query(f"SELECT key, commit_ts FROM {_newest()} WHERE value IS NULL")
def tombstones(spark, sf_dir):
    return resolve.newest(_log(spark, sf_dir)).where("value IS NULL").select("key", "commit_ts")


@query(f"SELECT key, max(commit_ts) AS commit_ts FROM {LOG} GROUP BY key")
def newest_ts(spark, sf_dir):
    return resolve.newest_ts(_log(spark, sf_dir))


@query(f"SELECT coalesce(max(tx), 0) AS tx_id FROM {OPS}")
def max_tx_id(spark, sf_dir):
    return maintenance.max_tx_id(_ops(spark, sf_dir))


@query(f"SELECT tx, key, value FROM (SELECT tx, key, value, row_number() OVER (PARTITION BY tx, key ORDER BY seq DESC) AS n FROM {OPS} WHERE NOT is_read) WHERE n = 1")
def batch_last_wins(spark, sf_dir):
    return resolve.last_write_wins(_ops(spark, sf_dir).where(~F.col("is_read")))


@query(f"SELECT key, commit_ts, value FROM (SELECT key, value, commit_ts, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, seq DESC) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY tx) AS commit_ts FROM {OPS} WHERE tx % 7 <> 3)) WHERE n = 1")
def wal_recovery(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return resolve.recovered(ops, ops.where("tx % 7 != 3").select("tx"))


@query("SELECT event_id FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE event_id % 4001 = 4000), 9223372036854775807)")
def valid_prefix(spark, sf_dir):
    frames = changelog.events(spark, sf_dir).select("event_id")
    return resolve.valid_prefix(frames, "event_id", F.col("event_id") % 4001 == 4000)


@query(f"SELECT DISTINCT a.tx AS tx, a.key AS key FROM {OPS} a JOIN {OPS} b ON a.key = b.key WHERE NOT a.is_read AND NOT b.is_read AND a.snap < b.cts AND b.cts < a.cts")
def write_conflicts(spark, sf_dir):
    return conflicts.write_conflicts(_ops(spark, sf_dir))


@query(f"SELECT DISTINCT a.tx AS tx, a.key AS key FROM {OPS} a JOIN {OPS} b ON a.key = b.key WHERE a.is_read AND NOT b.is_read AND a.snap < b.cts AND b.cts < a.cts AND NOT EXISTS (SELECT 1 FROM {OPS} w WHERE w.tx = a.tx AND w.key = a.key AND NOT w.is_read)")
def read_conflicts(spark, sf_dir):
    return conflicts.read_conflicts(_ops(spark, sf_dir))


@query(f"WITH r AS (SELECT tx, snap, min(key) AS low, max(key) AS high FROM {OPS} WHERE is_read GROUP BY tx, snap), w AS (SELECT DISTINCT tx, key, cts FROM {OPS} WHERE NOT is_read) SELECT r.tx AS tx, w.key AS key, max(w.cts) AS cts FROM r JOIN w ON w.cts > r.snap AND w.cts < r.tx + 1 AND w.key >= r.low AND w.key < r.high WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.tx = r.tx AND o.key = w.key) GROUP BY r.tx, w.key")
def phantom_conflicts(spark, sf_dir):
    return conflicts.phantom_conflicts(_ops(spark, sf_dir))


@query(f"WITH b AS (SELECT key, value FROM {_newest('commit_ts <= 5000')}), s AS (SELECT key, CASE WHEN event_type <> 'purchase' THEN value + 1 END AS value FROM {_newest('commit_ts > 9900')}) SELECT key, value FROM (SELECT coalesce(s.key, b.key) AS key, CASE WHEN s.key IS NOT NULL THEN s.value ELSE b.value END AS value FROM b FULL JOIN s ON b.key = s.key) WHERE value IS NOT NULL")
def own_writes_overlay(spark, sf_dir):
    log = _log(spark, sf_dir, "event_type")
    staged = resolve.newest(log.where("commit_ts > 9900"), "event_type").select("key", F.when(F.col("event_type") != "purchase", F.col("value") + 1).alias("value"))
    return resolve.live(resolve.overlay(resolve.as_of(log, 5000), staged))


@query(f"SELECT key, value, commit_ts FROM {_newest('commit_ts > 9000')}")
def delta_flush(spark, sf_dir):
    return maintenance.delta(_log(spark, sf_dir), 9000)


_STATS = f"(SELECT (commit_ts - 1) // {{}} AS segment, min(key) AS min_key, max(key) AS max_key, min(commit_ts) AS min_ts, max(commit_ts) AS max_ts, count(*) AS rows FROM {LOG} GROUP BY 1)"


@query("SELECT * FROM " + _STATS.format(1000))
def segment_stats(spark, sf_dir):
    return maintenance.segment_stats(_log(spark, sf_dir), 1000)


@query("SELECT * FROM " + _STATS.format(20) + " WHERE NOT (max_key < 'user-00000145' OR min_key > 'user-00000149')")
def segment_prune(spark, sf_dir):
    return maintenance.overlapping(maintenance.segment_stats(_log(spark, sf_dir), 20), "user-00000145", "user-00000149")


@query(f"SELECT key, value, commit_ts FROM {_newest('commit_ts <= 6000')}")
def compaction_merge(spark, sf_dir):
    log = _log(spark, sf_dir).where("commit_ts <= 6000")
    merged = resolve.newest(log.withColumn("segment", F.expr("commit_ts div 1000")).groupBy("segment", "key").agg(F.max_by(F.struct("value", "commit_ts"), "commit_ts").alias("v")).select("key", "v.*"))
    return merged


_CHECKPOINTS = "(SELECT count(DISTINCT (event_id) // 100) FROM events)"


@query(
    f"""WITH RECURSIVE apart(n, l0, l1, l2, l3, l4) AS (
        SELECT 0, 0, 0, 0, 0, 0 UNION ALL
        SELECT n + 1, CASE WHEN l0 = 4 THEN 0 ELSE l0 + 1 END, CASE WHEN l0 < 4 THEN l1 WHEN l1 = 1 THEN 0 ELSE l1 + 1 END,
            CASE WHEN l0 < 4 OR l1 < 1 THEN l2 WHEN l2 = 4 THEN 0 ELSE l2 + 1 END,
            CASE WHEN l0 < 4 OR l1 < 1 OR l2 < 4 THEN l3 WHEN l3 = 16 THEN 0 ELSE l3 + 1 END,
            CASE WHEN l0 < 4 OR l1 < 1 OR l2 < 4 OR l3 < 16 THEN l4 ELSE l4 + 1 END
        FROM apart WHERE n < {_CHECKPOINTS}),
    stacked(n, l0, l1) AS (SELECT 0, 0, 0 UNION ALL SELECT n + 1, CASE WHEN l0 = 4 THEN 0 ELSE l0 + 1 END, CASE WHEN l0 = 4 THEN 1 ELSE l1 END FROM stacked WHERE n < {_CHECKPOINTS}),
    counted AS (SELECT 'apart' AS keys, unnest([0, 1, 2, 3, 4]) AS level, unnest([l0, l1, l2, l3, l4]) AS segments FROM apart WHERE n = {_CHECKPOINTS}
        UNION ALL SELECT 'overlapping', unnest([0, 1]), unnest([l0, l1]) FROM stacked WHERE n = {_CHECKPOINTS})
    SELECT keys, CAST(level AS BIGINT) AS level, CAST(segments AS BIGINT) AS segments FROM counted WHERE segments > 0"""
)
def level_counts(spark, sf_dir):
    """Segments per level after a checkpoint per 100 commits, as the store's own
    planner lays them out: of ascending keys, and of keys that all overlap."""
    log = changelog.events(spark, sf_dir).select((F.col("event_id") + 1).alias("commit_ts"), F.format_string("event-%012d", "event_id").alias("key"))
    stats = maintenance.segment_stats(log, 100).orderBy("segment").collect()  # a row per checkpoint, as in a manifest
    out = []
    for keys in ("apart", "overlapping"):
        files: tuple = ()
        for r in stats:
            low, high = (r.min_key, r.max_key) if keys == "apart" else ("event", "event-z")
            files = manifest.settled((*files, manifest.File(f"{r.segment}", "seg", 0, r.rows, low.encode().hex(), high.encode().hex(), r.min_ts, r.max_ts)))
        counts = manifest.Manifest(files=files).level_counts()
        out += [(keys, level, n) for level, n in counts.items()]
    return spark.createDataFrame(out, "keys string, level bigint, segments bigint")


@query(f"SELECT key, count(*) AS removable FROM (SELECT key, lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts) AS a FROM {LOG}) WHERE a <= 7000 GROUP BY key")
def gc_removable(spark, sf_dir):
    return maintenance.gc_removable(_log(spark, sf_dir), 7000)


@query(f"SELECT key, value, commit_ts FROM {_newest('commit_ts <= 2500')}")
def pitr_restore(spark, sf_dir):
    return resolve.as_of(_log(spark, sf_dir), 2500)


_LEADER = f"(SELECT commit_ts AS index, event_id // 100 AS term, key, value FROM {LOG})"
_FOLLOWER = f"(SELECT commit_ts AS index, event_id // 100 + CASE WHEN commit_ts >= 7000 THEN 1 ELSE 0 END AS term, key, value FROM {LOG} WHERE commit_ts <= 9000)"
_AT = f"(SELECT min(l.index) FROM {_LEADER} l JOIN {_FOLLOWER} f ON l.index = f.index WHERE l.term <> f.term)"


def _logs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = _log(spark, sf_dir)
    leader = log.select(F.col("commit_ts").alias("index"), F.expr("(commit_ts - 1) div 100").alias("term"), "key", "value")
    follower = leader.where("index <= 9000").withColumn("term", F.col("term") + (F.col("index") >= 7000).cast("bigint"))
    return leader, follower


@query(f"SELECT {_AT} AS index")
def log_divergence(spark, sf_dir):
    leader, follower = _logs(spark, sf_dir)
    return replication.divergence(follower, leader)


@query(f"SELECT * FROM {_FOLLOWER} WHERE coalesce(index < {_AT}, TRUE) UNION ALL SELECT * FROM {_LEADER} WHERE index >= coalesce({_AT}, (SELECT max(index) + 1 FROM {_FOLLOWER}), 0)")
def log_ship(spark, sf_dir):
    leader, follower = _logs(spark, sf_dir)
    return replication.shipped(follower, leader)


@query("SELECT index, gap FROM (SELECT event_id + 1 AS index, event_id + 1 - lag(event_id + 1) OVER (ORDER BY event_id) AS gap FROM events WHERE event_type <> 'error') WHERE gap <> 1")
def log_contiguity(spark, sf_dir):
    return replication.gaps(changelog.events(spark, sf_dir).where("event_type != 'error'").select((F.col("event_id") + 1).alias("index")))


@query(f"SELECT index, term, key, value FROM {_LEADER} WHERE index >= 101 ORDER BY index LIMIT 50")
def append_request(spark, sf_dir):
    return replication.append_request(_logs(spark, sf_dir)[0], 101, 50)


_MATCH = f"(SELECT event_id // 1000 AS term, event_id % 5 AS peer, max(commit_ts) AS match FROM {LOG} WHERE value IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT term, match AS commit_index FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY match DESC) AS n FROM {_MATCH}) WHERE n = 3")
def commit_index(spark, sf_dir):
    live = _log(spark, sf_dir, "event_id").where("value IS NOT NULL")
    matches = live.groupBy(F.expr("event_id div 1000").alias("term"), (F.col("event_id") % 5).alias("peer")).agg(F.max("commit_ts").alias("match"))
    return replication.commit_index(matches, 5)


@query("SELECT c.peer AS candidate, v.peer AS voter, c.term > v.term OR (c.term = v.term AND c.index >= v.index) AS granted FROM (SELECT event_id % 5 AS peer, max(event_id // 100) AS term, max(event_id) AS index FROM events GROUP BY 1) c JOIN (SELECT event_id % 5 AS peer, max(event_id // 100) AS term, max(event_id) AS index FROM events GROUP BY 1) v ON c.peer <> v.peer")
def vote_freshness(spark, sf_dir):
    tips = changelog.events(spark, sf_dir).groupBy((F.col("event_id") % 5).alias("peer")).agg(F.max(F.expr("event_id div 100")).alias("term"), F.max("event_id").alias("index"))
    c, v = tips.alias("c"), tips.alias("v")  # one row per member
    fresh = F.struct("c.term", "c.index") >= F.struct("v.term", "v.index")
    return c.join(v, F.col("c.peer") != F.col("v.peer")).select(F.col("c.peer").alias("candidate"), F.col("v.peer").alias("voter"), fresh.alias("granted"))


#: CRC-32 of a list of bytes, by the table of its 256 remainders.
_TABLE = "(SELECT list(list_reduce(range(8), (c, k) -> CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) FROM range(256) t(i))"
_CRC = "xor(list_reduce(list_transform(range(1, length({0}) // 2 + 1), lambda i: CAST('0x' || substr({0}, CAST(2 * i - 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c // 256, crc_table[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


@query(
    f"""WITH t AS (SELECT {_TABLE.replace("(c, k) ->", "lambda c, k:")} AS crc_table),
    raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    cut AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2, 1), 1024)) AS "offset" FROM raw),
    parts AS (SELECT doc_id, "offset", substr(h, CAST(2 * "offset" + 1 AS INT), 2048) AS d FROM cut)
    SELECT doc_id, "offset", length(d) // 2 AS n, {_CRC.format("d")} AS crc32 FROM parts, t"""
)
def snapshot_chunks(spark, sf_dir):
    return replication.chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 1024)


@query(
    f"""WITH t AS (SELECT {_TABLE.replace("(c, k) ->", "lambda c, k:")} AS crc_table),
    entries AS (SELECT key, printf('%02X000000%02X000000', length(key), length(CAST(value AS VARCHAR))) || hex(encode(key)) || hex(encode(CAST(value AS VARCHAR))) AS h FROM {_newest()} WHERE value IS NOT NULL),
    state AS (SELECT coalesce(string_agg(h, '' ORDER BY key), '') AS d FROM entries)
    SELECT {_CRC.format("d")} AS crc32 FROM state, t"""
)
def state_hash(spark, sf_dir):
    state = resolve.live(resolve.newest(_log(spark, sf_dir))).select("key", F.col("value").cast("string").alias("value"))
    return spark.createDataFrame([(replication.state_hash(state),)], "crc32 bigint")


for _name, (_scenario, _sql) in scenarios.SCENARIOS.items():
    QUERIES[_name], ORACLE[_name] = _scenario, _sql
