"""Streams drained over the test tables, compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions.metrics import COUNTS
from quillon.session import _made, shared_dir, table
from quillon.streaming import incremental as S

from ._registry import PRED, cells, query


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d) if not _is_folder(spark, d, name) else spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet")


def _is_folder(spark, d, name) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _folder(spark) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@query(f"WITH {PRED} SELECT run_id, count(*) AS n, count(*) FILTER (NOT coalesce(is_success, false)) AS n_failed, {cells('coalesce(is_success, false)')} FROM pred GROUP BY run_id")
def xst_running_confusion(spark, d):
    out = S.drained(S.running_confusion(_stream(spark, d, "prediction_results"), ["run_id"]), _folder(spark), "update")
    last = F.max_by(F.struct("n", "n_failed", *COUNTS), "_epoch")
    return out.groupBy("run_id").agg(last.alias("x")).select("run_id", "x.*")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT window_start, event_type, n FROM w WHERE window_start + INTERVAL 1 DAY <= {_CLOSED}")
def xst_tumbling_usage(spark, d):
    """Daily counts of the windows that the watermark has closed."""
    out = S.drained(S.usage_windows(_stream(spark, d, "events"), "ts", ["event_type"], "value", "1 day"), _folder(spark))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"WITH e AS (SELECT ts, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS window_start FROM events) SELECT window_start, count(*) AS n FROM e GROUP BY 1 HAVING window_start + INTERVAL 1 DAY <= {_CLOSED}")
def xst_sliding_usage(spark, d):
    out = S.drained(S.usage_windows(_stream(spark, d, "events"), "ts", [], "value", "1 day", "12 hours"), _folder(spark))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}"""
)
def xst_sessions(spark, d):
    out = S.drained(S.sessions(_stream(spark, d, "events"), "ts", "user_id", "6 hours"), _folder(spark))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")
