"""Session building and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def build_session(app: str = "quillon", master: str | None = None, shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; ANSI mode stays on."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master gets one of its own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.path.join(tempfile.gettempdir(), "quillon-shared")
    os.makedirs(at, exist_ok=True)
    return at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.parquet(path)


@atexit.register
def _drop_made() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone
            pass


def only_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], most_bytes: int = 48 << 20) -> DataFrame:
    """``rows`` whose ``key`` is among the distinct ``ids``: by a broadcast if these take at most ``most_bytes``, counted first, else by a shuffled semi-join."""
    ids = ids.select(*([key] if isinstance(key, str) else key)).distinct()
    each = 16 + sum(32 if t == "string" else 8 for _, t in ids.dtypes)  # a row as it is sent; strings here are names of tables
    bound = most_bytes // each
    if ids.limit(bound + 1).count() <= bound:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")


def if_small(df: DataFrame, bound: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``bound`` rows, counted first; else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    if getattr(sc, "_quillon_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    at = Path(tempfile.mkdtemp()) / "quillon.zip"  # on the driver alone: Spark serves it to the executors
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(at))
    sc._quillon_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
