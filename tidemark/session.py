"""Session and table helpers shared by operators, queries and tests."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots are labelled by their END and cover (end - step, end].
DAY_MS = 86_400_000


def get_spark(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def sound_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of equally partitioned inputs to be partitioned like them. With adaptive
    coalescing the inputs may be cut differently, and a grouping or window directly behind the union then
    sees parts of its groups. That shortcut is turned off for the session."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per session, unless PYTHONPATH has it: it is
    zipped and handed to Spark's own file distribution."""
    home = Path(__file__).resolve().parent
    known = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(home.parent) in known or getattr(sc, "_tidemark_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(at))
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; column pruning and filters reach the Parquet scan."""
    ship(spark)
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate results.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a session whose executors are
    threads of this machine gets a temporary folder, which is removed when the process ends; any other
    is refused, since its executors could not share one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TIDEMARK_CHECKPOINT_DIR") or getattr(sc, "_tidemark_folder", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-cp-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc._tidemark_folder = at
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there."""
    spark = df.sparkSession
    at = checkpoint_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as a table of its own to the shared checkpoint folder, and read from there: unlike that
    of cut(), it is compressed, and later readers read only the columns and rows that they need."""
    at = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def slot_end(ms, step_ms):
    """End-inclusive slot of an epoch-millisecond column: ((ms - 1) div step + 1) * step.

    `div` truncates toward zero, so it is written with pmod, which also floors instants before 1970.
    """
    m, step = _col(ms) - F.lit(1).cast("bigint"), _col(step_ms)
    return m - F.pmod(m, step) + step


def _col(x):
    return F.col(x) if isinstance(x, str) else (x if hasattr(x, "cast") else F.lit(x).cast("bigint"))


def finite(c):
    """True for values that are neither null nor NaN nor infinite (never null itself)."""
    c = F.col(c) if isinstance(c, str) else c
    inf = F.lit(float("inf"))
    return c.isNotNull() & ~F.isnan(c) & (c != inf) & (c != -inf)


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted now), else df as it is, for a
    shuffled join. For narrow rows only: the bound on its size is max_rows times the row width."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
