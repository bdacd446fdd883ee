"""Session helpers: table loading, lineage cutting and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this.
BROADCAST_LIMIT_BYTES = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_modules(spark: SparkSession) -> None:
    """Give the workers these modules, so that a cluster needs no installation of them. Done once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandframe_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandframe-")) / "strandframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._strandframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the shared one the session names in ``spark.checkpoint.dir``. Only where nothing is set and all runs on one
    machine (tests) a temporary folder is used; on a cluster that is an error, as executors would not share it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "strandframe-checkpoints"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, text_columns: list[str], limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size of ``df`` allows it.

    The size is counted (rows and characters of ``text_columns``); above ``limit`` the frame is
    returned unhinted and the join is planned as a shuffle join, with AQE splitting hot keys.
    """
    chars = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if size + 64 * n <= limit else df
