"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "12g", app: str = "stampline") -> SparkSession:
    """Session for tests and benches; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # Few small partitions already; merging them would leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def pinned(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared checkpoint folder, so later reads of it agree and
    a lost executor costs one re-read instead of the whole lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHIPPED = "_stampline_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # else imported from an archive that was sent already
        archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(archive))
    setattr(sc, _SHIPPED, True)
