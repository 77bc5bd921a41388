"""Session settings, size limits and shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Widest matrix whose n x n factor is built whole (one R is then at most 128 MB).
MAX_DIRECT_COLS = 4000
# Most doubles (128 MiB) in a matrix that is broadcast or brought to the driver.
MAX_LOCAL_ELEMS = 1 << 24
# A lookup table of up to this many ids (16 bytes each) is broadcast.
MAX_BROADCAST_ROWS = 1_000_000
# Rows of a partial matrix are cut so that one shuffled record stays near 1 MiB.
PART_ELEMS = 1 << 17

_local_dirs: dict[str, str] = {}


def local_session(cpus: int | str = "*", memory: str = "20g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallmat")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallmat-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_shared_dir(spark).rstrip('/')}/tallmat/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from the written copy."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def is_kept(df: DataFrame) -> bool:
    level = df.storageLevel
    return level.useMemory or level.useDisk


def keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)
