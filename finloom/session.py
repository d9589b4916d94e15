"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark removes the shuffle files of a query from all executors as soon as the query has ended.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "finloom") -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def working_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the session.

    Only a single-machine session may fall back to a folder of its own; on a
    cluster a machine-local folder would be lost together with its machine.
    """
    configured = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.sparkContext.getCheckpointDir()
    app_id = spark.sparkContext.applicationId
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        if app_id not in _local_roots:
            _local_roots[app_id] = tempfile.mkdtemp(prefix="run-finloom-")
        configured = _local_roots[app_id]
    return f"{configured.rstrip('/')}/finloom-{app_id}"


#: Input bytes that one partition of a shuffle stands for, and the most that one task reads of files and shuffles.
SHARE = 8 << 20
MOST_READ, MOST_SHUFFLED = 16 << 20, 16 << 20


def bound_tasks(spark: SparkSession, files: list[str]) -> None:
    """Cut reads and shuffles so finely that the share of one task stays the same while the files grow.

    The session's settings only become finer: more shuffle partitions, which
    adaptive execution joins where they are small, and smaller pieces of files.
    Input of less than a few MB changes nothing.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files).select("length")
    size = listed.groupBy().sum("length").first()[0] or 0
    wanted = size // SHARE
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    if size > MOST_READ:
        for key, most in (("spark.sql.files.maxPartitionBytes", MOST_READ), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", MOST_SHUFFLED)):
            spark.conf.set(key, min(most, _bytes(spark, key)))


def _bytes(spark: SparkSession, key: str) -> int:
    """A size setting in bytes."""
    text = spark.conf.get(key).strip().lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(text[:-1]) << units[text[-1]] if text[-1:] in units else int(text)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{working_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, fixes values that depend on the physical layout, and
    gives the optimiser true sizes, so it broadcasts a side only when its
    files are below the broadcast threshold. The shuffle files behind it go as
    soon as it is written, so those of a chain of stages do not add up.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    former = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if former is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, former)
    return spark.read.schema(df.schema).parquet(path)
