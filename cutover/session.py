"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str] = {}
_OWNER: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged", default=None)

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where the next aggregate then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "cutover", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the cluster's own setting, else a local one.

    A machine-local folder is only ever used when the master itself is local,
    since executors of a cluster could not read it.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="cutover-")
    return _LOCAL_FOLDERS[app]


def owned_folder(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder.

    It belongs to the innermost ``staged`` block, or else stays in the application's folder.
    """
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    owner = _OWNER.get()
    if owner is not None:
        owner.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Rows keep the values they had when written, so partition ids and generated
    positions stay fixed when an executor is lost later on.
    """
    spark = df.sparkSession
    path = owned_folder(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staged(spark: SparkSession):
    """Own the tables that operators stage inside the block, and delete them at its end.

    Results are lazy and read staged tables when they run, so write or collect
    them inside the block.  Blocks nest; each deletes its own tables.
    """
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
