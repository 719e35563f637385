"""Session helpers: defaults for local runs and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_CLEANED: set[str] = set()


def local_session(cores: int | str = "*", app: str = "memlake", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset in a local session (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_DIRS[app] = f"file://{path}"
    return _LOCAL_DIRS[app]


def written_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder, which is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/memlake-{app}"
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the context may be gone already
        pass


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for costly maps over a scan of fewer parts; a scan of a large table stays as it is."""
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores // 2 else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor. Column pruning
    and filters still reach the table, since it is Parquet.
    """
    spark = df.sparkSession
    path = written_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
