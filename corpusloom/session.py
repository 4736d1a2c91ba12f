"""Session and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 2000, 64 << 20


def build_session(app: str = "corpusloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches no larger than build_session's in a session that was built elsewhere. A batch of the default 10000
    rows lies several times in memory at once, in the JVM and in its Python worker."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        size = re.fullmatch(r"\d+", now or "")
        if not size or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a fresh local one where that is unset and all work
    is done by this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Deletes the files of a table that stash has returned and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def apart(df: DataFrame) -> DataFrame:
    """df for joins that sort and merge. Spark holds a table of files for as small as its compressed files, and sends one
    of a million short texts to the driver and to all executors; for tables that grow with the questions or files."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer splits than there are cores. Such a table is small (a split has 128 MB
    at most by default) and is dealt anew once; larger ones are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
