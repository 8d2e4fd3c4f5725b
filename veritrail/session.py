"""Session settings and the shared folder that holds cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    # call-site capture makes every Column call slow where plans are built in loops
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "veritrail", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session; keyword settings override the defaults.

    No shuffle partition count is fixed here: on a cluster it comes from the
    submit settings and AQE merges what is too small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, whichever threads ask.

    Does what ``--py-files`` does, for sessions started without it.
    """
    sc = spark.sparkContext
    with _shipping:
        if _shipped.get(sc.applicationId):
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="veritrail-code-")) / "veritrail.zip"
        with zipfile.ZipFile(target, "w") as bundle:
            for source in sorted(root.rglob("*.py")):
                bundle.write(source, source.relative_to(root.parent).as_posix())
        sc.addPyFile(str(target))
        _shipped[sc.applicationId] = True


_shipped: dict[str, bool] = {}
_shipping = threading.Lock()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than there are cores.

    For heavy work per row on a small input; a large one is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode with the setting unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="veritrail-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/veritrail/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, name: str, *partition_by: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Preferred to a checkpoint where later reads want few columns or few
    partitions, since both are pruned at the scan.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table of this library's scratch folder; other paths are refused."""
    if not path.startswith(f"{shared_dir(spark)}/veritrail/"):
        raise ValueError(f"{path} is not a scratch table")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
