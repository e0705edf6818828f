"""Session factory and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster pass nothing but the application name: spark-submit gives the
    master, the memory and ``spark.checkpoint.dir``.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "corpusloom", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned."""
    for df in frames:
        spark = df.sparkSession
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if "/corpusloom/" in f:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Arrow batches for columns of whole texts: fewer rows and bytes than Spark's defaults, which are replaced only where they stand.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers, where the cluster hasn't installed it, and keep their batches small."""
    sc = spark.sparkContext
    for key, (default, ours) in TEXT_BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    if getattr(sc, "_corpusloom_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-src-"), "corpusloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("corpusloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._corpusloom_shipped = True
    return spark
