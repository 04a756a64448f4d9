"""Session helpers shared by all subpackages."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W


def build_session(master: str = "local[*]", app: str = "kindred", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; extra settings as ``spark_sql_x=...`` are not needed: pass a dict."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (tests)."""
    set_one = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_one:
        return set_one
    jsc = spark.sparkContext._jsc.sc()
    have = jsc.getCheckpointDir()
    if have.isDefined():
        return have.get()
    own = tempfile.mkdtemp(prefix="kindred-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage; survives the loss of executors."""
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``row``, their place from 1 in ``order``, which must be total: ranges are numbered each in its own task, then moved by the rows before them."""
    ranges = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("row", inside).join(F.broadcast(before), "__range").withColumn("row", F.col("row") + F.col("__before")).drop("__range", "__before")


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing will read again."""
    for table in tables:
        file = table._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete_path(table.sparkSession, file.get())


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to any more: it does so once they are collected, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder for a written table or binary files."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, through the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python functions run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_kindred_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kindred-code-")) / "kindred.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._kindred_shipped = True
