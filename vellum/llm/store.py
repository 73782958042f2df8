"""Where intermediate tables go, so that lost executors cost a re-read, not a re-run.

All that one application writes lies in one folder of the shared directory;
``clear`` removes it, when no DataFrame that reads from it is needed any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's ``spark.checkpoint.dir``.

    Where none is set, a temporary folder serves a local session; a cluster is an error.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.vellum.test.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.vellum.test.dir", named)
    return f"{named.rstrip('/')}/vellum-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """As ``written``, in buckets by ``key``, so that later joins on it need no shuffle; nothing stays in the catalog."""
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the files lie outside the warehouse and stay
    return table


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
