"""Tables in the shared folder: intermediate results, and versioned warehouse tables with a manifest."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores: small rows with much work each, which adaptive execution would put into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """Changes with the names, sizes and modification times of the files at ``paths`` or in these folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    said = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        said += [jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.globStatus(jvm.org.apache.hadoop.fs.Path(x))) for x in (path, f"{path}/*")]
    return hashlib.sha256(re.sub(r"access_?[tT]ime=\d+", "", " ".join(said)).encode()).hexdigest()
