"""Sessions with the settings that stages count on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Runtime re-planning, with skewed joins split; times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local(name: str, cores: int | str = "*", **settings: str) -> SparkSession:
    """A session in this process; shuffles go to as many partitions as there are cores."""
    known = {} if cores == "*" else {"spark.sql.shuffle.partitions": str(cores)}
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map={**SETTINGS, **known, **settings}).getOrCreate()


def cluster(name: str, checkpoint_dir: str, shuffle_partitions: int = 2000, **settings: str) -> SparkSession:
    """A session on the cluster that spark-submit names.  ``checkpoint_dir`` is a folder all executors share."""
    known = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.checkpoint.dir": checkpoint_dir}
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **known, **settings}).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A folder for intermediate files that goes when the application ends, in the one executors share
    (``spark.checkpoint.dir``).  Where none is set, a session of one process gets a temporary one; on a cluster that is
    an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        found = sc.getCheckpointDir()
    folder = f"{found.rstrip('/')}/millrace-work/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
