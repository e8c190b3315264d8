"""Small helpers about the running Spark session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, see that checkpoints have a place, and set
    a batch size for Arrow where the session has the default.

    On a cluster whose nodes do not share the repository, ship it with --py-files as usual.  The folder for
    checkpoints is the session's spark.checkpoint.dir; only where that is unset and everything runs in one process, as in
    tests, it is a local one.
    """
    # rows are whole documents: small batches keep what Arrow and Python workers hold at once to a few MB
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    # arrays that a Python worker frees go back to the system: workers wait for further tasks, many to an executor
    for name, value in (("MALLOC_MMAP_THRESHOLD_", 4 << 20), ("MALLOC_TRIM_THRESHOLD_", 16 << 20), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        sc.environment.setdefault(name, str(value))
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsloom-checkpoint-"))
    return spark


class Rounds:
    """The state of a loop, written as a table of the checkpoint folder each round, the one before removed.

    checkpoint() would carry the size estimates of its plan along, which joins multiply: after some rounds of several
    joins they are numbers of millions of digits.  A table has its own size.  The last table stays, as results read it.

    Spark removes what a round has shuffled once the driver's collector finds its plan gone, which a driver of few objects may never do: it is asked
    to after each round, so that disk holds one round and not all.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.last = spark, f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}", None

    def write(self, state: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        state.write.parquet(path)
        if self.last:
            try:
                files, old = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.last))
                files.delete_dir(old)
            except (OSError, ValueError):  # a store that only Spark reaches: the tables go with the checkpoint folder
                pass
        self.last = path
        self.spark._jvm.System.gc()
        return self.spark.read.schema(state.schema).parquet(path)
