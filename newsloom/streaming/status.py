"""How streams are doing, as a table: one small file for each batch that a query ran, and its summary by query."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "id string, name string, batch long, at string, rows long, seconds double, state_rows long, error string"


class ProgressLog(StreamingQueryListener):
    """A listener that keeps each batch's progress in `folder`: spark.streams.addListener(ProgressLog(folder))."""

    def __init__(self, folder: str):
        self.folder = folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}"

    def _keep(self, row: dict) -> None:
        files, root = fs.FileSystem.from_uri(self.folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/{row['id']}-{row['batch']}{'-end' if row['error'] else ''}.json"
        with files.open_output_stream(name) as out:  # a batch that runs again writes its file again
            out.write(json.dumps(row).encode())

    def keep(self, progress: dict) -> None:
        """One entry of StreamingQuery.recentProgress."""
        state = sum(s["numRowsTotal"] for s in progress["stateOperators"])
        spent = progress["durationMs"].get("triggerExecution", 0) / 1000
        self._keep({"id": progress["id"], "name": progress["name"], "batch": progress["batchId"], "at": progress["timestamp"], "rows": progress["numInputRows"], "seconds": spent, "state_rows": state, "error": None})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.keep(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self._keep({"id": str(event.id), "name": None, "batch": -1, "at": None, "rows": 0, "seconds": 0.0, "state_rows": 0, "error": event.exception[:500]})


def ingestion_status(spark: SparkSession, folder: str) -> DataFrame:
    """(name, batches, rows, state_rows, last_at, error) by query, from the files of a ProgressLog; unnamed queries go by their id."""
    rows = spark.read.schema(PROGRESS).json(folder)
    named = rows.groupBy("id").agg(F.max("name").alias("name"))
    x = rows.drop("name").join(named, "id").groupBy(F.coalesce("name", "id").alias("name"))
    return x.agg(
        F.countDistinct(F.when(F.col("batch") >= 0, F.struct("id", "batch"))).alias("batches"), F.sum("rows").alias("rows"), F.max_by("state_rows", "at").alias("state_rows"), F.max("at").alias("last_at"), F.max("error").alias("error")
    )
