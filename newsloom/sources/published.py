"""Tables that change by publishing versions: readers see the old rows or the new ones, never a part.

Rows lie in hash buckets of their key, each bucket in files of the version that last wrote it.  A write makes new files beside the old ones, then
replaces one small pointer file, which names the folder of every bucket, by an atomic rename.  A job that dies before that leaves the table as it was;
an update writes the buckets of the keys that it touches and no others.  One writer at a time; the pointer holds one line a bucket.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class PublishedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        """`path`: a folder that the driver and all executors share; `key`: the column by which rows are found."""
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = path if "://" in path or path.startswith("file:/") else f"file://{path}"

    # the pointer
    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def manifest(self) -> dict | None:
        """{"version", "schema", "buckets": {number: folder}} of the published version; None before the first."""
        files, root = self._files()
        if files.get_file_info(f"{root}/CURRENT").type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(f"{root}/CURRENT") as pointer:
            return json.loads(pointer.read())

    def _publish(self, manifest: dict) -> None:
        files, root = self._files()
        files.create_dir(root, recursive=True)
        aside = f"{root}/.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps(manifest).encode())
        files.move(aside, f"{root}/CURRENT")

    # rows
    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> set[str]:
        """Numbers of the buckets that got files."""
        own = rows.withColumn(BUCKET, self._bucket(self.key))
        own.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(f"{root}/{folder}"))
        return {f.base_name.split("=", 1)[1] for f in found if f.base_name.startswith(f"{BUCKET}=")}

    def replace(self, rows: DataFrame) -> int:
        """Publish these rows as the whole table; they may be made from what the table holds now.  The new version's number."""
        before = self.manifest()
        version = before["version"] + 1 if before else 1
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        made = self._write(rows, folder)
        self._publish({"version": version, "schema": rows.schema.json(), "buckets": {b: f"{folder}/{BUCKET}={b}" for b in sorted(made, key=int)}})
        return version

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The published rows; with `keys` (a column named as the key) the files of their buckets alone, of which one row a bucket is collected."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"nothing is published in {self.path}")
        return self._read(manifest, None if keys is None else self._touched(keys))

    def _touched(self, keys: DataFrame) -> set[str]:
        return {str(r[0]) for r in keys.select(self._bucket(self.key)).distinct().collect()}  # at most `buckets` rows

    def _read(self, manifest: dict, only: set[str] | None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.path}/{f}" for b, f in manifest["buckets"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def update(self, keys: DataFrame, change) -> int:
        """Publish a version in which `change(rows of the touched buckets)` stands in their place; the rest keeps its files.

        `keys` names every key whose rows the change removes, alters or adds.  The new version's number.
        """
        manifest = self.manifest()
        touched = self._touched(keys)
        folder = f"v{manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        made = self._write(change(self._read(manifest, touched)).select(*schema.names), folder) if touched else set()
        if made - touched:
            raise ValueError(f"the change adds rows of keys that it does not name (buckets {sorted(made - touched)})")
        kept = {b: f for b, f in manifest["buckets"].items() if b not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in made}
        self._publish(manifest | {"version": manifest["version"] + 1, "buckets": dict(sorted(kept.items(), key=lambda x: int(x[0])))})
        return manifest["version"] + 1

    def vacuum(self) -> int:
        """Remove folders that the published version does not name; how many went.  Readers of older versions lose them."""
        files, root = self._files()
        named = {f.split("/")[0] for f in (self.manifest() or {"buckets": {}})["buckets"].values()}
        old = [f for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name not in named]
        for f in old:
            files.delete_dir(f.path)
        return len(old)
