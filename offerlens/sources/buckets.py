"""A keyed table as folders of key-hash buckets, with a manifest per version.

``root/v7/bucket=3/…`` holds the rows of bucket 3 as version 7 wrote them, and
``root/manifest/…7.json`` names for each bucket the version that holds it now. A merge
reads the buckets its batch falls in, writes only these into a folder of its own version,
and commits by creating the next manifest, which no other writer may have created.
Nothing that a reader could be reading is overwritten, a failed write leaves the table as
it was, and what a merge costs follows from the buckets it touches, not from the table.
Folders that neither this nor the last version names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, kind: StructType, keys: Sequence[str], count: int, order: Sequence[str] = ()):
        """``count`` holds for a new table; a stored one keeps its own."""
        self.spark, self.root, self.kind, self.keys, self.new_count, self.order = spark, root, kind, list(keys), count, list(order)

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, files = self._files(path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    # Manifests ----------------------------------------------------------------
    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names(f"{self.root}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``count`` of buckets, and the version that ``holds`` each bucket
        with rows; version 0 before the first write."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version not in known:
            return {"version": 0, "count": self.new_count, "holds": {}}
        at, files = self._files(f"{self.root}/manifest/{version:020d}.json")
        stream = files.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return {**found, "holds": {int(b): v for b, v in found["holds"].items()}}

    def _commit(self, manifest: dict) -> None:
        at, files = self._files(f"{self.root}/manifest/{manifest['version']:020d}.json")
        stream = files.create(at, False)  # an error if another writer was first
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.versions())

    # Rows -----------------------------------------------------------------------
    def bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's keys: at most as many numbers as there are buckets."""
        found = batch.select(self.bucket(self.manifest()["count"]).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The stored rows, of some buckets or of all; others aren't opened."""
        manifest = self.manifest(version)
        wanted = manifest["holds"] if buckets is None else {b: manifest["holds"][b] for b in buckets if b in manifest["holds"]}
        if not wanted:
            return self.spark.createDataFrame([], self.kind)
        paths = [f"{self.root}/v{v}/bucket={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(self.kind).parquet(*paths).select(*self.kind.fieldNames())

    def write(self, rows: DataFrame, buckets: Sequence[int] | None = None) -> int:
        """Replace whole buckets (all of them by default) by ``rows``, which must fall into
        them and may derive from what is stored. Returns the new version."""
        manifest = self.manifest()
        version = manifest["version"] + 1
        place = f"{self.root}/v{version}"
        dealt = rows.select(*self.kind.fieldNames()).withColumn("bucket", self.bucket(manifest["count"]))
        # Small buckets come to one file each, a large one is split over tasks.
        dealt = dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(place)
        written = {int(n.split("=")[1]) for n in self._names(place) if n.startswith("bucket=")}
        replaced = set(range(manifest["count"])) if buckets is None else set(buckets)
        if not written <= replaced:
            raise ValueError(f"rows outside the buckets that are replaced: {sorted(written - replaced)}")
        holds = {b: v for b, v in manifest["holds"].items() if b not in replaced} | {b: version for b in written}
        self._commit({"version": version, "count": manifest["count"], "holds": holds})
        self._tidy()
        return version

    def _tidy(self) -> None:
        """Delete manifests but the last two, and bucket folders that neither names."""
        versions = self.versions()
        for old in versions[:-2]:
            at, files = self._files(f"{self.root}/manifest/{old:020d}.json")
            files.delete(at, False)
        used = {(v, b) for n in versions[-2:] for b, v in self.manifest(n)["holds"].items()}
        for folder in self._names(self.root):
            if folder[0] != "v" or int(folder[1:]) > versions[-1]:
                continue
            here = [n for n in self._names(f"{self.root}/{folder}") if n.startswith("bucket=")]
            gone = [n for n in here if (int(folder[1:]), int(n.split("=")[1])) not in used]
            for name in [folder] if len(gone) == len(here) else [f"{folder}/{n}" for n in gone]:
                at, files = self._files(f"{self.root}/{name}")
                files.delete(at, True)
