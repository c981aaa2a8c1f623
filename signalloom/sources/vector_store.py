"""A table of chunk vectors that batches are merged into, bucket by bucket.

Rows lie in buckets by a hash of their chunk.  A batch rewrites the buckets it touches into a
folder of its own version and reads no other; a small manifest then names the folder of every
bucket.  Readers follow the newest manifest, so that a version is seen whole or not at all, and
writing the same version again changes nothing.

    path/versions/<version>.json          which version each bucket lies in
    path/data/version=<v>/bucket=<b>/     rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import latest_per_key
from ..session import remove_folder, staged
from . import manifests


class VectorStore:
    """``buckets`` holds for new stores; an existing one keeps its own.

    A bucket is rewritten by one task, so choose them for some hundred megabytes each.  A batch
    gets to the driver as the numbers of its buckets.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        newest = self.manifest()
        self.buckets = newest["buckets"] if newest else buckets

    # --- versions ---

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return sorted(int(n) for n in manifests.committed(self.spark, f"{self.path}/versions"))

    def manifest(self, version: int | None = None) -> dict | None:
        """``{"buckets": .., "schema": .., "places": {bucket: version}}`` of a version, the newest by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        return manifests.load(self.spark, f"{self.path}/versions", str(known[-1] if version is None else version))

    # --- rows ---

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, buckets: list[int] | None = None) -> list[str]:
        wanted = manifest["places"] if buckets is None else [str(b) for b in buckets]
        return [f"{self.path}/data/version={manifest['places'][b]}/bucket={b}" for b in wanted if b in manifest["places"]]

    def _rows(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version; an error before the first."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"no such version of {self.path}")
        return self._rows(self._folders(manifest), T.StructType.fromJson(manifest["schema"]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, read from their buckets alone."""
        manifest = self.manifest()
        if manifest is None:
            raise ValueError(f"no such version of {self.path}")
        wanted = keys.select(F.col(self.key)).distinct()
        touched = sorted(r[0] for r in wanted.select(self.bucket_of(F.col(self.key))).distinct().collect())
        rows = self._rows(self._folders(manifest, touched), T.StructType.fromJson(manifest["schema"]))
        return rows.join(wanted, self.key, "left_semi")

    def upsert(self, batch: DataFrame, version: int, order: str | None = None) -> bool:
        """Merge a batch: per key the row of the batch replaces what is stored.

        Of several rows of a key in the batch the one with the greatest ``order``, else with the
        greatest content, stays.  Rows without a key are an error.  A version that is committed
        already is left as it is (False), so that a replayed batch does no harm; versions ascend.
        New columns are null in older rows.
        """
        known = self.versions()
        if version in known:
            return False
        if known and version < known[-1]:
            raise ValueError(f"version {version} after {known[-1]}")
        old = self.manifest()
        kept = [f for f in (T.StructType.fromJson(old["schema"]) if old else T.StructType()) if f.name not in batch.columns]
        schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in batch.schema], *kept])
        own = F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"a row without {self.key}"))).otherwise(F.col(self.key))
        fresh = batch.withColumn(self.key, own)
        if order is None:
            fresh = latest_per_key(fresh.withColumn("__order", F.lit(0)), self.key, "__order").drop("__order")
        else:
            fresh = latest_per_key(fresh, self.key, order)
        fresh = staged(fresh)  # read three times
        bucket = self.bucket_of(F.col(self.key))
        # one number per bucket
        touched = sorted(r[0] for r in fresh.select(bucket).distinct().collect())
        stored = self._rows(self._folders(old, touched) if old else [], schema)
        rest = stored.join(fresh.select(self.key), self.key, "left_anti")
        merged = rest.unionByName(fresh, allowMissingColumns=True).select(*schema.names)
        folder = f"{self.path}/data/version={version}"
        # whatever an interrupted run of this version left is overwritten
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        places = (old["places"] if old else {}) | {str(b): version for b in touched}
        manifests.commit(self.spark, f"{self.path}/versions", str(version), {"buckets": self.buckets, "schema": schema.jsonValue(), "places": places})
        return True

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove data and manifests that the newest ``keep`` versions do not need; what is gone."""
        known = self.versions()
        if not known:
            return []
        gone = known[: -max(1, keep)]
        for version in gone:
            remove_folder(self.spark, f"{self.path}/versions/{version}.json")
        needed = {(str(v), b) for n in known[len(gone) :] for b, v in self.manifest(n)["places"].items()}
        data = f"{self.path}/data"
        for folder in manifests.names_in(self.spark, data):
            version = folder[len("version=") :]
            # a run that has not committed yet keeps what it writes
            if int(version) > known[-1] or int(version) in known[len(gone) :]:
                continue
            for name in manifests.names_in(self.spark, f"{data}/{folder}"):
                if name.startswith("bucket=") and (version, name[len("bucket=") :]) not in needed:
                    remove_folder(self.spark, f"{data}/{folder}/{name}")
        return gone
