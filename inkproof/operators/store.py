"""A keyed table in hash buckets: an upsert reads and writes only the buckets of its rows.

Each version of a bucket is a folder of its own; a manifest names the folder of every bucket and is
put in place by one rename when all folders are written. So readers see a whole version, a run that is
stopped leaves the one before, and a lost executor costs a reread of files. There is one writer at a time.

    path/manifest/00000002.json     {"schema": …, "folders": {"3": "data/v=2/bucket=3", …}}
    path/data/v=2/bucket=3/part-….parquet
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


class Store:
    """``keys``: what makes a row unique, of which the first is hashed to the bucket. Rows with a null key are one row each key."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("document_id",), buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the manifests, ascending."""
        path, fs = self._fs("manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())

    def _manifest(self, number: int | None = None) -> dict:
        number = number or (self.versions() or [0])[-1]
        if not number:
            return {"number": 0, "schema": None, "folders": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{number:08d}.json", wholetext=True).first()["value"]
        found = json.loads(text)
        if found["buckets"] != self.buckets or found["keys"] != list(self.keys):
            raise ValueError(f"the store has {found['buckets']} buckets by {found['keys']}")
        return found | {"number": number}

    def _bucket(self):
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # as many as buckets at most

    def _rows(self, manifest: dict, wanted: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in manifest["folders"].items() if wanted is None or int(b) in wanted]
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, near: DataFrame | None = None, version: int | None = None) -> DataFrame | None:
        """All rows, or those in the buckets of the keys of ``near``; None before anything is stored."""
        return self._rows(self._manifest(version), None if near is None else self._touched(near))

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Put rows in place of those with their keys. Of several the one with the latest ``order`` stays; of ties, and without one, a new row.

        ``rows`` is computed twice: cut its lineage before, if it costs much.
        """
        manifest = self._manifest()
        if manifest["schema"] is not None and StructType.fromJson(manifest["schema"]).simpleString() != rows.schema.simpleString():
            raise ValueError("the rows' columns aren't those of the store")
        touched = self._touched(rows)
        if not touched and manifest["schema"] is not None:
            return
        old = self._rows(manifest, touched)
        both = rows.withColumn("_new", F.lit(1)) if old is None else old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        # The largest of a key, combined before the shuffle; nulls of ``order`` are smallest, further ties go by a hash of the row.
        plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
        rank = F.struct(*([order] if order else []), "_new", F.xxhash64(*plain).alias("_hash"))
        kept = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), rank).alias("_row")).select("_row.*").withColumn("bucket", self._bucket())
        number = manifest["number"] + 1
        # Rebalanced by bucket: small ones share a task, a large one is split.
        kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        folders = manifest["folders"] | {str(b): f"data/v={number}/bucket={b}" for b in touched}
        self._commit(number, {"schema": rows.schema.jsonValue(), "keys": list(self.keys), "buckets": self.buckets, "folders": folders})

    def _commit(self, number: int, manifest: dict) -> None:
        """Write the manifest beside its place, and rename it."""
        target, fs = self._fs(f"manifest/{number:08d}.json")
        draft, _ = self._fs(f"manifest/.{number:08d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"version {number} was written by another")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders and manifests that none of the last ``keep`` versions needs; also what a stopped run left. Gives their names."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        gone = [f"manifest/{v:08d}.json" for v in versions[:-keep]]
        path, fs = self._fs("data")
        for version in fs.listStatus(path) if fs.exists(path) else []:
            for folder in fs.listStatus(version.getPath()):
                name = f"data/{version.getPath().getName()}/{folder.getPath().getName()}"
                if folder.isDirectory() and name not in used:
                    gone.append(name)
        for name in gone:
            path, fs = self._fs(name)
            fs.delete(path, True)
        return gone
