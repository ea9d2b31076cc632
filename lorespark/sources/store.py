"""Tables as versioned Parquet folders in buckets of keys: a write makes files for the buckets it touches, then a pointer names them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; what comes to the driver about a write is their numbers.
BUCKETS = 64


class Store:
    """Each write adds v<n> under root/table, with a folder for each bucket touched, and then the manifest _<n>.

    A manifest says which folders make up each bucket, so what a write leaves alone is neither read nor written again,
    and a reader sees a write whole or not at all. Rows are dealt to buckets by the keys of the table's first write.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self, table: str) -> int:
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("_")), default=0)

    def _manifest(self, table: str, version: int) -> dict | None:
        if not version:
            return None
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/{table}/_{version}/manifest.json").first()[0]
        return json.loads(text)

    def _publish(self, table: str, version: int, manifest: dict) -> int:
        fs, own = self._fs(f"{self.root}/{table}/.new-{version}/manifest.json")
        out = fs.create(own, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(own.getParent(), self._fs(f"{self.root}/{table}/_{version}")[1]):
            raise RuntimeError(f"version {version} of {table} was written by another")
        return version

    def _load(self, table: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{table}/{x}" for b, xs in manifest["buckets"].items() if buckets is None or b in buckets for x in xs]
        schema = self._jvm.org.apache.spark.sql.types.DataType.fromJson(manifest["schema"])
        reader = self.spark.read.schema(schema.toDDL())
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema.toDDL())

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        manifest = self._manifest(table, self.version(table) if version is None else version)
        return None if manifest is None else self._load(table, manifest)

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, version: int, df: DataFrame, keys: list[str]) -> dict[str, str]:
        """Writes df in buckets; gives the folder of each bucket that it touches."""
        path = f"{self.root}/{table}/v{version}"
        df.withColumn("_bucket", self._bucket(keys)).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(path)
        fs, p = self._fs(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {x.split("=")[1]: f"v{version}/{x}" for x in names if x.startswith("_bucket=")}

    def replace(self, table: str, df: DataFrame, keys: list[str] | None = None) -> int:
        """A new version with df alone, dealt by keys (all columns if none are given)."""
        n, keys = self.version(table) + 1, keys or df.columns
        return self._publish(table, n, {"keys": keys, "schema": df.schema.json(), "buckets": {b: [x] for b, x in self._write(table, n, df, keys).items()}})

    def _of_keys(self, table: str, keys: list[str]) -> tuple[int, dict | None, bool]:
        """The version, its manifest, and whether rows with equal keys share a bucket."""
        n = self.version(table)
        manifest = self._manifest(table, n)
        return n, manifest, manifest is not None and set(manifest["keys"]) <= set(keys)

    def _touched(self, df: DataFrame, manifest: dict, same: bool) -> list[str]:
        """The buckets that hold rows of df: BUCKETS numbers at most."""
        return [str(r[0]) for r in df.select(self._bucket(manifest["keys"])).distinct().collect()] if same else list(manifest["buckets"])

    def insert_absent(self, table: str, df: DataFrame, keys: list[str]) -> int:
        """Adds the rows of df whose keys the table doesn't hold: new files beside the old ones."""
        n, manifest, same = self._of_keys(table, keys)
        if manifest is None:
            return self.replace(table, df, keys)
        old = self._load(table, manifest, self._touched(df, manifest, same))
        added = self._write(table, n + 1, df.join(old.select(*keys), keys, "left_anti").select(*old.columns), manifest["keys"])
        for b, x in added.items():
            manifest["buckets"].setdefault(b, []).append(x)
        return self._publish(table, n + 1, manifest)

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> int:
        """Puts the rows of df in the place of those with the same keys; only buckets that hold some are written anew."""
        n, manifest, same = self._of_keys(table, keys)
        if manifest is None:
            return self.replace(table, df, keys)
        touched = self._touched(df, manifest, same)
        old = self._load(table, manifest, touched)
        return self._rewritten(table, n, manifest, touched, old.join(df.select(*keys), keys, "left_anti").select(*old.columns).unionByName(df.select(*old.columns)))

    def replace_partition(self, table: str, df: DataFrame, column: str, value) -> int:
        """Puts df in the place of the rows where column is value; one bucket is written if the table is dealt by the column."""
        n, manifest, same = self._of_keys(table, [column])
        if manifest is None:
            return self.replace(table, df, [column])
        kind = self._load(table, manifest).schema[column].dataType
        one = self.spark.range(1).select(F.lit(value).cast(kind).alias(column))
        touched = sorted({*self._touched(one, manifest, same), *(self._touched(df, manifest, same) if same else [])})
        old = self._load(table, manifest, touched)
        return self._rewritten(table, n, manifest, touched, old.where(~old[column].eqNullSafe(F.lit(value))).unionByName(df.select(*old.columns)))

    def _rewritten(self, table: str, n: int, manifest: dict, touched: list[str], rows: DataFrame) -> int:
        written = self._write(table, n + 1, rows, manifest["keys"])
        for b in touched:
            manifest["buckets"].pop(b, None)
        manifest["buckets"] |= {b: [x] for b, x in written.items()}
        return self._publish(table, n + 1, manifest)
