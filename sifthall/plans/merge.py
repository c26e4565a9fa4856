"""Keyed upserts without a transactional table format.

``keyed_upsert`` is a pure function: union of target and updates, one aggregate per key. ``VersionedTable`` keeps
versions as sibling folders with a pointer file that is replaced as a whole, for one writer at a time; readers see the
old or the new version, and a failed write leaves the pointer where it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keyed_upsert(target: DataFrame, updates: DataFrame, key: list[str], order: list[Column], *, keep: list[str] = (), fill: list[str] = (), last: dict[str, Column] | None = None) -> DataFrame:  # type: ignore[assignment]
    """``target`` with ``updates`` merged in by ``key``.

    The newest row of a key wins by ``order`` (updates win ties); columns in ``keep`` stay those of the oldest row (such
    as first_seen); those in ``fill`` take the newest value that is not null; ``last`` overrides columns of keys that
    were updated. Upserting the same rows again changes nothing. Aggregates combine before the shuffle, so a key with
    very many updates costs one row per task."""
    columns = target.columns
    rows = target.withColumn("__new", F.lit(0)).unionByName(updates.select(*columns).withColumn("__new", F.lit(1)))
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("__new").alias("n"))
    plain = [c for c in columns if c not in key and c not in keep and c not in fill]
    aggregates = [F.max("__new").alias("__touched")]
    if plain:
        aggregates.append(F.max_by(F.struct(*plain), rank).alias("__row"))
    first = F.struct(F.col("__new").alias("n"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    aggregates += [F.min_by(F.struct(F.col(c)), first).alias(f"__keep_{c}") for c in keep]
    aggregates += [F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c))), F.when(F.col(c).isNotNull(), rank)).alias(f"__fill_{c}") for c in fill]
    merged = rows.groupBy(*key).agg(*aggregates)
    value = lambda c: F.col(c) if c in key else F.col(f"__keep_{c}")[c] if c in keep else F.col(f"__fill_{c}")[c] if c in fill else F.col("__row")[c]
    last = last or {}
    return merged.select(*[(F.when(F.col("__touched") == 1, last[c]).otherwise(value(c)) if c in last else value(c)).alias(c) for c in columns])


def insert_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``target`` and those of ``rows`` whose key it does not have; of equal keys in ``rows`` one is taken."""
    new = rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")
    return target.unionByName(new.select(*target.columns))


def replaced(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``target`` with all rows of the keys that ``rows`` has replaced by ``rows`` (delete, then insert)."""
    return target.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows.select(*target.columns))


def patched(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with columns set where a condition holds; unknown columns are ignored."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})


def conformed(df: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with ``columns`` (name: type, value where it is missing or null) added or filled: running it again changes nothing."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast(t), v.cast(t)) if c in have else v.cast(t) for c, (t, v) in columns.items()})


def positions_marked(items: DataFrame, place: list[str], id_: str = "id", index: str = "item_index") -> DataFrame:
    """``items`` where a place that several rows claim stays the newest row's; the others move to minus their id."""
    newest = items.groupBy(*place).agg(F.max(id_).alias("__newest"))
    joined = items.join(newest, place)
    return joined.withColumn(index, F.when(F.col(id_) == F.col("__newest"), F.col(index)).otherwise(-F.col(id_))).drop("__newest").select(*items.columns)


class VersionedTable:
    """Versions of a table under one folder, and a pointer to the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        pointer = self._Path(f"{self.path}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()["value"]

    def read(self) -> DataFrame | None:
        version = self._version()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame, partition_by: list[str] = ()) -> None:  # type: ignore[assignment]
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{version}")
        target, fresh = self._Path(f"{self.path}/CURRENT"), self._Path(f"{self.path}/.next-{version}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(fresh, target, array)

    def upsert(self, updates: DataFrame, key: list[str], order: list[Column], **kinds) -> None:
        current = self.read()
        base = updates.limit(0) if current is None else current
        self.write(keyed_upsert(base, updates, key, order, **kinds))


class BucketedTable:
    """A keyed table in ``buckets`` of its key, each a versioned table of its own: an upsert rewrites only the buckets that its rows
    touch, in one write, and leaves the others as they are. A failed upsert leaves whole buckets old or new; giving it the same
    rows again completes it."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.head = VersionedTable(spark, f"{self.path}/head")

    def _paths(self) -> dict[int, str]:
        head = self.head.read()
        return {} if head is None else {r["bucket"]: r["path"] for r in head.collect()}  # one row per bucket

    def read(self) -> DataFrame | None:
        paths = self._paths()
        return self.spark.read.parquet(*sorted(paths.values())) if paths else None

    def upsert(self, updates: DataFrame, key: list[str], order: list[Column], **kinds) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r["b"] for r in updates.select(bucket.alias("b")).distinct().collect())  # no more than there are buckets
        if not touched:
            return
        paths = self._paths()
        old = [paths[b] for b in touched if b in paths]
        base = self.spark.read.parquet(*old) if old else updates.limit(0)
        merged = keyed_upsert(base, updates, key, order, **kinds).withColumn("__bucket", bucket)
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        merged.repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(version)
        after = paths | {b: f"{version}/__bucket={b}" for b in touched}
        self.head.write(self.spark.createDataFrame(sorted(after.items()), "bucket int, path string").coalesce(1))
