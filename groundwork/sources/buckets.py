"""Keyed tables cut into buckets, so that a merge rewrites only the buckets it touches.

    <root>/files/load=<name>/bucket=<n>   rows whose key hashes to bucket n
    <root>/version=<v>                    which load holds each bucket in version v

A version is a list of one row per bucket. A merge reads the buckets its source falls into, writes them as a
new load, and publishes a list that names the new load for them and the old ones for the rest. Versions
appear whole or not at all (Spark's ``_SUCCESS`` marker), and old ones stay readable until they are vacuumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.errors import TableNotFound
from groundwork.operators.upsert import merge_into
from groundwork.sources.scratch import list_names, remove_folder
from groundwork.sources.versions import complete_versions, version_path

LIST = "bucket int, load string, buckets int, keys array<string>, columns string"
#: Bound on the number of buckets: what a version lists, and what the driver reads of it.
MOST_BUCKETS = 65_536


@dataclass(frozen=True)
class BucketedTable:
    spark: SparkSession
    root: str

    def exists(self) -> bool:
        return bool(list_names(self.spark, f"{self.root}/files")) and bool(complete_versions(self.spark, self.root))

    def _list(self, below: int | None = None) -> list:
        versions = [v for v in complete_versions(self.spark, self.root) if below is None or v < below]
        if not versions:
            raise TableNotFound(f"no version of a bucketed table in {self.root}")
        return self.spark.read.schema(LIST).parquet(version_path(self.root, versions[-1])).collect()

    def read(self, below: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest version (older than ``below``), or only some buckets of it."""
        return self._read(self._list(below), buckets)

    def read_touched(self, source: DataFrame, below: int | None = None) -> DataFrame:
        """The buckets that the keys of ``source`` fall into."""
        listed = self._list(below)
        return self._read(listed, self._touched(source, listed))

    def _touched(self, source: DataFrame, listed: list) -> list[int]:
        place = bucket_of(listed[0]["keys"], listed[0]["buckets"])
        return sorted(r["bucket"] for r in source.select(place.alias("bucket")).distinct().collect())

    def _read(self, listed: list, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(listed[0]["columns"]))
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/files/load={r['load']}/bucket={r['bucket']}" for r in listed if r["load"] and (wanted is None or r["bucket"] in wanted)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(
        self,
        source: DataFrame,
        update_cols: Sequence[str],
        defaults: Mapping[str, Column] | None = None,
        version: int | None = None,
        new_columns: Sequence[str] = (),
    ) -> list[int]:
        """Merge ``source`` as :func:`merge_into` does and publish the result; the buckets that were rewritten.

        ``new_columns`` of the source are added to the table, NULL in the rows it does not touch. ``version`` is
        the number to publish, by default the next; it is made from the newest version below it.
        """
        done = complete_versions(self.spark, self.root)
        version = (done[-1] + 1 if done else 0) if version is None else version
        listed = self._list(below=version)
        keys, number = listed[0]["keys"], listed[0]["buckets"]
        touched = self._touched(source, listed)
        target = self._read(listed, touched)
        for name in new_columns:
            if name not in target.columns:
                target = target.withColumn(name, F.lit(None).cast(source.schema[name].dataType))
        if touched:
            load = self._write(merge_into(target, source, keys, update_cols, defaults), keys, number)
            kept = {r["bucket"]: r["load"] for r in listed} | {b: load for b in touched}
            _publish(self.spark, self.root, version, kept, number, keys, target.schema)
        else:
            _publish(self.spark, self.root, version, {r["bucket"]: r["load"] for r in listed}, number, keys, target.schema)
        return touched

    def _write(self, rows: DataFrame, keys: Sequence[str], number: int) -> str:
        load = uuid.uuid4().hex
        placed = rows.withColumn("bucket", bucket_of(keys, number))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/files/load={load}")
        return load

    def vacuum(self, keep: int = 2) -> int:
        """Remove loads that none of the newest ``keep`` versions names, and older versions; how many loads went.

        Only while nothing is being merged: a load that is not published yet looks like one to remove.
        """
        done = complete_versions(self.spark, self.root)
        stay = {r["load"] for v in done[-keep:] for r in self.spark.read.schema(LIST).parquet(version_path(self.root, v)).collect()}
        gone = [name for name in list_names(self.spark, f"{self.root}/files/load=*") if name.removeprefix("load=") not in stay]
        for v in done[:-keep]:
            remove_folder(self.spark, version_path(self.root, v))
        for name in gone:
            remove_folder(self.spark, f"{self.root}/files/{name}")
        return len(gone)


def bucket_of(keys: Sequence[str], number: int) -> Column:
    """Keys are hashed as text, so that an integer key falls into the same bucket whatever its width."""
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(number)).cast("int")


def create(df: DataFrame, root: str, keys: Sequence[str], buckets: int = 256) -> BucketedTable:
    """Write ``df`` as version 0 of a new bucketed table."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
    table = BucketedTable(df.sparkSession, root)
    load = table._write(df, keys, buckets)
    _publish(df.sparkSession, root, 0, dict.fromkeys(range(buckets), load), buckets, keys, df.schema)
    return table


def _publish(spark: SparkSession, root: str, version: int, loads: Mapping[int, str], number: int, keys: Sequence[str], schema: T.StructType) -> None:
    # A bucket without rows has no folder; the list names only folders that are there.
    there = {load: set(list_names(spark, f"{root}/files/load={load}/bucket=*")) for load in set(loads.values()) if load}
    rows = [(b, load if load and f"bucket={b}" in there[load] else None, number, list(keys), schema.json()) for b, load in sorted(loads.items())]
    spark.createDataFrame(rows, LIST).coalesce(1).write.mode("overwrite").parquet(version_path(root, version))
