"""Tables kept in folders: rewriting only the shards that change, and lookups by clustered key.

A sharded table has one folder per shard. An upsert reads and replaces the folders its rows
fall in, by dynamic partition overwrite; no other file is touched. A clustered table is
sorted by its key across files and carries Parquet Bloom filters, so that a small request
set, pushed down as a list of keys, opens only the row groups that may hold them.

Which version readers see is told by an append-only log of publications, written last: a
version whose data is not complete is never named there, and naming it is one small file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.tables import upsert

#: Beyond this many keys a request set is joined instead of listed.
LISTED_KEYS = 1_000


def _overwrite(rows: DataFrame, path: str, shard: str) -> None:
    (
        rows.repartition(shard)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    )


def write_sharded(rows: DataFrame, path: str, shard: str) -> None:
    """Write a table with one folder per value of ``shard``; folders of other shards stay."""
    _overwrite(rows, path, shard)


def shards_of(rows: DataFrame, shard: str) -> list[str]:
    """The shards rows fall in. Bounded by the number of shards a table has, not by its rows."""
    return sorted(str(r[0]) for r in rows.select(F.col(shard).cast("string")).distinct().collect())


def read_sharded(spark: SparkSession, path: str, shard: str, shards: list[str] | None = None, schema: str | StructType | None = None) -> DataFrame:
    """The table, or only the named shards: the filter is on the folder's column, so no other folder is listed for reading."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.option("basePath", path).parquet(path)
    # Folder names may look like numbers or dates; they are compared as text.
    rows = rows.withColumn(shard, F.col(shard).cast("string"))
    return rows if shards is None else rows.where(F.col(shard).isin(shards))


def upsert_sharded(spark: SparkSession, path: str, new: DataFrame, keys: list[str], shard: str, schema: str | StructType, keep: tuple[str, ...] = ()) -> list[str]:
    """Insert or replace rows by key in the shards that ``new`` touches. Returns these.

    ``shard`` must follow from the keys. ``schema`` is the table's, the shard column as a
    string, so that folder names are never guessed at. A repeated upsert rewrites the same
    folders with the same rows. Spark moves the new files in when all are written; a failed
    job leaves the old ones.
    """
    touched = shards_of(new, shard)
    if touched:
        old = read_sharded(spark, path, shard, touched, schema)
        _overwrite(upsert(old, new.withColumn(shard, F.col(shard).cast("string")), keys, keep), path, shard)
    return touched


# ---- clustered tables


def write_clustered(rows: DataFrame, path: str, key: str, files: int = 0, rows_per_group: int = 0) -> None:
    """Write a table in ranges of its key, sorted, with a Bloom filter on the key in every row group.

    ``files`` 0 leaves their number to the shuffle settings, ``rows_per_group`` 0 the size of
    row groups to Parquet's own.
    """
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    writer = dealt.sortWithinPartitions(key).write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{key}", "true")
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group).option(f"parquet.bloom.filter.expected.ndv#{key}", rows_per_group)
    writer.parquet(path)


def lookup(table: DataFrame, requests: DataFrame, key: str, listed: int = LISTED_KEYS) -> DataFrame:
    """Rows of a clustered table whose key is asked for.

    Up to ``listed`` keys are pushed to the scan as a list, where row-group statistics and
    Bloom filters refuse whole row groups; more of them are joined, the table's side filtered
    at run time by what the requests hold. Both give the same rows.
    """
    asked = requests.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in asked.limit(listed + 1).collect()]
    if len(few) > listed:
        return table.join(asked, key, "left_semi")
    spark = table.sparkSession
    # A list longer than this setting is pushed down as a range only.
    if int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")) < listed:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", listed)
    return table.where(F.col(key).isin(few) if few else F.lit(False))


# ---- publications


def publish_version(spark: SparkSession, log: str, version: str, now: Column) -> None:
    """Name the version readers shall use from now on. Its data must be complete."""
    row = spark.range(1).coalesce(1).select(F.lit(version).alias("snapshot_version"), now.cast("timestamp").alias("published_at"))
    row.write.mode("append").parquet(log)


def current_version(spark: SparkSession, log: str) -> str | None:
    """The version published last; of equals, the greater name."""
    rows = spark.read.schema("snapshot_version string, published_at timestamp").parquet(log)
    return rows.agg(F.max_by("snapshot_version", F.struct("published_at", "snapshot_version"))).first()[0]
