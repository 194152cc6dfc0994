"""A postings store that grows by small parts, one per micro-batch.

A part holds one folded row per fingerprint of its batch, in folders by a hash bucket of the fingerprint.
Writing a batch reads nothing of the store: a posting's row is the fold of its rows in all parts, oldest
first.  When FAN parts of one level stand at the end, they are folded into one part of the next level, so a
row is written again only as often as the number of parts has digits to the base FAN.  A version of the
store is the list of its parts; parts are never changed after the version that wrote them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from jobsieve import fixed, schema
from jobsieve.functions.dates import moment
from jobsieve.operators.store import fold_batch

FAN = 4  # parts of one level that become one of the next
BUCKETS = 8

_PART = (
    "fingerprint string, company_name string, job_role string, source_website string, first_number string, "
    "number_of_people string, location string, posted_by string, job_url string, posted_date string, "
    "published_at string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, scrape_count bigint, bucket int"
)
_LOG = "run_id string, batch_id bigint, parts array<struct<name:string,level:int>>, written array<string>, version int"
_UPDATED = ("number_of_people", "location", "posted_by", "job_url", "posted_date", "published_at")


def kept_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table that batches append to; empty before the first."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def bucket_of(fingerprint: Column | str) -> Column:
    return F.pmod(F.xxhash64(fingerprint), F.lit(BUCKETS)).cast("int")


def folded_part(batch: DataFrame, now) -> DataFrame:
    """One row per fingerprint of a batch, as parts hold them."""
    at = moment(now)
    good = [F.col(f"good_{name}").alias(name) for name in _UPDATED]
    return fold_batch(batch).select(
        "fingerprint", "first.company_name", "first.job_role", "first.source_website",
        F.col("first.number_of_people").alias("first_number"), *good,
        at.alias("first_seen_at"), at.alias("last_seen_at"), F.col("batch_rows").alias("scrape_count"),
        bucket_of("fingerprint").alias("bucket"),
    )


def _read_parts(spark: SparkSession, path: str, names: list[str]) -> list[DataFrame]:
    return [spark.read.schema(_PART).parquet(f"{path}/parts/{name}") for name in names]


def _fold(parts: list[DataFrame]) -> DataFrame:
    """The parts, oldest first, as one part."""
    if len(parts) == 1:
        return parts[0]
    age = F.col("age")
    rows = reduce(DataFrame.unionByName, [p.withColumn("age", F.lit(k)) for k, p in enumerate(parts)])
    origin = F.min_by(F.struct("source_website", "first_number", "first_seen_at"), age)
    folded = rows.groupBy("fingerprint").agg(
        origin.alias("origin"),
        *[F.min_by(name, F.when(F.col(name).isNotNull(), age)).alias(name) for name in ("company_name", "job_role")],
        *[F.max_by(name, F.when(F.col(name).isNotNull(), age)).alias(name) for name in _UPDATED],
        F.max_by("last_seen_at", age).alias("last_seen_at"),
        F.sum("scrape_count").alias("scrape_count"),
        F.first("bucket").alias("bucket"),
    )
    return folded.select("*", "origin.*").select(*T.StructType.fromDDL(_PART).names)


def _as_store(part: DataFrame) -> DataFrame:
    na = F.lit(fixed.NOT_AVAILABLE)
    return part.withColumns(
        {
            "number_of_people": F.coalesce("number_of_people", "first_number"),
            "location": F.coalesce("location", na),
            "posted_by": F.coalesce("posted_by", na),
        }
    ).select(*T.StructType.fromDDL(schema.STORE).names)


def _log(spark: SparkSession, path: str) -> DataFrame:
    return kept_log(spark, f"{path}/log", _LOG)


def latest_version(spark: SparkSession, path: str) -> int:
    """The latest finished version of a store; 0 before the first."""
    return _log(spark, path).agg(F.max("version")).first()[0] or 0


def _parts_of(spark: SparkSession, path: str, version: int) -> list[tuple[str, int]]:
    row = _log(spark, path).where(F.col("version") == version).first()
    return [(p["name"], p["level"]) for p in row["parts"]] if row else []


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the store, the latest unless one is named."""
    parts = _parts_of(spark, path, version or latest_version(spark, path))
    if not parts:
        return spark.createDataFrame([], schema.STORE)
    return _as_store(_fold(_read_parts(spark, path, [name for name, _ in parts])))


def known_fingerprints(spark: SparkSession, path: str, version: int, buckets: list[int]) -> DataFrame:
    """(fingerprint) of some buckets of a version; reads that column of those folders only.  A posting may occur once per part."""
    found = [p.where(F.col("bucket").isin(buckets)).select("fingerprint") for p in _read_parts(spark, path, [n for n, _ in _parts_of(spark, path, version)])]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "fingerprint string")


class Turn:
    """One batch's place in the store: the version that it writes, and the parts before it.

    A batch that is replayed finds its own version again and writes it anew.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str, batch_id: int):
        rows = _log(spark, path)
        own = (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)
        mine, latest = rows.agg(F.max(F.when(own, F.col("version"))), F.max("version")).first()
        self.spark, self.path, self.run_id, self.batch_id = spark, path, run_id, batch_id
        self.version = mine or (latest or 0) + 1
        self.before = _parts_of(spark, path, self.version - 1) if self.version > 1 else []

    def add(self, batch: DataFrame, now) -> None:
        """Write the batch as a part, fold full levels, and make the version the latest."""
        part = folded_part(batch, now)
        parts = [*self.before, self._write(part, 0)]
        written = [parts[-1][0]]
        while len(parts) >= FAN and len({level for _, level in parts[-FAN:]}) == 1:
            level = parts[-1][1] + 1
            merged = _fold(_read_parts(self.spark, self.path, [name for name, _ in parts[-FAN:]]))
            parts = [*parts[:-FAN], self._write(merged, level)]
            written.append(parts[-1][0])
        row = self.spark.createDataFrame([(self.run_id, self.batch_id, parts, written)], _LOG.rsplit(",", 1)[0])
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={self.version}")

    def _write(self, part: DataFrame, level: int) -> tuple[str, int]:
        name = f"v{self.version}-{level}"
        part.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/parts/{name}")
        return name, level


def drop_unused(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the parts that none of the last ``keep`` versions names; older versions can then no longer be read.

    Call it between runs: a batch that is being written may still read the parts of the version before.
    """
    last = latest_version(spark, path)
    rows = _log(spark, path)
    held = rows.where(F.col("version") > last - keep).select(F.explode("parts.name").alias("name"))
    done = rows.where(F.col("version") <= last).select(F.explode("written").alias("name"))
    old = done.distinct().join(held.distinct(), "name", "left_anti")
    names = sorted(r["name"] for r in old.collect())  # some for each batch
    context = spark.sparkContext
    for name in names:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{name}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return names
