"""The postings store: merge, new-versus-seen, profiles, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from jobsieve import fixed, schema
from jobsieve.functions.dates import (
    is_new_today,
    moment,
    normalize_published,
    posted_label,
)
from jobsieve.functions.text import strip_name
from jobsieve.functions.urls import fingerprint
from jobsieve.operators.enrich import enrich_headcount


def with_fingerprint(df: DataFrame) -> DataFrame:
    key = fingerprint(F.col("company_name"), F.col("job_role"), F.col("job_url"))
    return df.withColumn("fingerprint", key)


def align_schema(store: DataFrame) -> DataFrame:
    """`align_schema`: add missing columns to an older store, numeric dates to text."""
    wanted = T.StructType.fromDDL(schema.STORE)
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in store.columns
    }
    full = store.withColumns(missing) if missing else store
    text = normalize_published(F.col("published_at").cast("string"))
    return full.withColumn("published_at", text).select(*wanted.names)


def scan_postings(store: DataFrame, source: str | None = None) -> DataFrame:
    """`scan_postings`: stored postings, optionally of one source (LIKE %source%)."""
    if not source:
        return store
    return store.filter(F.col("source_website").ilike(f"%{source}%"))


def master_postings(
    store: DataFrame, profiles: DataFrame, as_of, source: str | None = None
) -> DataFrame:
    """`master_postings`: the standard read view of the store."""
    rows = enrich_headcount(scan_postings(store, source), profiles)

    def or_na(name: str) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit(fixed.NOT_AVAILABLE))

    return rows.withColumns(
        {
            "posted_date": posted_label(
                F.col("published_at"), F.col("posted_date"), F.col("first_seen_at"), as_of
            ),
            "is_new_today": is_new_today(F.col("first_seen_at"), as_of),
            "location": or_na("location"),
            "posted_by": or_na("posted_by"),
        }
    )


def _good(name: str) -> Column:
    return (F.col(name) != fixed.NOT_AVAILABLE) & (F.col(name) != "")


def empty_store(spark: SparkSession) -> DataFrame:
    """A store without rows, which Spark knows to be empty."""
    return spark.createDataFrame([], schema.STORE).limit(0)


def _known_empty(df: DataFrame) -> bool:
    """True when the plan itself says that there are no rows; nothing is run."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and int(str(most.get())) == 0


def _ordered(df: DataFrame, order: str, *values: str) -> Column:
    """struct(order, values) for a min or max by the order, null without order; the fields of an order that is a struct stand on their own."""
    kind = df.schema[order].dataType
    keys = [F.col(order)[f.name].alias(f"_o{i}") for i, f in enumerate(kind.fields)] if isinstance(kind, T.StructType) else [F.col(order).alias("_o0")]
    return F.when(F.col(order).isNotNull(), F.struct(*keys, *values))


def fold_batch(batch: DataFrame) -> DataFrame:
    """One row per fingerprint of a batch: identity from the first arrival, the last
    usable value of every updatable column, and the number of rows."""
    na = F.lit(fixed.NOT_AVAILABLE)

    def text(name: str) -> Column:
        return F.coalesce(F.nullif(strip_name(F.col(name)), F.lit("")), na)

    rows = with_fingerprint(batch).withColumns(
        {
            "number_of_people": F.coalesce("number_of_people", na),
            "location": text("location"),
            "posted_by": text("posted_by"),
            "published_at": normalize_published(F.col("published_at").cast("string")),
        }
    )
    # one struct a value is shuffled, where min_by and max_by would shuffle the value and its order side by side
    identity = ("company_name", "job_role", "source_website", "number_of_people")
    usable = {name: _good(name) for name in ("number_of_people", "location", "posted_by")}
    usable |= {name: F.col(name).isNotNull() for name in ("job_url", "posted_date", "published_at")}
    latest = [F.max(F.when(good, _ordered(rows, "ingest_pos", name))).alias(f"_{name}") for name, good in usable.items()]
    folded = rows.groupBy("fingerprint").agg(
        F.min(_ordered(rows, "ingest_pos", *identity)).alias("_first"), F.count(F.lit(1)).alias("batch_rows"), *latest
    )
    return folded.select(
        "fingerprint", F.struct(*[F.col("_first")[name].alias(name) for name in identity]).alias("first"), "batch_rows",
        *[F.col(f"_{name}")[name].alias(f"good_{name}") for name in usable],
    )


def merge_postings(batch: DataFrame, store: DataFrame, now) -> DataFrame:
    """The new store plus is_new and batch_rows (null for rows not in the batch).

    The batch is folded per fingerprint before the join, so both sides are
    unique on the key.  A store that is known to be empty is not joined, and what
    comes out is still partitioned by fingerprint for the next merge.
    """
    new = fold_batch(batch).alias("new")
    if _known_empty(store):
        nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema if f.name != "fingerprint"])
        joined = new.withColumn("old", nothing)
    else:
        joined = store.alias("old").join(new, "fingerprint", "full_outer")
    at = moment(now)
    seen = F.col("new.batch_rows").isNotNull()
    known = F.col("old.scrape_count").isNotNull()
    na = F.lit(fixed.NOT_AVAILABLE)

    def latest(name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"new.good_{name}"), F.col(f"old.{name}"), default)

    values = {
        "job_url": latest("job_url", F.lit(None)),
        "company_name": F.coalesce("old.company_name", "new.first.company_name"),
        "job_role": F.coalesce("old.job_role", "new.first.job_role"),
        "number_of_people": latest("number_of_people", F.col("new.first.number_of_people")),
        "source_website": F.when(known, F.col("old.source_website")).otherwise(
            F.col("new.first.source_website")
        ),
        "first_seen_at": F.when(known, F.col("old.first_seen_at")).otherwise(at),
        "last_seen_at": F.when(seen, at).otherwise(F.col("old.last_seen_at")),
        "scrape_count": F.coalesce("old.scrape_count", F.lit(0))
        + F.coalesce("new.batch_rows", F.lit(0)),
        "posted_date": latest("posted_date", F.lit(None)),
        "published_at": latest("published_at", F.lit(None)),
        "location": latest("location", na),
        "posted_by": latest("posted_by", na),
    }
    return joined.select(
        "fingerprint",
        *[c.alias(name) for name, c in values.items()],
        F.when(seen, ~known).alias("is_new"),
        F.col("new.batch_rows").alias("batch_rows"),
    )


def upsert_postings(batch: DataFrame, store: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """`upsert_postings`: (new store, delta); the delta has one row per batch fingerprint."""
    merged = merge_postings(batch, store, now)
    names = T.StructType.fromDDL(schema.STORE).names
    delta = merged.filter(F.col("batch_rows").isNotNull())
    return merged.select(*names), delta.select(
        "fingerprint", "is_new", "first_seen_at", "batch_rows"
    )


def new_vs_existing(batch: DataFrame, store: DataFrame) -> DataFrame:
    """`new_vs_existing`: every batch row with is_new.

    New means not stored before and first of its fingerprint in the batch.  The
    first rows are found by a combined minimum and joined back on the unique
    position, so repeated postings do not pile up in one task.
    """
    rows = with_fingerprint(batch.drop("is_new"))
    first = rows.groupBy("fingerprint").agg(F.min("ingest_pos").alias("ingest_pos"))
    fresh = first.join(store.select("fingerprint"), "fingerprint", "left_anti")
    fresh = fresh.withColumn("_new", F.lit(True))
    joined = rows.join(fresh, ["fingerprint", "ingest_pos"], "left")
    return joined.select(*rows.columns, F.col("_new").isNotNull().alias("is_new"))


def upsert_profiles(batch: DataFrame, profiles: DataFrame, now) -> DataFrame:
    """`upsert_profiles`: replace the headcount, keep the old name when the new is null."""
    rows = batch.filter(F.col("company_slug") != "").withColumn(
        "company_slug", F.trim(F.lower("company_slug"))
    )
    order = F.col("ingest_pos")
    new = rows.groupBy("company_slug").agg(
        F.max_by("employee_count", order).alias("new_count"),
        F.max_by("company_name", F.when(F.col("company_name").isNotNull(), order)).alias(
            "new_name"
        ),
        F.count(F.lit(1)).alias("n"),
    )
    touched = F.col("n").isNotNull()
    return profiles.join(new, "company_slug", "full_outer").select(
        "company_slug",
        F.coalesce("new_name", "company_name").alias("company_name"),
        F.when(touched, F.col("new_count"))
        .otherwise(F.col("employee_count"))
        .alias("employee_count"),
        F.when(touched, moment(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def snapshot_path(path: str, version: int) -> str:
    return f"{path}/v={version}"


def write_snapshot(df: DataFrame, path: str, version: int, buckets: int = 0) -> str:
    """`write_snapshot`: write one version of the store; a version is never read while
    it is written, and writing it again replaces it.

    With ``buckets`` the files are bucketed and sorted by fingerprint, so the
    next merge reads the store without shuffling it.
    """
    target = snapshot_path(path, version)
    if not buckets:
        df.write.mode("overwrite").parquet(target)
        return target
    table = snapshot_table(df.sparkSession, path, version, buckets, df.schema)
    df.write.mode("overwrite").insertInto(table)
    return table


def snapshot_table(
    spark: SparkSession, path: str, version: int, buckets: int, store_schema: T.StructType
) -> str:
    """Name of the catalog table over one bucketed version, created when missing."""
    name = "store_" + "".join(c if c.isalnum() else "_" for c in snapshot_path(path, version))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store_schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {buckets} BUCKETS "
        f"LOCATION '{snapshot_path(path, version)}'"
    )
    return name


def read_snapshot(spark: SparkSession, path: str, version: int, buckets: int = 0) -> DataFrame:
    """One version of the store.

    ``buckets`` says that it was written with so many: then it is read as a bucketed table, which this session's
    catalog learns of if need be, and a merge by fingerprint does not shuffle it (with fewer buckets than
    spark.sql.shuffle.partitions, Spark prefers a shuffle).
    """
    if not buckets:
        return spark.read.schema(schema.STORE).parquet(snapshot_path(path, version))
    return spark.table(snapshot_table(spark, path, version, buckets, T.StructType.fromDDL(schema.STORE)))
