"""Structured Streaming forms of ingest, dedupe, upsert, progress and profile refresh."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from jobsieve import schema
from jobsieve.functions.headcount import profile_size_from_text, size_eligible, size_unspecified
from jobsieve.functions.text import normalize_key
from jobsieve.operators.dedupe import with_clean_names, with_dedupe_key
from jobsieve.operators.enrich import missing_profiles
from jobsieve.operators.filters import with_validity
from jobsieve.operators.spread import first_by
from jobsieve.operators.store import upsert_profiles, with_fingerprint
from jobsieve.streaming.deltas import Turn, bucket_of, kept_log, known_fingerprints

RECENT = 25  # rows that a progress snapshot shows
_COUNTERS = (
    "pages_processed", "jobs_discovered", "jobs_processed", "companies_discovered", "duplicates_removed",
    "missing_employee_counts", "new_jobs_added", "existing_jobs_seen",
)
_RECENT = "array<struct<ingest_pos:bigint,company_name:string,job_role:string,number_of_people:string,is_new:boolean>>"
_PROGRESS = ", ".join(f"{name} bigint" for name in _COUNTERS) + f", recent_jobs {_RECENT}, batch bigint"
_FLAGS = "copies bigint, is_known boolean, is_eligible boolean, is_valid boolean"
_VERSIONS = "run_id string, batch_id bigint, version int"


def stream_ingest(
    spark: SparkSession,
    folder: str,
    stream_schema: str = schema.FEED_BODY,
    files_per_batch: int = 100,
    file_format: str = "json",
    **options: str,
) -> DataFrame:
    """`stream_ingest`: stored feed pages, a bounded number of files per micro-batch."""
    reader = spark.readStream.schema(stream_schema).format(file_format)
    return reader.option("maxFilesPerTrigger", files_per_batch).options(**options).load(folder)


def stream_dedupe(
    df: DataFrame, order: str = "ingest_pos", event_time: str | None = None, horizon: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """`stream_dedupe`: the first arrival of each posting key, for a sink that takes updates.

    The state is one row per key, the one with the smallest ``order`` so far, kept by Spark's state store; many
    copies of a key are reduced in the tasks that read them.  A batch hands out the keys that it touched, so a
    row that arrives late but belongs before is handed out in place of the earlier one; `settled` takes
    the last word of each key.  Without an event time, the keys of a whole run are remembered, as
    one run of the crawler does.  With one, a key counts once per ``horizon``, and the state of a horizon goes
    when the watermark has passed it.
    """
    keyed = with_dedupe_key(df)
    if event_time is not None:
        keyed = keyed.withWatermark(event_time, delay)
        grouped = keyed.groupBy("dedupe_key", F.window(event_time, horizon).alias("_span"))
    else:
        grouped = keyed.groupBy("dedupe_key")
    rest = [c for c in keyed.columns if c != "dedupe_key"]
    best = grouped.agg(F.min_by(F.struct(*rest), order).alias("_row"))
    extra = [F.col("_span.start").alias("horizon")] if event_time is not None else []
    return best.select("dedupe_key", *extra, "_row.*")


def emitted_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps what each batch hands out; a replayed batch replaces its own rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def settled(emitted: DataFrame, order: str = "ingest_pos") -> DataFrame:
    """The rows of `stream_dedupe` after all batches: the smallest arrival of each key (and horizon)."""
    rows = emitted.drop("batch")
    return first_by(rows, [c for c in ("dedupe_key", "horizon") if c in rows.columns], order)


def _run_folder(path: str, kind: str, run_id: str) -> str:
    return f"{path}/{kind}/{hashlib.sha256(run_id.encode()).hexdigest()[:16]}"


def _arrivals(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row per posting key of a batch, with the number of its copies, whether an earlier batch of the run
    had the key, and what becomes of the row."""
    keyed = with_dedupe_key(with_clean_names(batch))
    rest = [c for c in keyed.columns if c != "dedupe_key"]
    first = keyed.groupBy("dedupe_key").agg(
        F.min_by(F.struct(*rest), "ingest_pos").alias("_row"), F.count(F.lit(1)).alias("copies")
    )
    seen = earlier.where("not is_known").select("dedupe_key", F.lit(True).alias("_seen"))  # each key once
    rows = first.select("dedupe_key", "copies", "_row.*").join(seen, "dedupe_key", "left")
    rows = rows.withColumn("is_known", F.col("_seen").isNotNull()).drop("_seen")
    return with_validity(rows.withColumn("is_eligible", size_eligible(F.col("number_of_people"))))


def _snapshot(turn: Turn, pages: DataFrame | None, arrivals: DataFrame, earlier: DataFrame, before: dict) -> dict:
    """The counters after a batch, and the run's last RECENT rows."""
    spark = arrivals.sparkSession
    first = arrivals.where("not is_known")
    processed = with_fingerprint(first.where("is_eligible and is_valid")).select(
        "ingest_pos", "company_name", "job_role", "number_of_people", "fingerprint", normalize_key(F.col("company_name")).alias("company")
    )
    buckets = [r[0] for r in processed.select(bucket_of("fingerprint")).distinct().collect()]
    known = known_fingerprints(spark, turn.path, turn.version - 1, buckets).distinct()
    # the first row of a fingerprint that the store does not hold is new
    firsts = processed.groupBy("fingerprint").agg(F.min("ingest_pos").alias("ingest_pos")).join(known, "fingerprint", "left_anti")
    fresh = processed.join(firsts.select("ingest_pos", F.lit(True).alias("is_new")), "ingest_pos", "left")
    flagged = fresh.withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    rows = flagged.orderBy(F.desc("ingest_pos")).limit(RECENT).drop("fingerprint", "company").collect()
    done = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("new")).first()
    old = earlier.where("not is_known and is_eligible and is_valid").select(normalize_key(F.col("company_name")).alias("company"))
    companies = processed.select("company").distinct().join(old.distinct(), "company", "left_anti").count()
    counts = arrivals.agg(
        F.sum("copies").alias("rows"), F.count_if(~F.col("is_known")).alias("first"),
        F.count_if(~F.col("is_known") & F.col("is_eligible") & size_unspecified(F.col("number_of_people"))).alias("missing"),
    ).first()
    found = counts["rows"] or 0
    added = {
        "pages_processed": pages.count() if pages is not None else 0, "jobs_discovered": found, "jobs_processed": done["n"],
        "companies_discovered": companies, "duplicates_removed": found - counts["first"],
        "missing_employee_counts": counts["missing"], "new_jobs_added": done["new"], "existing_jobs_seen": done["n"] - done["new"],
    }
    total = {name: before.get(name, 0) + n for name, n in added.items()}
    return {**total, "recent_jobs": [*before.get("recent_jobs", []), *reversed(rows)][-RECENT:]}


def upsert_batch(
    path: str, now: Callable[[int], str], run_id: str = "run", progress: bool = False, page: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch to the store at ``path`` as the next version.

    The store outlives runs: versions go on from what the path holds.  A posting counts once in a
    run, whatever the batches: the first arrivals of each batch are kept by run and batch, and only the keys of
    the same run's earlier batches are read.  A replayed batch writes its own files and version again.

    With ``progress`` a row of counters is kept per batch, see `stream_progress`; ``page`` names the column
    that tells pages apart.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        turn = Turn(spark, path, run_id, batch_id)
        folder = _run_folder(path, "arrivals", run_id)
        own = f"{folder}/batch={batch_id}"
        keyed = T.StructType([*with_dedupe_key(with_clean_names(batch)).schema, *T.StructType.fromDDL(_FLAGS)])
        earlier = kept_log(spark, folder, keyed.add("batch", "long")).where(F.col("batch") < batch_id)
        _arrivals(batch, earlier).select(*[f.name for f in keyed if f.name != "batch"]).write.mode("overwrite").parquet(own)
        arrivals = spark.read.parquet(own)
        if progress:
            _write_progress(turn, batch, batch_id, page, arrivals, earlier)
        kept = arrivals.where("not is_known and is_eligible and is_valid").select(*batch.columns)
        turn.add(kept, now(batch_id))

    return run


def _write_progress(turn: Turn, batch: DataFrame, batch_id: int, page: str | None, arrivals: DataFrame, earlier: DataFrame) -> None:
    spark, folder = batch.sparkSession, _run_folder(turn.path, "progress", turn.run_id)
    row = kept_log(spark, folder, _PROGRESS).where(F.col("batch") < batch_id).orderBy(F.desc("batch")).first()
    pages = None
    if page is not None:
        seen, own = _run_folder(turn.path, "pages", turn.run_id), batch.select(F.col(page).cast("string").alias("page")).distinct()
        before = kept_log(spark, seen, "page string, batch bigint").where(F.col("batch") < batch_id).select("page")
        own.join(before, "page", "left_anti").write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
        pages = spark.read.parquet(f"{seen}/batch={batch_id}")
    state = _snapshot(turn, pages, arrivals, earlier, row.asDict() if row else {})
    line = tuple(state[name] for name in (*_COUNTERS, "recent_jobs"))
    spark.createDataFrame([line], _PROGRESS.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stream_upsert(df: DataFrame, path: str, checkpoint: str, now: Callable[[int], str]) -> StreamingQuery:
    """`stream_upsert`: new-versus-seen state across runs, one store version per batch."""
    return _started(df, upsert_batch(path, now, run_id=checkpoint), checkpoint)


def stream_progress(
    df: DataFrame, path: str, checkpoint: str, now: Callable[[int], str], page: str | None = None
) -> StreamingQuery:
    """`stream_progress`: an upsert that also logs, after each batch, the run's counters so far and its last rows.

    Counted are pages, rows found, rows processed (first arrivals that pass the size gate and validation),
    companies of these, duplicates, missing headcounts among eligible first arrivals, and processed
    rows that the store did not or did hold.  All are exact; read them with `progress_log`.
    """
    return _started(df, upsert_batch(path, now, run_id=checkpoint, progress=True, page=page), checkpoint)


def _started(df: DataFrame, batches: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(batches).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def progress_log(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One row per finished batch of a run: the counters, recent_jobs and batch."""
    return kept_log(spark, _run_folder(path, "progress", run_id), _PROGRESS)


def observed(df: DataFrame, name: str = "progress") -> DataFrame:
    """Attach live counters of the rows that pass; a `LiveProgress` listener receives them."""
    return df.observe(
        name, F.count(F.lit(1)).alias("jobs_discovered"), F.count_if(size_unspecified(F.col("number_of_people"))).alias("missing_employee_counts")
    )


class LiveProgress(StreamingQueryListener):
    """Keeps the observed counters of the last RECENT micro-batches of all queries of a session."""

    def __init__(self, name: str = "progress"):
        self.name, self.log = name, deque(maxlen=RECENT)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.log.append({"batch_id": event.progress.batchId, **seen.asDict()})

    def onQueryTerminated(self, event) -> None:
        pass


def _turn(spark: SparkSession, path: str, run_id: str, batch_id: int) -> int:
    """The version of the profiles that a batch writes: the one it wrote before, else one after the latest."""
    done = kept_log(spark, f"{path}/log", _VERSIONS)
    own = (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)
    mine, latest = done.agg(F.max(F.when(own, F.col("version"))), F.max("version")).first()
    return mine or (latest or 0) + 1


def latest_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profiles after the latest finished batch."""
    version = kept_log(spark, f"{path}/log", _VERSIONS).agg(F.max("version")).first()[0]
    return spark.read.schema(schema.PROFILES).parquet(f"{path}/v={version}") if version else spark.createDataFrame([], schema.PROFILES)


def refresh_batch(
    texts: DataFrame, path: str, now: Callable[[int], str], run_id: str = "run"
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that resolves the sizes of slugs without a profile.

    Slugs whose text says nothing are stored as N/A, so they are not asked again.  Versions go on
    from what the path holds, as in `upsert_batch`.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = _turn(spark, path, run_id, batch_id)
        profiles = (
            spark.read.schema(schema.PROFILES).parquet(f"{path}/v={version - 1}")
            if version > 1
            else spark.createDataFrame([], schema.PROFILES)
        )
        named = batch.groupBy("company_slug").agg(
            F.min("company_name").alias("company_name"), F.min("ingest_pos").alias("ingest_pos")
        )
        unseen = missing_profiles(batch, profiles)
        found = (
            named.join(unseen, "company_slug")
            .join(texts.select("company_slug", "text"), "company_slug", "left")
            .select(
                "company_slug",
                "company_name",
                "ingest_pos",
                profile_size_from_text(F.coalesce("text", F.lit(""))).alias("employee_count"),
            )
        )
        merged = upsert_profiles(found, profiles, now(batch_id))
        merged.write.mode("overwrite").parquet(f"{path}/v={version}")
        row = spark.createDataFrame([(run_id, batch_id, version)], _VERSIONS)
        row.coalesce(1).write.mode("append").parquet(f"{path}/log")

    return run


def profile_refresh(
    df: DataFrame, texts: DataFrame, path: str, checkpoint: str, now: Callable[[int], str]
) -> StreamingQuery:
    """`profile_refresh`: keep the company profiles complete for a stream of postings."""
    return (
        df.writeStream.foreachBatch(refresh_batch(texts, path, now, run_id=checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
