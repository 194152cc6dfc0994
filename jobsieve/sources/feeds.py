"""JSON feeds: response bodies (page_pos, body) to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobsieve import fixed, schema
from jobsieve.functions.dates import source_age_label
from jobsieve.functions.let import let
from jobsieve.functions.text import strip
from jobsieve.functions.urls import city_of_url, job_id_from_url, query_pairs

_NA = fixed.NOT_AVAILABLE


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Stored feed responses, one JSON object {page_pos, body} per line."""
    return spark.read.schema(schema.FEED_BODY).json(path)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def feed_a_postings(raw_json: DataFrame) -> DataFrame:
    """`feed_a_postings`: one row per entry of the jobs array of each response."""
    parsed = raw_json.select("page_pos", F.from_json("body", schema.FEED_A).alias("feed"))
    jobs = parsed.select("page_pos", F.posexplode("feed.jobs").alias("at", "job"))
    places = F.concat_ws(", ", "job.locationRestrictions")
    return jobs.select(
        F.struct("page_pos", F.col("at").cast("long").alias("at")).alias("ingest_pos"),
        F.col("job.companyName").alias("company_name"),
        F.col("job.title").alias("job_role"),
        F.coalesce(_filled(F.col("job.applicationLink")), "job.guid").alias("job_url"),
        F.col("job.companySlug").alias("company_slug"),
        F.col("job.pubDate").alias("published_at"),
        F.coalesce(_filled(places), F.lit("Remote")).alias("location"),
        F.col("job.categories").alias("categories"),
        F.col("job.parentCategories").alias("parent_categories"),
        F.lit(f"{fixed.FEED_A_SOURCE}.app").alias("source_website"),
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(obj: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", kind)


def _text(obj: Column, key: str) -> Column:
    """A scalar field as text, '' and JSON null as null."""
    return _filled(_field(obj, key, "string"))


def first_source_date(obj: Column, as_of) -> Column:
    """`first_source_date`: label of the first of ten date keys that is present.

    A first value that is no date is not skipped; it gives null.
    """
    first = let(_date_fields(obj), _first_date)
    return source_age_label(let(first, _date_text), as_of)


def _date_fields(obj: Column) -> Column:
    """The ten date keys of an object, read at once."""
    return F.try_variant_get(obj, "$", "struct<%s>" % ", ".join(f"{k}: variant" for k in fixed.FEED_B_DATE_KEYS))


def _first_date(dates: Column) -> Column:
    return F.coalesce(*[F.when(~F.is_variant_null(dates[k]), dates[k]) for k in fixed.FEED_B_DATE_KEYS])


def _date_text(v: Column) -> Column:
    """Strings as they are, numbers as whole seconds, null for other values."""
    text, kind = F.try_variant_get(v, "$", "string"), _kind(v)
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(kind == "STRING", text).when(number, F.regexp_replace(text, r"\..*$", ""))


def _place(item: Column) -> Column:
    named = F.coalesce(_text(item, "city"), _text(item, "name"), F.lit("None"))
    return strip(
        F.when(_kind(item).startswith("OBJECT"), named).otherwise(
            F.try_variant_get(item, "$", "string")
        )
    )


def _is_filled(item: Column) -> Column:
    empty = ("", "0", "false", "[]", "{}")
    return F.coalesce(~F.try_variant_get(item, "$", "string").isin(*empty), F.lit(False))


def _places(obj: Column, key: str, objects: bool) -> Column:
    """A location key that holds a list or a string, null when it does not apply."""
    items = _field(obj, key, "array<variant>")
    if objects:
        listed = F.transform(F.filter(items, _is_filled), _place)
        from_list = F.when(F.size(listed) > 0, F.array_join(listed, ", "))
        refused = ("", "n/a")
    else:
        texts = F.transform(items, lambda x: strip(F.try_variant_get(x, "$", "string")))
        from_list = F.when(
            F.size(items) > 0, F.array_join(F.filter(texts, lambda t: t != ""), ", ")
        )
        refused = ("",)
    value = _field(obj, key, "variant")
    from_text = F.when(_kind(value) == "STRING", strip(_text(obj, key)))
    return F.coalesce(
        from_list,
        let(from_text, lambda t: F.when(~F.lower(t).isin(*refused), t)),
    )


def location_resolve(obj: Column, url: Column) -> Column:
    """`location_resolve`: posting keys, then employer keys, then the URL city, else N/A."""
    own = [_places(obj, k, True) for k in fixed.FEED_B_LOCATION_KEYS]
    employer = [
        _places(obj, f"employer.{k}", False) for k in fixed.FEED_B_EMPLOYER_LOCATION_KEYS
    ]
    stated = let(F.coalesce(*own, *employer), lambda s: F.when(~s.isin("", _NA), s))
    return F.coalesce(stated, city_of_url(url), F.lit(_NA))


def feed_b_postings(raw_json: DataFrame, as_of) -> DataFrame:
    """`feed_b_postings`: one row per entry of the objects array of each response."""
    bodies = raw_json.select("page_pos", F.try_parse_json("body").alias("v"))
    rows = bodies.select(
        "page_pos",
        F.posexplode(F.try_variant_get("v", "$.objects", "array<variant>")).alias("at", "o"),
    )
    o = F.col("o")
    url = _text(o, "public_url")
    # the steps of first_source_date as columns, which Spark compiles and takes once
    dated = rows.withColumn("_dates", _date_fields(o)).withColumn("_date", _first_date(F.col("_dates")))
    return dated.withColumn("_date_text", _date_text(F.col("_date"))).select(
        F.struct("page_pos", F.col("at").cast("long").alias("at")).alias("ingest_pos"),
        _field(o, "employer.company_name", "string").alias("company_name"),
        F.coalesce(_text(o, "title"), _text(o, "candidate_title")).alias("job_role"),
        _field(o, "employer.employee_count", "string").alias("employee_count_raw"),
        url.alias("job_url"),
        source_age_label(F.col("_date_text"), as_of).alias("posted_date"),
        location_resolve(o, url).alias("location"),
        job_id_from_url(_text(o, "id"), url).alias("job_id"),
        F.lit(f"{fixed.FEED_B_SOURCE}.com").alias("source_website"),
    )


def feed_b_filters(urls: DataFrame, column: str = "url") -> DataFrame:
    """`feed_b_filters`: the query parameters forwarded for each feed URL.

    Offset and limit are dropped, repeated keys are joined by commas, defaults
    fill what is missing.
    """
    pairs = F.filter(query_pairs(F.col(column)), lambda p: ~p["key"].isin("offset", "limit"))
    staged = urls.withColumn("_pairs", pairs)
    keys = F.array_distinct(F.transform("_pairs", lambda p: p["key"]))
    given = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("param"),
            F.array_join(
                F.transform(
                    F.filter("_pairs", lambda p: p["key"] == k), lambda p: p["value"]
                ),
                ",",
            ).alias("value"),
        ),
    )
    staged = staged.withColumns({"_keys": keys, "_given": given})

    def default(name: str, value: str, *others: str) -> Column:
        taken = [F.array_contains("_keys", k) for k in (name, *others)]
        present = taken[0] if len(taken) == 1 else taken[0] | taken[1]
        return F.when(~present, F.struct(F.lit(name).alias("param"), F.lit(value).alias("value")))

    defaults = [default(k, v) for k, v in fixed.FEED_B_QUERY_DEFAULTS.items()]
    defaults.append(default("industry_types", fixed.FEED_B_INDUSTRY, "industry_type"))
    defaults.append(default("company_size", fixed.FEED_B_COMPANY_SIZE))
    every = F.concat("_given", F.array_compact(F.array(*defaults)))
    return staged.select(*urls.columns, F.inline(every))


def city_from_url(
    df: DataFrame, aliases: dict[str, str] | None = None, column: str = "job_url"
) -> DataFrame:
    """`city_from_url`: add the city named at the end of the URL, null when none is."""
    return df.withColumn("city", city_of_url(F.col(column), aliases))


