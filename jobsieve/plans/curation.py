"""The whole run as one plan: clean, dedupe, size, complete, gate, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobsieve.functions.headcount import size_eligible
from jobsieve.functions.let import once
from jobsieve.operators.dedupe import dedupe_postings, with_clean_names
from jobsieve.operators.enrich import company_size_once, with_headcount
from jobsieve.operators.filters import valid_record
from jobsieve.sources.extract import follow_detail


def curate(raw: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Raw postings to valid, eligible, deduplicated postings.

    The order is part of the result: duplicates go before validation and before
    the size gate.  With ``pages``, incomplete rows are completed from detail
    pages and missing headcounts from company pages.
    """
    rows = with_headcount(dedupe_postings(with_clean_names(raw)))
    if pages is not None:
        rows = company_size_once(follow_detail(rows, pages), pages)
    # the gate and the validation read one parsed headcount
    sized = once(rows, number_of_people=F.col("number_of_people"))
    return valid_record(sized.filter(size_eligible(F.col("number_of_people"))))
