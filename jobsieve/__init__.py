"""Postings curation on Spark: extract, clean, dedupe, validate, upsert, enrich, classify, route."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers travel with their tasks, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
