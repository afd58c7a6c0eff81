"""corpusmill: a Spark-first engine for cited text corpora (ingest, retrieve, verify)."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so that nothing
# needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
