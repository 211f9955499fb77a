"""Document corpus jobs on Spark: ingest, structuring, search and run analytics.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
starts a job by itself except the few helpers that say so (upsert writes,
streaming runs, pointer jumping over span trees).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
