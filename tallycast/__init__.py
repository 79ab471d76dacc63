"""tallycast: forecasting and back-testing of daily event counts on Spark.

Raw event records become a gap-aware (entity x day) panel; features, baselines,
models, ensembles, scores and alerts are DataFrame -> DataFrame functions over it.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel by value, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
