"""Audience measurement on Spark: fingerprint matching, viewership, segments, reports, privacy."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the tasks, so workers
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
