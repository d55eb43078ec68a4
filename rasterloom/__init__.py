"""Raster stack analytics on Spark: frames, planes and pixels as relations."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with their code, so executors need no copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])
