"""Operators of a training-data pipeline: mixing, formatting, deduplication, scoring and scans."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this subpackage with their tasks; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
