"""Behavioural analytics over access-event tables and streams, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Grouped functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
