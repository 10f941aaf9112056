"""Lectern: structure-safe correction of OCR transcriptions on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
