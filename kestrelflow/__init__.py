"""Kestrelflow: telemetry analytics and corpus preparation as PySpark DataFrame jobs.

Functions of this package that run inside Spark tasks are pickled by value, so executors need
numpy, pandas and pyarrow but no copy of the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
