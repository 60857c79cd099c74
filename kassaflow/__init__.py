"""Kassaflow: point-of-sale analytics and training-data preparation on Spark.

Everything is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function;
plans are declared and Catalyst picks the physical strategy.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
