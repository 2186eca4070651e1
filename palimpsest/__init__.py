"""Versioned documents and ledgers as Spark DataFrames.

Functions travel to the Python workers by value, so executors need only PySpark
and the public libraries, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
