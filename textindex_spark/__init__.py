"""Text compression, succinct indexing and ordered-key search as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers with their code: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
