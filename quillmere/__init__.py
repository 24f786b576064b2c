"""Quillmere: document and retrieval analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to tasks travel with their code, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
