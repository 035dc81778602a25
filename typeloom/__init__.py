"""Type-directed search over definition corpora, on Spark.

The package's functions are pickled by value, so that executors which do not have it
installed can run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
