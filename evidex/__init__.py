"""A PySpark-native engine for document retrieval, metric analysis and training-data preparation."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
