"""Siltstone: a PySpark-native engine for knowledge retrieval and code-structure analytics."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with their code: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
