"""Filigrane: a PySpark-native engine for catalogues of hierarchical records."""

from pyspark import cloudpickle

# Worker functions travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
