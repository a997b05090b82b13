"""Spark-native network traffic analytics."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of its modules travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
