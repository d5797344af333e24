"""corpusloom: text-corpus analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in tasks by value, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
