"""Tabwright: profile, prepare, segment and explain tabular data as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so that executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
