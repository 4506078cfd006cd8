"""Rollbook: a school-records engine on Spark DataFrames.

Listings, lookups, change feeds and record jobs over five tables (class, teacher, student, course,
score), each computed for all keys of a table in one distributed job.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel to the executors by value: a cluster needs no copy of the package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
