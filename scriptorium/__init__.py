"""Scholarly, news, page-view and activity analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is computed until
the caller runs an action.  Sub-packages:

``functions``  column expressions (text, calendar, vectors) and SQL registration
``sources``    scans, file selection, sinks, manifests
``operators``  reshaping, duplicate removal, joins, aggregates, windows, matching
``plans``      compositions of operators and the adapters for the driver tables
``streaming``  the same operators as Structured Streaming jobs
``catalog``    the registered queries and their reference SQL
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the task, so executors need no
# installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
