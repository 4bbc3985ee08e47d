"""tamiz: counterparty-risk segmentation as Spark jobs.

Layers: ``sources`` read raw files, ``functions`` are column expressions,
``operators`` are DataFrame transforms and fits, ``plans`` chain them from raw
tables to features and models, ``catalog`` runs them on the shared test tables.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Task code of this package travels inside the task, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
