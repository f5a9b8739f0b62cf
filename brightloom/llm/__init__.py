"""Operators for preparing large text corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks carry this subpackage's code with them, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
