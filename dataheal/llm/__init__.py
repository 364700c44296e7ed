"""Operators for large training-data corpora; nothing else in the library imports them.

Functions for Python workers are sent by value, so executors need no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules["dataheal"])
