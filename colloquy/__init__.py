"""Conversation-evaluation analytics on Spark DataFrames.

Functions of this package travel to the executors by value, so it needn't be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
