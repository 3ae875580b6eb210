"""Operators for training-data pipelines: scoring, filtering, deduplication, counting, packing and search over text corpora.

Nothing else in the library imports this subpackage. Its Python functions travel with the task, so executors need no install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
