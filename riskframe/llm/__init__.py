"""Operators of a training-data pipeline over documents, embeddings and labels."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package.  Functions and
# classes of its modules do; modules and broadcasts name their module and must not be in it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
