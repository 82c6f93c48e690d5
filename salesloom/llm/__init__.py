"""Operators of a training-data pipeline; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions go to the workers with their code, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
