"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# What tasks need of this package travels with them, so executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
