"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
