"""Literature screening and evidence synthesis as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so a job needs no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
