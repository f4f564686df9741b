"""Operations of a large-scale training-data pipeline, as DataFrame operators.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator.
"""

import sys

from pyspark import cloudpickle

# Tasks get this subpackage's functions by value: executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
