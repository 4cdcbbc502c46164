"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this subpackage imports it.  The Python helpers that run inside
tasks are pickled by value, so that executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
