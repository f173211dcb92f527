"""Training-data operators.

Nothing outside this package imports it.  Its functions run inside Python
workers, so they are pickled by value: an executor needs no copy of the
repository on its own path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
