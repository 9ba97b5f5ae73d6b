"""Training-data operators: each module is one operator, ``queries`` registers them.

Nothing outside this package imports it.  Functions that run inside Spark's Python
tasks are shipped by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
