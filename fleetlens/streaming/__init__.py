"""Structured Streaming versions of the periodic statistics (T6) and the
lifecycle monitor (T5)."""

import sys

from pyspark import cloudpickle

# What a stateful processor needs of this package travels with it.  Spark also loads it in a Python process on the
# driver that sees neither --py-files nor this process's sys.path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
