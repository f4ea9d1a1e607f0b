"""wayfarer: web-journey analytics as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (tree growing, batch scoring, MMR,
# user hooks) are shipped with the task instead of being imported there, so
# executors need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler without the hook
    pass
