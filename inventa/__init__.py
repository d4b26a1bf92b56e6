"""inventa — tenant-inventory analytics on Spark (DataFrame / SQL / Structured Streaming)."""

import sys as _sys

__version__ = "0.1.0"

# The few Python functions that run in executors (mapInPandas enrichment,
# manifest parsing, the streaming result reducer) are shipped by value, so
# executors need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 — older cloudpickle: the package must then be on the executors' path
    pass
