"""rollscope: rolled job logs and application listings as Spark tables.

The library answers byte-range requests over rolled (optionally gzipped) log
files, filters application listings by tenant / status / time range, audits
tenant visibility and rewrites executor log links -- all as DataFrame plans
that Catalyst optimises and Spark executes in bulk.
"""

import sys as _sys

# Ship this package's functions to Python workers by value: tasks that call
# them (gunzip / range readers inside mapInPandas) then work on executors
# where the package is not installed or not on the path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: the package must be importable
    pass

from rollscope.session import build_session, shared_dir  # noqa: E402

__all__ = ["build_session", "shared_dir"]
