"""tokenmill: corpus preparation for language-model training as Spark jobs."""

import sys as _sys

try:  # ship our functions to Python workers by value: no install needed on executors
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
