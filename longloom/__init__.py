"""Long-document corpus preparation and evaluation on Spark."""

import sys as _sys

__version__ = "0.1.0"

# Python UDFs defined in this package (ROUGE-L, the tokenizer adapter) are shipped to the
# workers by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: workers then need the package installed
    pass
