"""State that outlives a task: loaded models and caches of a Python worker.

Functions of this package travel to the workers by value, so their module globals are rebuilt for
every task.  A module registered once per worker process keeps what is costly to build.

Spark bounds an Arrow batch in rows, not in bytes; :func:`arrow_parts` cuts it, so that what a function
builds for a batch does not grow with the texts.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator


def worker_state() -> dict:
    mod = sys.modules.get("_longloom_worker")
    if mod is None:
        mod = sys.modules["_longloom_worker"] = types.ModuleType("_longloom_worker")
        mod.state = {}
    return mod.state


PART_BYTES = 1 << 20


def arrow_parts(batches: Iterable, limit: int = PART_BYTES) -> Iterator:
    """Text or list arrays in slices of about ``limit`` bytes (of list items); never less than a row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    for a in batches:
        text = pa.types.is_string(a.type) or pa.types.is_large_string(a.type)
        size = pc.fill_null(pc.binary_length(a) if text else pc.list_value_length(a), 0)
        end = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(a):
            done = int(end[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, done + limit, side="right")))
            yield a.slice(lo, hi - lo)
            lo = hi
