"""Runs of rows with equal keys inside the sorted partition of a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, keys: list[str]):
    """(key, rows as one record batch) for each run of equal keys; a run may go on over several batches.

    Only one run is held at a time, so callers bound a run's rows by the keys they choose.
    """
    held, where = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(change), batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(c[a] for c in columns)
            if here != where and held:
                yield where, _joined(held)
                held = []
            where = here
            held.append(batch.slice(a, b - a))
    if held:
        yield where, _joined(held)


def _joined(batches: list) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
