"""Arrow helpers: walk a partition sorted by some keys in batches of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65_536) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups with the offsets at which groups begin.

    The partition must be sorted by ``keys`` (non-null longs or ints). A table
    holds about ``rows`` rows, or one group where a group is larger.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield table.slice(0, cut), starts[:-1]
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
