"""Arrow helpers shared by the batch functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokens_of(nested: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of list<list<string>> in reading order, and the row of each; null
    rows, null inner lists and null tokens give nothing."""
    inner = pc.list_flatten(nested)
    words = pc.list_flatten(inner)
    row = np.asarray(pc.list_parent_indices(nested))[np.asarray(pc.list_parent_indices(inner))]
    if words.null_count:
        there = pc.is_valid(words)
        words, row = words.filter(there), row[np.asarray(there)]
    return words, row.astype(np.int64)
