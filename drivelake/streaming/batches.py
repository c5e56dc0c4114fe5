"""Rows of Arrow batches as Python values, for folds that take them one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def values(column: pa.Array) -> list:
    """What to_pylist gives, made by the column where it can be: numbers through numpy, each different text once."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind):
        d = column.dictionary_encode()
        texts = [*d.dictionary.to_pylist(), None]
        return [texts[i] for i in d.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False).tolist()]
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_pylist()
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[i] = None
    return out


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*map(values, batch.columns))
