"""Helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Stands for a null id where ids are compared or joined; it sorts before every other id.
NO_ID = -(2**63)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ids(column: pa.Array) -> np.ndarray:
    """Ids as int64 with null as :data:`NO_ID`."""
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def longs(values) -> pa.Array:
    """An int64 array from signed or unsigned 64-bit values."""
    return pa.array(np.asarray(values).view(np.int64) if getattr(values, "dtype", None) == np.uint64 else values, pa.int64())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
