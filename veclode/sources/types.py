"""Arrow and NumPy types that Spark lacks, widened without loss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..errors import BAD_RANK, NOT_ARRAY, bad_dtype

#: Arrow types and what holds all their values.
WIDER = {
    pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0),
    pa.float16(): pa.float32(), pa.date64(): pa.date32(), pa.large_string(): pa.string(), pa.large_binary(): pa.binary(),
}
#: NumPy dtypes of vectors.
VECTOR_DTYPES = ("float16", "float32", "float64", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "bool")


def wider(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_dictionary(kind):
        return wider(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(wider(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, wider(f.type), f.nullable) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(wider(kind.key_type), wider(kind.item_type))
    return WIDER.get(kind, kind)


def widen(table: pa.Table) -> pa.Table:
    """The table with every column in a type that Spark reads."""
    return table.cast(pa.schema([pa.field(f.name, wider(f.type), f.nullable) for f in table.schema]))


def vector_array(array: np.ndarray) -> tuple[pa.Array, list[int], str]:
    """An Arrow list (2-D) or list of lists (3-D) of the rows, the shape and the dtype's name."""
    if not isinstance(array, np.ndarray):
        raise ValueError(NOT_ARRAY)
    if array.dtype.name not in VECTOR_DTYPES:
        raise bad_dtype(array.dtype.str)
    if array.ndim not in (2, 3):
        raise ValueError(BAD_RANK)
    flat = pa.array(np.ascontiguousarray(array).ravel())
    flat = flat.cast(wider(flat.type))
    for size in array.shape[:0:-1]:
        n = len(flat) // size if size else int(np.prod(array.shape[:-1]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), flat)
    return flat, list(array.shape), array.dtype.name
