"""Functions of a column of texts that hold a slice of a batch as Python objects, and not the whole batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows and bytes of a slice, about.
ROWS, BYTES = 1024, 1 << 20


def by_slices(compute: Callable[[], Callable[[list], list]], kind: DataType, out: pa.DataType):
    """A column function: `compute` gives, once for each batch, a function from a list of values to the list of its results."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        each = compute()
        n = len(values)
        step = max(1, min(ROWS, n * BYTES // max(values.nbytes, 1)))
        parts = [pa.array(each(values.slice(at, step).to_pylist()), out) for at in range(0, n, step)]
        return pa.concat_arrays(parts) if parts else pa.array([], out)

    return run
