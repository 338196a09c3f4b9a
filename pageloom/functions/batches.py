"""Arrow batches in parts, so that a worker's memory does not follow the session's batch size."""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Bytes of text, and words of word lists, that are Python objects at one time.
PART_BYTES = 1 << 20
PART_WORDS = 1 << 16


def parts(batch: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Consecutive slices of a batch of texts or lists, each of at most ``most`` bytes or items.

    A longer row is a slice of its own.  A batch may hold any number of rows and bytes; what
    is built from it row by row, many times its size, is built and sent on slice by slice.
    """
    of_lists = pa.types.is_list(batch.type) or pa.types.is_large_list(batch.type)
    most = most or (PART_WORDS if of_lists else PART_BYTES)
    sizes = pc.list_value_length(batch) if of_lists else pc.binary_length(batch)
    # an empty row is an object too
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype("int64") + 1)
    start = done = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


# Ship this helper with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
