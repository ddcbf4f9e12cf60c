"""Arrow batches of texts: rows and bytes that go to Python at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of an Arrow batch: some 7 MB of documents; and its bytes, beyond one row, where texts are long.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small, so that a worker's memory does not follow the size of its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Rows, and bytes of text, that an operator works on at a time; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def slices(batch: pa.RecordBatch, column: str | int = "text", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that memory follows a slice and not how long the texts of a batch are."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        before = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(size, before + SLICE_BYTES, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi
