"""Arrow batches in parts of bounded size, so that what a task makes of them at once does not grow with its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a part, unless one row has more.
PART_BYTES = 1 << 20


def short_batches(spark) -> None:
    """Rows are texts: a session that says nothing of its batches gets short ones."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
        spark.conf.set(BATCH_BYTES, "8m")


def parts(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of about most bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, max(batch.num_rows, 1), step):
            part = batch.slice(at, step)
            if part.num_rows > 1 and part.nbytes > 2 * most:  # rows of very unlike sizes
                half = part.num_rows // 2
                yield from parts(iter([part.slice(0, half), part.slice(half)]), most)
            else:
                yield part
