"""Streaming ingest: rows of a stream are placed in clusters and appended, a micro-batch at a time.

Each micro-batch is written to a folder of its own by its number, overwritten if
the batch is run again, so every row is stored once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectide.operators.assign import assign


def ingest(stream: DataFrame, centroids: np.ndarray, path: str, checkpoint: str, v: str = "embedding") -> StreamingQuery:
    """Start placing the stream's rows; they appear under path/batch=<n>, partitioned by cluster_id."""

    def place(batch: DataFrame, number: int) -> None:
        assign(batch, np.arange(len(centroids)), centroids, v).write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
