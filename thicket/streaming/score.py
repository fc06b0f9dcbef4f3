"""Scoring a stream of samples with a forest that was fitted in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from thicket.functions.numeric import DropMode
from thicket.operators.predict import predict


def score_stream(stream: DataFrame, nodes: DataFrame, path: str, checkpoint: str, policy: str = "branch", weighing: str = "gain", mode: DropMode = DropMode.ZEROS, **trigger) -> StreamingQuery:
    """Predict each micro-batch of ``sample_id, feature, value`` and write it under ``path``.

    A sample's cells must arrive in one micro-batch. A batch that is run again after a
    failure replaces its own output, so each sample is written once.
    """
    nodes = nodes.checkpoint()

    def one(batch: DataFrame, number: int) -> None:
        predict(nodes, batch, policy, "arithmetic", weighing, mode).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
