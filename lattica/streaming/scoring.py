"""Scoring streams. A single-pass prediction is row-local, so a streaming DataFrame takes it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lattica.plans.network import Network


def score_stream(stream: DataFrame, network: Network) -> DataFrame:
    """The stream with predictions; iterative prediction settles on a whole batch and is refused."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    if network.config.mode != "single":
        raise ValueError("iterative prediction needs a whole batch")
    return network.predict(stream)


def write_scored(stream: DataFrame, network: Network, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the scored stream as Parquet; start() it."""
    return score_stream(stream, network).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
