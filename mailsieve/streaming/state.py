"""Starting streams whose state the engine keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stateful stream to a folder of Parquet files, exactly once, until its input is used up.

    State handlers need the RocksDB store; the session's own choice is put back once the query runs.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return stream.writeStream.format("parquet").outputMode("append").option("path", out) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
