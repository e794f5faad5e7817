"""The transaction log as a stream: frames arrive as files, state and receipts are kept exactly once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.operators.change_log import ChangeLog

FRAME_SCHEMA = "store_id string, epoch_id string, tx_id decimal(38,0), base struct<epoch:string,tx:decimal(38,0),digest:string>, mutation_id string, intent_digest string, ops array<struct<type:string,version:string,payload:string>>, received_at timestamp_ntz"


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Frames from Parquet files that appear below ``path``, a bounded number of files a step."""
    return spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


@dataclass
class StreamingReplay:
    """Appends every micro-batch to a change log as one run.

    The log's manifest holds the number of the last batch beside its runs, published by one rename, so a batch given again after a failure
    or a restart is skipped. After a restart give it ``ChangeLog.open`` of the same root with the same checkpoint.
    """

    log: ChangeLog

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.log.append(batch, batch_id)

    def start(self, frames: DataFrame, checkpoint: str) -> StreamingQuery:
        return frames.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_watch(frames: DataFrame) -> DataFrame:
    """``store_id, tx_id, status`` per frame, keeping the last transaction of each store as state.

    In order it is ``next``; a frame at or below the last is ``again``; one further ahead is ``gap`` and becomes the last.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tx = pd.concat(list(parts))["tx_id"].map(int).sort_values(ignore_index=True)  # whole numbers of any length
        first = int(state.get[0]) if state.exists else tx[0] - 1
        before = tx.shift(1, fill_value=first).map(lambda x: max(x, first))
        status = (tx - before).map(lambda ahead: "next" if ahead == 1 else "again" if ahead < 1 else "gap")
        state.update((str(max(first, tx.iloc[-1])),))
        yield pd.DataFrame({"store_id": key[0], "tx_id": tx.map(str), "status": status})

    return frames.select("store_id", F.col("tx_id").cast("string").alias("tx_id")).groupBy("store_id").applyInPandasWithState(step, "store_id string, tx_id string, status string", "last string", "append", GroupStateTimeout.NoTimeout)
