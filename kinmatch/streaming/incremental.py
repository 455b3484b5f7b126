"""An extension: linking a stream of new anchors against a static set of targets.

Each micro-batch is blocked against the targets' keys, which are made once. Votes need no state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking
from ..operators.records import normalise


def link_stream(anchors: DataFrame, target_keys: DataFrame, out: str, checkpoint: str, config: blocking.BlockingConfig = blocking.BlockingConfig()) -> StreamingQuery:
    """anchors: a stream of raw S1 records with `source`; target_keys: blocking_keys() of the targets. Candidates go to `out` by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        keys = blocking.blocking_keys(normalise(rows), config.same_country).unionByName(target_keys)
        pairs = blocking.top_candidates(blocking.votes(keys, config.max_bucket), config.max_cand)
        pairs.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces its own output

    return anchors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
