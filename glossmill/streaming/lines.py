"""Identification over a stream of messages: stateless, one message at a time.

The classifier's distributions of a stream's words can't be joined by distinct word as in a batch, so a
micro-batch goes through the batch plan. The language share over event time is an addition of this engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossmill.functions import text as tx
from glossmill.operators.identify import Identifier


def identify_stream(messages: DataFrame, key: str, text: str, identifier: Identifier, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (key, text) identified as a batch would be, and handed to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(identifier.identify(batch, key, text), number)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_stream(messages: DataFrame, text: str, *keep: str) -> DataFrame:
    """Tokens and kinds of each message; a plain projection, so it works on any stream."""
    return tx.token_kinds(messages, text, *keep)


def kind_share(messages: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Tokens by kind in windows of event time; what is later than ``late`` is left out."""
    tokens = tx.token_kinds(messages.withWatermark(time, late), text, time)
    return tokens.groupBy(F.window(time, window), "kind").agg(F.count("*").alias("n"))
