"""Row-local operators on a stream: scoring, range check, point-in-time rule, action.

Ranks and budgets need the whole batch and stay out of the stream; every operator here is the
batch operator, applied to a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from linetriage.operators import derive, queue, rules


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def score_stream(
    rows: DataFrame, weights: DataFrame, bounds: DataFrame, features: Sequence[str], unvalidated: Sequence[str]
) -> DataFrame:
    """Score, out-of-range count and action for each arriving row (stream-static broadcast joins)."""
    ranged = derive.out_of_range(derive.linear_score(rows, weights, features), bounds, features)
    return ranged.withColumn("action", queue.route_action(unvalidated))


def check_arrival(rows: DataFrame, present: Sequence[str] = ()) -> DataFrame:
    return rules.available_in_time(rows, "cutoff", "ended", "available", present)


def write_once(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Process what has arrived, exactly once, and stop; the same checkpoint continues after a failure."""
    done = (
        stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    done.awaitTermination()


