"""Which requests are done and which are known to be empty, learnt from answers as they arrive.

The ledger is kept as streaming state: each (unit, part) remembers how often it answered, its rows and its failures. A new
answer updates it, and what has changed is appended to a table together with the batch's number. The state lives in the
stream's checkpoint, so a run that is stopped goes on where it was; a batch that is written twice gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEDGER = "unit string, part string, asked long, rows long, failures long, state string"


def _learn(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    asked, rows, failures = state.get if state.exists else (0, 0, 0)
    for f in frames:
        asked, rows, failures = asked + len(f), rows + int(f["n"].fillna(0).clip(lower=0).sum()), failures + int(f["n"].isna().sum())
    state.update((asked, rows, failures))
    known = "done" if rows else "empty" if asked > failures else "failed"
    yield pd.DataFrame({"unit": [key[0]], "part": [key[1]], "asked": [asked], "rows": [rows], "failures": [failures], "state": [known]})


def follow(answers: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Take in all answers that are there. answers: a stream of unit, part, n (rows of the answer; null: it failed).

    A unit's part is done once an answer had rows, empty if it was answered without any, and failed, hence to be asked
    again, if it was never answered.
    """
    keyed = answers.select(F.coalesce(F.col("unit").cast("string"), F.lit("")).alias("unit"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.col("n").cast("double"))
    changes = keyed.groupBy("unit", "part").applyInPandasWithState(_learn, LEDGER, "asked long, rows long, failures long", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, table: str) -> DataFrame:
    """unit, part, asked, rows, failures, state: the last word on each."""
    rows = spark.read.schema(f"{LEDGER}, batch int").parquet(table)
    last = F.max_by(F.struct("asked", "rows", "failures", "state"), "batch").alias("x")
    return rows.groupBy("unit", "part").agg(last).select("unit", "part", "x.*")


def to_ask(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests (unit, part) that the ledger does not know as done or empty."""
    settled = ledger.where("state <> 'failed'").select("unit", "part")
    return requests.join(settled, ["unit", "part"], "left_anti")
