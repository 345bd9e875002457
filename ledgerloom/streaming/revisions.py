"""Revisions of contents as a stream: a state for each content, so an intake only reads what is new.

The state is the last signature, its place in the order, and how many revisions there were. A row whose signature differs
from the state's is a revision; one that isn't later than the state's place is told as late and changes nothing. With an
idle limit, a content's state goes when nothing came for so long; what comes after that begins anew at revision 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REVISION, LATE = "revision", "late"
STATE = "signature string, place long, revisions long"
OUT = "content string, place long, signature string, revision long, status string"
#: States are kept in a store that spills to disk and is saved with the stream's checkpoints.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Revisions(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("place", kind="stable")
        known = self.state.get() if self.state.exists() else None
        signature, place, n = known if known else (None, None, 0)
        out = []
        for at, new in zip(frame["place"].tolist(), frame["signature"].tolist(), strict=True):
            new = None if pd.isna(new) else new
            if place is not None and at <= place:
                out.append((key[0], at, new, n, LATE))
                continue
            if not n or new != signature:
                n += 1
                out.append((key[0], at, new, n, REVISION))
            signature, place = new, at
        self.state.update((signature, place, n))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"place": "int64", "revision": "int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"place": "int64", "revision": "int64"})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def revisions_of_stream(source: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """OUT of a stream (content string, place long, signature string). place orders a content's rows; those of one content
    at one place are repeats of the first. Rows with a null content or place are left out."""
    use_state_store(source.sparkSession)
    rows = source.filter("content is not null and place is not null").select("content", "place", "signature")
    return rows.groupBy("content").transformWithStateInPandas(statefulProcessor=Revisions(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")


def revisions_of_batch(df: DataFrame) -> DataFrame:
    """The same revisions of rows that are all there: (content, place, signature, revision)."""
    by = Window.partitionBy("content").orderBy("place")
    rows = df.filter("content is not null and place is not null").select("content", "place", "signature").dropDuplicates(["content", "place"])
    new = F.when((F.row_number().over(by) == 1) | ~F.col("signature").eqNullSafe(F.lag("signature").over(by)), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("revision", F.sum("_new").over(by).cast("long"))
    return marked.filter("_new = 1").drop("_new")
