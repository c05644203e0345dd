"""Progress and edit events: the latest stage of each key, in batch and in stream, and the edits that stand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """(user_id, stage, at, n): the last stage by time, then by event."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("at"), F.count("*").alias("n"))


def latest_stream(events: DataFrame, name: str, checkpoint: str):
    """The same over a stream, as a query into a memory table: each batch replaces the rows of its keys."""
    return latest(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def stage_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(at, event_type, n): events per window, by its start, and stage."""
    return events.groupBy(F.window(F.col("ts"), width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("at"), "event_type", "n")


def stage_counts_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same over a stream; rows later than the watermark are left out."""
    return stage_counts(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)


def replay(edits: DataFrame) -> DataFrame:
    """(session, place, node): edits that stand after undo and redo; a fresh edit clears what could be redone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, undone = [], []
        for op, node in pdf.sort_values("seq")[["op", "node"]].itertuples(index=False):
            if op == "undo":
                if done:
                    undone.append(done.pop())
            elif op == "redo":
                if undone:
                    done.append(undone.pop())
            else:
                done.append(node)
                undone.clear()
        return pd.DataFrame({"session": pdf["session"].iloc[0], "place": range(len(done)), "node": done})

    return edits.groupBy("session").applyInPandas(run, "session long, place long, node string")
