"""Conversations: sliding history, escalation and summaries, as windows over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import WEIGHTS

HISTORY, WINDOW, LEAST, TEXT = 50, 10, 3, 200


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, value in WEIGHTS.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def escalation(recent: Column, length: Column) -> Column:
    """Escalation score of the last turns, an array of (blocked int, weight int) in order, at a history of ``length``."""
    n = F.size(recent)
    mid = F.floor(n / 2).cast("int")
    first, second = F.slice(recent, F.lit(1), mid), F.slice(recent, mid + 1, n)

    def total(half: Column) -> Column:
        return F.aggregate(half, F.lit(0), lambda a, x: a + x["blocked"])

    def top(half: Column) -> Column:
        return F.aggregate(half, F.lit(0), lambda a, x: F.greatest(a, x["weight"]))

    b1, b2 = total(first), total(second)
    grown = F.greatest(F.lit(0), b2 - b1) / F.greatest(F.lit(1), b1 + b2)  # threats and blocked turns are the same count
    graver = F.greatest(F.lit(0), top(second) - top(first)) / 10
    score = F.lit(0.4) * grown + F.lit(0.3) * grown + F.lit(0.3) * graver
    size = F.size(second)
    score = F.when((size > 1) & (b2 / F.greatest(size, F.lit(1)) > 0.7) & (b1 == 0), F.least(F.lit(1.0), score + 0.3)).otherwise(score)
    return F.when(length < LEAST, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def history(turns: DataFrame, session: str, order: str, text: str = "text", window: int = WINDOW, keep: int = HISTORY) -> DataFrame:
    """``turns`` (with blocked, severity) with, after each turn: entries, recent_entries, threats, blocked_turns, escalation, recent_texts, recent_blocked."""
    upto = Window.partitionBy(session).orderBy(order)
    span = window if window > 0 else keep
    recent = F.collect_list(F.struct(F.col("blocked").cast("int").alias("blocked"), weight(F.col("severity")).alias("weight"))).over(upto.rowsBetween(-(min(span, keep) - 1), 0))
    last = upto.rowsBetween(-4, 0)
    out = turns.withColumns({
        "entries": F.count("*").over(upto.rowsBetween(Window.unboundedPreceding, 0)),
        "recent_entries": F.count("*").over(upto.rowsBetween(-(keep - 1), 0)),
        "threats": F.sum(F.col("blocked").cast("long")).over(upto.rowsBetween(Window.unboundedPreceding, 0)),
        "recent_texts": F.collect_list(F.substring(F.coalesce(text, F.lit("")), 1, TEXT)).over(last),
        "recent_blocked": F.collect_list("blocked").over(last),
        "_recent": recent,
    })
    return out.withColumn("blocked_turns", F.col("threats")).withColumn("escalation", escalation(F.col("_recent"), F.col("recent_entries"))).drop("_recent")


def last_turns(turns: DataFrame, session: str, order: str, n: int | None = None) -> DataFrame:
    """The last ``n`` turns of each session, at most ``HISTORY``; None or 0: all that are kept."""
    back = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= (min(n, HISTORY) if n else HISTORY)).drop("_back")


def summary(turns: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """A row for each session: the state after its last turn."""
    back = Window.partitionBy(session).orderBy(F.desc(order))
    return history(turns, session, order, text).withColumn("_back", F.row_number().over(back)).where("_back = 1").select(session, "entries", "recent_entries", "threats", "blocked_turns", "escalation", "recent_texts", "recent_blocked")


def clear(turns: DataFrame, session: str, cleared: DataFrame) -> DataFrame:
    """The turns of sessions that aren't in ``cleared`` (session)."""
    return turns.join(cleared.select(F.col(session).alias("_gone")).distinct(), F.col(session) == F.col("_gone"), "left_anti")
