"""The state of requests to outside services, from a log of what happened to them: the same over a table and over a stream.

A request is planned, sent, answered, failed or reconciled. Its state is the furthest of what is known: an answer (or a reconciliation) settles it for good, a failure after
sending leaves it open whether the service worked (ambiguous), sending alone is started, planning alone is not_sent. "Furthest" is a maximum, so the order and
repetition of events do not matter: events may come late, a batch may run twice, and a stream's state is one row a request that tasks pre-aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("not_sent", "started", "ambiguous", "succeeded")
#: What an event makes of a request at least, as a place in STATES.
REACHES = {"planned": 0, "sent": 1, "failed": 2, "answered": 3, "reconciled": 3}


def _reach(event: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, place in REACHES.items():
        out = F.when(event == name, place).otherwise(out)
    return out


def states(events: DataFrame) -> DataFrame:
    """request_id, state, calls, chars: of events (request_id, event, chars); events of no known kind and without a request do not count.

    A call is a sending, whatever came of it; its characters are spent. With a stream, use output mode ``complete`` or ``update``.
    """
    known = events.withColumn("_reach", _reach(F.col("event"))).filter("_reach is not null and request_id is not null")
    sent = F.col("event") == "sent"
    per = known.groupBy("request_id").agg(F.max("_reach").alias("_reach"), F.count_if(sent).alias("calls"), F.coalesce(F.sum(F.when(sent, F.col("chars"))), F.lit(0)).cast("long").alias("chars"))
    return per.select("request_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("_reach") + 1).alias("state"), "calls", "chars")


def spent(requests: DataFrame, *, max_calls: int, max_chars: int, cost_per_char: float, max_cost: float) -> DataFrame:
    """One row: calls, chars, cost, open (ambiguous or started requests), may_send and why not: a run stops at its budget, and while it is not known what became of a request."""
    total = requests.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if(F.col("state").isin("started", "ambiguous")).alias("open"))
    cost = F.round(F.col("chars") * cost_per_char, 6)
    reason = F.when(F.col("open") > 0, "reconcile_first").when(F.col("calls") >= max_calls, "calls").when(F.col("chars") >= max_chars, "chars").when(cost >= max_cost, "cost")
    return total.select("calls", "chars", cost.alias("cost"), "open", reason.isNull().alias("may_send"), reason.alias("reason"))


def reconciled(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Events that settle open requests: ``found`` names those whose answer turned up at the service (request_id)."""
    return requests.filter(F.col("state").isin("started", "ambiguous")).join(found.select("request_id").distinct(), "request_id", "left_semi").select("request_id", F.lit("reconciled").alias("event"), F.lit(0).cast("long").alias("chars"))
