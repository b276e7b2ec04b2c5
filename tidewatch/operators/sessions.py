"""Completed sessions and traffic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.scalar import off_hours
from tidewatch.operators.ordering import order_events
from tidewatch.session import settle
from tidewatch.sources.tables import class_table

CLEAN = "filter(command_sequence, t -> t is not null and t <> '')"


def _in_session(events: DataFrame, s: Settings, halo: int = 1):
    return order_events(events.filter("session_id is not null"), s, key="session_id", halo=halo)


def ordered(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Events with their position inside the session."""
    return _in_session(events, s).rows().withColumnRenamed("rn", "pos")


def summaries(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Ten measures per session. Commands are counted with adjacent repeats merged: inside an event
    by comparing neighbours, across events by the last command before. A slice of a split session
    gets the last command of the slices before it."""
    o = _in_session(events.withColumn("_c", F.expr(CLEAN)), s)
    f = o.frame.withColumn("_end", F.expr("if(size(_c) > 0, element_at(_c, -1), null)"))
    f = f.withColumn("_last", F.last("_end", True).over(o.by_row().rowsBetween(Window.unboundedPreceding, -1)))
    if o.sliced:
        ends = o.with_frame(f).rows().filter("_end is not null").groupBy(o.key, "slice").agg(F.max_by("_end", F.struct(o.us, o.id)).alias("_end"))
        slices = o.rows().select(o.key, "slice").distinct().join(ends, [o.key, "slice"], "left")
        earlier = Window.partitionBy(o.key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = slices.select(o.key, "slice", F.last("_end", True).over(earlier).alias("_carry")).filter("slice > 0")
        f = f.join(F.broadcast(carry), [o.key, "slice"], "left").withColumn("_last", F.coalesce("_last", "_carry"))
    fresh = "size(filter(_c, (t, i) -> i = 0 or t <> _c[i - 1])) - if(size(_c) > 0 and _c[0] = _last, 1, 0)"
    f = o.with_frame(f).rows().withColumn("_fresh", F.expr(fresh))
    bad = F.when(F.col("auth_success"), 0.0).otherwise(1.0)
    return f.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("resource_accessed").alias("distinct_resources"),
        F.countDistinct("geo_country").alias("distinct_countries"),
        F.countDistinct("device_mac").alias("distinct_devices"),
        F.sum(bad).cast("bigint").alias("auth_failures"),
        F.avg(bad).alias("auth_failure_ratio"),
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("span_seconds"),
        F.sum("bytes_out").alias("total_bytes_out"),
        F.sum("bytes_in").alias("total_bytes_in"),
        F.sum("_fresh").cast("bigint").alias("command_count"),
    )


def merge_overlap(tail: list, tokens: list, keep: int) -> tuple[list, list]:
    """(new tokens, new tail) of one window joined at its longest overlap with what came before."""
    for size in range(min(len(tail), len(tokens)), 0, -1):
        if tail[-size:] == tokens[:size]:
            break
    else:
        size = 0
    new = tokens[size:]
    return new, (tail + new)[-keep:]


#: Events of one session that a task walks in a row, and events before them that it walks first to guess what stood before.
SEGMENT, WARM_UP = 50_000, 200


def new_commands(events: DataFrame, keep: int = 64, s: Settings = DEFAULTS) -> DataFrame:
    """The commands each event adds to its session, from overlapping rolling windows.

    Only the end of the running sequence matters to the next event: as many tokens as the longest window so far (at least
    ``keep``) can overlap. A session with more than SEGMENT events is cut: each segment guesses that end by walking WARM_UP
    earlier events, and segments whose guess differs from what the one before really ends with are walked again from there,
    until none differs. The session's full sequence is the concatenation of ``new_tokens``. Events without a session are left
    out; an event without commands adds none.
    """
    widest = events.agg(F.max(F.size("command_sequence"))).first()[0] or 0
    hold = max(keep, widest)
    kt = dict(events.dtypes)["event_id"]
    rows = events.filter("session_id is not null").selectExpr("session_id", "event_id", "ts_us", f"coalesce({CLEAN}, array()) AS t")
    rows = order_events(rows, s, key="session_id", halo=0).rows().withColumn("seg", F.expr(f"cast((rn - 1) div {SEGMENT} AS bigint)"))
    rows = rows.select("session_id", "event_id", "ts_us", "rn", "t", "seg")
    long = settle(rows.groupBy("session_id").agg(F.max("seg").alias("last")).where("last > 0"))  # at most rows / SEGMENT sessions
    plain = ("session_id", "event_id", "ts_us", "new_tokens")
    if long.isEmpty():
        return _walked(rows, None, hold, kt).where("NOT mark").select(*plain)
    tail = rows.where(f"(rn - 1) % {SEGMENT} >= {max(0, SEGMENT - WARM_UP)}").join(long, "session_id").where("seg < last").drop("last").withColumn("seg", F.col("seg") + 1)
    whole = settle(rows.withColumn("warm", F.lit(False)).unionByName(tail.withColumn("warm", F.lit(True))))
    out = settle(_walked(whole, None, hold, kt))
    order = Window.partitionBy("session_id").orderBy("seg")
    while True:
        ends = out.where("mark").groupBy("session_id", "seg").agg(
            F.max(F.when(F.col("side") == "entry", F.col("new_tokens"))).alias("entry"),
            F.max(F.when(F.col("side") == "exit", F.col("new_tokens"))).alias("exit"))
        wrong = settle(ends.withColumn("given", F.lag("exit").over(order)).where("given IS NOT NULL AND entry <> given").select("session_id", "seg", "given"))
        if wrong.isEmpty():
            return out.where("NOT mark").select(*plain)
        again = _walked(whole.where("NOT warm").join(wrong.select("session_id", "seg"), ["session_id", "seg"], "left_semi"), wrong, hold, kt)
        out = settle(out.join(wrong.select("session_id", "seg"), ["session_id", "seg"], "left_anti").select(*out.columns).unionByName(again))


def _walked(rows: DataFrame, entries: DataFrame | None, hold: int, kt: str) -> DataFrame:
    """New tokens of every event, and two marked rows for each segment: the end of the sequence before its first event and
    after its last. A segment starts from ``entries`` (session_id, seg, given) where it has one, else from nothing."""
    import pandas as pd

    if "warm" not in rows.columns:
        rows = rows.withColumn("warm", F.lit(False))
    given = rows.withColumn("given", F.lit(None).cast("array<string>")) if entries is None else rows.join(entries, ["session_id", "seg"])
    cols = ["session_id", "event_id", "ts_us", "new_tokens", "mark", "side", "seg"]
    whole_number = {"ts_us": "Int64", "seg": "Int64"} | ({"event_id": "Int64"} if kt in ("bigint", "int") else {})

    def walk(batches):
        where, tail, begun = None, [], False
        for pdf in batches:
            out = []
            for sid, seg, warm, eid, us, tokens, start in zip(pdf["session_id"], pdf["seg"], pdf["warm"], pdf["event_id"], pdf["ts_us"], pdf["t"], pdf["given"]):
                if (sid, seg) != where:
                    if where is not None:
                        out.append((where[0], None, None, tail, True, "exit", where[1]))
                    where, begun = (sid, seg), False
                    tail = list(start) if start is not None else []
                if not warm and not begun:
                    out.append((sid, None, None, tail, True, "entry", seg))
                    begun = True
                new, tail = merge_overlap(tail, list(tokens), hold)
                if not warm:
                    out.append((sid, eid, us, new, False, None, seg))
            yield pd.DataFrame(out, columns=cols).astype(whole_number)
        if where is not None:
            yield pd.DataFrame([(where[0], None, None, tail, True, "exit", where[1])], columns=cols).astype(whole_number)

    ordered = given.repartition("session_id", "seg").sortWithinPartitions("session_id", "seg", "rn")
    return ordered.mapInPandas(walk, f"session_id string, event_id {kt}, ts_us bigint, new_tokens array<string>, mark boolean, side string, seg bigint")


def traffic(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("entity_id").alias("entities"),
        F.countDistinct("session_id").alias("sessions"),
        F.avg(F.when(F.col("auth_success"), 0.0).otherwise(1.0)).alias("failure_rate"),
        F.avg(F.when(off_hours(F.col("timestamp")), 1.0).otherwise(0.0)).alias("off_hours_rate"),
        F.countDistinct("geo_country").alias("countries"), F.avg("session_duration").alias("mean_duration"),
    )


def class_counts(events: DataFrame) -> DataFrame:
    """Rows per class and split; classes without rows are listed with zeros."""
    per = events.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"count_if(split = '{x}')").alias(x) for x in ("train", "val", "test")]
    )
    return class_table(events.sparkSession).select("label").join(per, "label", "left").na.fill(0)


def incidents(events: DataFrame) -> DataFrame:
    per = events.filter("label <> 'normal'").groupBy("label", "campaign_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stage").alias("stages")
    )
    return per.groupBy("label").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("n").alias("events"), F.avg("stages").alias("mean_stages")
    )
