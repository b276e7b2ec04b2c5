"""Reviewer feedback: a clamped running offset per entity.

Each verdict moves the offset by a step and clamps it, so a plain running sum is wrong. But
"add, then clamp" functions compose into one function of the same form (shift a, floor lo,
ceiling hi). Verdicts are folded in chunks of bounded size, chunk functions are composed in
order level by level, and no group ever holds more than CHUNK verdicts or functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.operators.ordering import order_events
from tidewatch.session import settle

CHUNK = 128


def accepted(feedback: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts on known detections with their entity, verdicts on unknown ones)."""
    known = detections.select("detection_id", "entity_id")
    return feedback.join(known, "detection_id"), feedback.join(known, "detection_id", "left_anti")


def fold(verdicts: DataFrame, s: Settings = DEFAULTS, id: str = "feedback_id") -> DataFrame:
    """Audit rows: previous and new offset of every verdict. ``verdicts``: entity, ts_us, id, verdict.

    Chunks of CHUNK verdicts become functions, CHUNK functions become one, level by level until an entity has one; then each
    level hands its members their starting offsets. No group holds more than CHUNK members, however many verdicts an entity has.
    """
    step, bound = s.feedback_step, s.feedback_bound
    o = order_events(verdicts, s, id=id, halo=1)
    rows = o.rows().selectExpr(
        "entity_id", id, "rn", f"(rn - 1) div {CHUNK} AS chunk", f"if(verdict = 'false_positive', {-step}D, {step}D) AS step",
    )
    clamp = lambda x: f"greatest({-bound}D, least({bound}D, {x}))"
    start = f"named_struct('a', 0D, 'lo', {-bound}D, 'hi', {bound}D)"
    one = f"aggregate(v, {start}, (f, x) -> named_struct('a', f.a + x.step, 'lo', {clamp('f.lo + x.step')}, 'hi', {clamp('f.hi + x.step')}))"
    chunks = rows.groupBy("entity_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("rn", id, "step"))).alias("v"))
    chunks = settle(chunks.selectExpr("*", f"{one} AS f"))
    within = lambda g, x: f"greatest({g}.lo, least({g}.hi, {x} + {g}.a))"
    both = f"named_struct('a', f.a + m.f.a, 'lo', {within('m.f', 'f.lo')}, 'hi', {within('m.f', 'f.hi')})"
    members, levels = chunks.selectExpr("entity_id", "chunk AS pos", "f"), []
    last = chunks.agg(F.max("chunk")).first()[0] or 0
    while last > 0:
        group = members.groupBy("entity_id", F.expr(f"pos div {CHUNK}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("fs"))
        levels.append(settle(group))
        members = levels[-1].selectExpr("entity_id", "up AS pos", f"aggregate(fs, {start}, (f, m) -> {both}) AS f")
        last //= CHUNK
    starts = members.selectExpr("entity_id", "pos", "0D AS start")
    for group in reversed(levels):
        walk = (
            "aggregate(fs, named_struct('cur', start, 'out', cast(array() AS array<struct<pos:bigint,start:double>>)), (w, m) -> named_struct("
            f"'cur', {within('m.f', 'w.cur')}, 'out', array_append(w.out, named_struct('pos', m.pos, 'start', w.cur)))).out"
        )
        starts = group.join(starts.withColumnRenamed("pos", "up"), ["entity_id", "up"]).selectExpr("entity_id", f"explode({walk}) AS m").select("entity_id", "m.*")
    walked = chunks.join(starts.withColumnRenamed("pos", "chunk"), ["entity_id", "chunk"]).selectExpr(
        "entity_id",
        "aggregate(v, named_struct('cur', start, 'out', cast(array() AS array<struct<rn:bigint,prev:double,cur:double>>)), "
        f"(s, x) -> named_struct('cur', {clamp('s.cur + x.step')}, 'out', array_append(s.out, "
        f"named_struct('rn', x.rn, 'prev', s.cur, 'cur', {clamp('s.cur + x.step')})))).out AS w",
        "v",
    )
    pairs = walked.selectExpr("entity_id", "explode(arrays_zip(v, w)) AS p")
    return pairs.selectExpr(
        "entity_id", f"p.v.{id} AS {id}", "p.w.rn AS seq", "p.v.step AS adjustment", "p.w.prev AS previous_value", "p.w.cur AS new_value"
    )


def offsets(audit: DataFrame) -> DataFrame:
    """Current offset per entity."""
    return audit.groupBy("entity_id").agg(F.max_by("new_value", "seq").alias("offset"), F.count(F.lit(1)).alias("verdicts"))


def offset_as_of(detections: DataFrame, audit: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The offset in force when each detection was made: as-of join as a union and a carried last value.

    ``audit`` needs ts_us; verdicts at the same time as a detection count only for later ones.
    """
    marks = audit.selectExpr("entity_id", "ts_us", "1 AS kind", "cast(null AS string) AS detection_id", "seq", "new_value")
    probes = detections.selectExpr("entity_id", "ts_us", "0 AS kind", "cast(detection_id AS string) AS detection_id", "0L AS seq", "cast(null AS double) AS new_value")
    both = marks.unionByName(probes).withColumn("event_id", F.expr("concat_ws(':', kind, lpad(cast(seq AS string), 20, '0'), detection_id)"))
    o = order_events(both, s, halo=1)
    # Running last value: carried per slice as the latest mark of the slices before.
    w = f"OVER (PARTITION BY {', '.join(o.part)} ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    f = o.frame.selectExpr("*", f"last(if({'not halo and ' if o.sliced else ''}kind = 1, new_value, null), true) {w} AS cur")
    if o.sliced:
        per = o.rows().filter("kind = 1").groupBy("entity_id", "slice").agg(F.max_by("new_value", "rn").alias("last_value"))
        grid = o.rows().select("entity_id", "slice").distinct().join(per, ["entity_id", "slice"], "left")
        carry = grid.selectExpr(
            "entity_id", "slice",
            "last(last_value, true) OVER (PARTITION BY entity_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried",
        ).filter("slice > 0")
        f = f.join(F.broadcast(carry), ["entity_id", "slice"], "left").withColumn("cur", F.coalesce("cur", "carried"))
    return o.with_frame(f).rows().filter("kind = 0").selectExpr("detection_id", "coalesce(cur, 0D) AS offset")
