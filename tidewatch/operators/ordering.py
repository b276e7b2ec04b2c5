"""Per-entity ordered processing that survives an entity holding a large part of all rows.

Every ordered operator of this engine (lag, bounded trailing window, running sums, as-of
snapshots, gap sessions) works on an :class:`Ordered` table. Rows of one entity are ordered by
(time, id) and numbered ``rn`` = 1, 2, ... Entities below the group limit are handled by plain
windows over the entity. An entity above it is cut into *slices* of equal row count, aligned to
the snapshot blocks; each slice also receives copies (``halo`` rows) of the last rows of the
slice before it, so trailing frames see what they need, and running sums add a *carry* from the
slices before. Carries exist only for slices after the first, whose number is bounded by
total rows / group limit, so they can be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.session import in_parts

BIN_US = 60_000_000  # coarse time bins used to number the rows of an oversized entity


@dataclass(frozen=True)
class Ordered:
    frame: DataFrame
    key: str
    us: str
    id: str
    sliced: bool
    settings: Settings
    reach: int  # no trailing window of this table holds more rows than this

    @property
    def part(self) -> list[str]:
        return [self.key, "slice"] if self.sliced else [self.key]

    def with_frame(self, frame: DataFrame) -> "Ordered":
        return replace(self, frame=frame)

    def by_row(self):
        return Window.partitionBy(*self.part).orderBy(self.us, self.id)

    def by_block(self):
        return Window.partitionBy(*self.part).orderBy("blk")

    def rows(self) -> DataFrame:
        """The table without the halo copies."""
        return self.frame.filter(~F.col("halo")) if self.sliced else self.frame

    def own(self, col: Column) -> Column:
        """The value for a row's own slice, null on halo copies (sums and counts skip it)."""
        return F.when(~F.col("halo"), col) if self.sliced else col


def order_events(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    key: str = "entity_id",
    us: str = "ts_us",
    id: str = "event_id",
    halo: int | None = None,
) -> Ordered:
    halo = settings.window_cap + 1 if halo is None else halo
    every = settings.refresh_every
    # One pass over two columns: rows per entity, and per entity and window-sized time bin. A window
    # touches at most two neighbouring bins, which bounds how many rows any trailing frame needs.
    span = settings.window_minutes * 60_000_000
    per_bin = df.groupBy(key, F.expr(f"{us} div {span}").alias("tb")).agg(F.count(F.lit(1)).alias("n"))
    by_bin = Window.partitionBy(key).orderBy("tb")
    before_bin = F.when(F.lag("tb").over(by_bin) == F.col("tb") - 1, F.lag("n").over(by_bin)).otherwise(0)
    counts = per_bin.withColumn("two", F.col("n") + before_bin).groupBy(key).agg(
        F.sum("n").alias("n"), F.max("two").alias("two")
    )
    stats = counts.agg(F.sum("n"), F.max("n"), F.max("two")).first()
    total, biggest = stats[0] or 0, stats[1] or 0
    reach = int(min(settings.window_cap, (stats[2] or 0) + 1))
    limit = settings.group_limit(total)
    blk = F.floor((F.col("rn") - 2) / F.lit(float(every))).cast("bigint")

    if biggest <= limit:
        rn = F.row_number().over(Window.partitionBy(key).orderBy(us, id)).cast("bigint")
        frame = in_parts(df, total, key).withColumn("rn", rn).withColumn("blk", blk)
        frame = frame.withColumn("slice", F.lit(0).cast("bigint")).withColumn("halo", F.lit(False))
        return Ordered(frame, key, us, id, False, settings, reach)

    # At most total/limit entities are oversized, so this list is bounded.
    hot = counts.filter(F.col("n") > limit).select(key)
    hot_rows = df.select(key, us).join(F.broadcast(hot), key, "left_semi")
    tbin = F.floor(F.col(us) / BIN_US).cast("bigint")
    bins = hot_rows.groupBy(key, tbin.alias("tbin")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("tbin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
    starts = (
        bins.withColumn("piece", F.floor(F.col("before") / limit).cast("bigint"))
        .groupBy(key, "piece")
        .agg(F.min("tbin").alias("tbin"), F.min("before").alias("before"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("tbin", "before", "piece"))).alias("_starts"))
    )
    located = df.join(F.broadcast(starts), key, "left")
    at = F.element_at(F.filter("_starts", lambda s: s["tbin"] <= tbin), -1)
    located = located.withColumn("_at", at).withColumn("_hot", F.col("_starts").isNotNull())
    within = F.row_number().over(Window.partitionBy(key, F.coalesce(F.col("_at.piece"), F.lit(-1))).orderBy(us, id))
    numbered = located.withColumn("rn", (F.coalesce(F.col("_at.before"), F.lit(0)) + within).cast("bigint"))
    numbered = numbered.withColumn("blk", blk).drop("_starts", "_at")

    blocks = max(-(-limit // every), -(-halo // every) + 1)
    own = F.when(F.col("_hot"), F.greatest(F.floor(F.col("blk") / F.lit(float(blocks))), F.lit(0))).otherwise(F.lit(0))
    numbered = numbered.withColumn("_own", own.cast("bigint"))
    next_first = F.lit(2) + F.lit(every * blocks) * (F.col("_own") + 1)
    tail = F.col("_hot") & (F.col("rn") >= next_first - halo)
    here = F.struct(F.col("_own").alias("slice"), F.lit(False).alias("halo"))
    there = F.struct((F.col("_own") + 1).alias("slice"), F.lit(True).alias("halo"))
    frame = (
        numbered.withColumn("_place", F.explode(F.when(tail, F.array(here, there)).otherwise(F.array(here))))
        .withColumn("slice", F.col("_place.slice"))
        .withColumn("halo", F.col("_place.halo"))
        .drop("_place", "_own", "_hot")
    )
    return Ordered(frame, key, us, id, True, settings, reach)


def over(o: Ordered, frame: str, *extra: str) -> str:
    """Window clause in SQL. ``before``: strictly earlier rows; ``through``: those and this row;
    ``block``: rows of strictly earlier snapshot blocks (what a profile snapshot has seen)."""
    part = ", ".join([*o.part, *extra])
    if frame == "block":
        return f"OVER (PARTITION BY {part} ORDER BY blk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    end = "1 PRECEDING" if frame == "before" else "CURRENT ROW"
    return f"OVER (PARTITION BY {part} ORDER BY {o.us}, {o.id} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


def running(o: Ordered, sums: dict[str, str], frame: str = "before") -> Ordered:
    """Add running sums per entity of the given SQL expressions."""
    w = over(o, frame)

    def own(x):
        return f"if(halo, null, {x})" if o.sliced else x

    inner = [f"coalesce(sum({own(x)}) {w}, 0) AS {n}" for n, x in sums.items()]
    out = o.frame.selectExpr("*", *inner)
    if not o.sliced:
        return o.with_frame(out)
    per = o.rows().groupBy(o.key, "slice").agg(*[F.expr(f"sum({x}) AS {n}") for n, x in sums.items()])
    earlier = f"OVER (PARTITION BY {o.key} ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = per.selectExpr(
        o.key, "slice", *[f"coalesce(sum({n}) {earlier}, 0) AS _carry_{n}" for n in sums]
    ).filter("slice > 0")
    out = out.join(F.broadcast(carry), [o.key, "slice"], "left")
    plain = [c for c in out.columns if c not in sums and not c.startswith("_carry_")]
    return o.with_frame(out.selectExpr(*plain, *[f"{n} + coalesce(_carry_{n}, 0) AS {n}" for n in sums]))


def previous(o: Ordered, *cols: str) -> Ordered:
    """As-of join with the previous row of the same entity, as struct column ``prev``."""
    return o.with_frame(o.frame.withColumn("prev", F.lag(F.struct(*cols)).over(o.by_row())))


def trailing(o: Ordered, fields: dict[str, str], name: str = "recent") -> Ordered:
    """Structs of the earlier rows any trailing window can hold, oldest first, as an array column.

    The frame is bounded by row count; time cut-offs are applied to the array by the caller,
    because two different ones are in use (this row's time, and the previous row's).
    """
    item = ", ".join(f"'{n}', {x}" for n, x in fields.items())
    w = f"OVER (PARTITION BY {', '.join(o.part)} ORDER BY {o.us}, {o.id} ROWS BETWEEN {max(1, o.reach)} PRECEDING AND 1 PRECEDING)"
    return o.with_frame(o.frame.selectExpr("*", f"collect_list(named_struct({item})) {w} AS {name}"))


def first_of(o: Ordered, value: str, name: str) -> Ordered:
    """1.0 on the first row of each (entity, value); null values never count as first."""
    w = Window.partitionBy(*o.part, value).orderBy(o.us, o.id)
    ranked = F.row_number().over(w) if not o.sliced else F.sum(F.when(~F.col("halo"), 1).otherwise(0)).over(w)
    first = F.col(value).isNotNull() & ~F.col("halo") & (ranked == 1)
    if not o.sliced:
        return o.with_frame(o.frame.withColumn(name, F.when(first, 1.0).otherwise(0.0)))
    # A value's first slice decides; the join key includes the slice, so no key is oversized.
    seen = (
        o.rows().filter(F.col(value).isNotNull()).groupBy(o.key, value).agg(F.min("slice").alias("slice"))
        .withColumn("_first_slice", F.lit(True))
    )
    out = o.frame.join(seen, [o.key, value, "slice"], "left")
    out = out.withColumn(name, F.when(first & F.col("_first_slice").isNotNull(), 1.0).otherwise(0.0))
    return o.with_frame(out.drop("_first_slice"))


def gap_groups(o: Ordered, gap_us: int, name: str = "group_no") -> Ordered:
    """Number the runs of an entity's rows that are never more than ``gap_us`` apart (inclusive)."""
    o = previous(o, o.us)
    o = o.with_frame(o.frame.selectExpr("*", f"if(prev is null or {o.us} - prev.{o.us} > {gap_us}, 1, 0) AS _starts"))
    o = running(o, {name: "_starts"}, "through")
    return o.with_frame(o.frame.withColumn(name, F.col(name).cast("bigint")).drop("_starts", "prev"))
