"""Read queries over detections, campaigns, drift states, feedback and metric runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 500


def _page(limit: int) -> int:
    """The page size asked for; one beyond MAX_PAGE is refused, never cut."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}, not {limit}")
    return limit


def list_detections(
    detections: DataFrame, skip: int = 0, limit: int = 50, anomaly_type: str | None = None, entity_type: str | None = None,
    cold_start: bool | None = None, min_risk: float | None = None, sort: str = "risk",
) -> DataFrame:
    """Filtered page of detections, best first; ties by id. Compiles to a bounded top-k."""
    d = detections
    if anomaly_type is not None:
        d = d.filter(F.col("anomaly_type") == anomaly_type)
    if entity_type is not None:
        d = d.filter(F.col("entity_type") == entity_type)
    if cold_start is not None:
        d = d.filter(F.col("cold_start") == cold_start)
    if min_risk is not None:
        d = d.filter(F.col("risk") >= min_risk)
    first = F.desc("risk") if sort == "risk" else F.desc("ts_us")
    return d.orderBy(first, "event_id").offset(skip).limit(_page(limit))


def detection_by_id(detections: DataFrame, detection_id) -> DataFrame:
    return detections.filter(F.col("detection_id") == detection_id)


def entity_history(detections: DataFrame, entity_id: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Page of one entity's detections (risk, then time, descending) with the entity's total."""
    mine = detections.filter(F.col("entity_id") == entity_id)
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    page = mine.orderBy(F.desc("risk"), F.desc("ts_us"), "event_id").offset(skip).limit(_page(limit))
    return page.join(F.broadcast(total))


def top_per_entity(detections: DataFrame, n: int = 10) -> DataFrame:
    """Riskiest detection of each entity, the n riskiest entities."""
    best = F.min_by(F.struct("event_id", "risk", "ts_us"), F.struct(-F.col("risk"), F.col("event_id")))
    return detections.groupBy("entity_id").agg(best.alias("b")).select("entity_id", "b.*").orderBy(F.desc("risk"), "event_id").limit(n)


def storyline(detections: DataFrame, entity_id: str) -> DataFrame:
    return detections.filter(F.col("entity_id") == entity_id).select("event_id", "ts_us", "risk").orderBy("ts_us", "event_id")


def dashboard(detections: DataFrame, campaigns: DataFrame, feedback: DataFrame) -> DataFrame:
    """(metric, key, n): totals and anomalies by type."""
    d = detections.agg(F.count(F.lit(1)).alias("d"), F.expr("count_if(is_anomaly)").alias("a"))
    d = d.selectExpr("stack(2, 'n_detections', d, 'n_anomalies', a) AS (metric, n)")
    c = campaigns.agg(F.count(F.lit(1)).alias("n")).selectExpr("'n_campaigns' AS metric", "n")
    f = feedback.agg(F.count(F.lit(1)).alias("n")).selectExpr("'n_feedback' AS metric", "n")
    t = detections.filter("is_anomaly").groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    t = t.selectExpr("concat('type:', anomaly_type) AS metric", "n")
    return d.unionByName(c).unionByName(f).unionByName(t)


def latest(df: DataFrame, us: str, id: str, skip: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(F.desc(us), id).offset(skip).limit(_page(limit))
