"""Row-local column functions: geography, time, coercion, bands. All stay inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Accepted spellings of booleans.
TRUE_TOKENS = ("true", "t", "yes", "y", "1", "on")
FALSE_TOKENS = ("false", "f", "no", "n", "0", "off", "none", "null", "")

# Attack technique rows per anomaly class, most relevant first.
TECHNIQUES = (
    ("brute_force", 1, "T1110", "Brute Force", "Credential Access"),
    ("credential_stuffing", 1, "T1110.004", "Brute Force: Credential Stuffing", "Credential Access"),
    ("credential_misuse", 1, "T1078", "Valid Accounts", "Defense Evasion"),
    ("impossible_travel", 1, "T1078", "Valid Accounts", "Initial Access"),
    ("lateral_movement", 1, "T1021", "Remote Services", "Lateral Movement"),
    ("lateral_movement", 2, "T1210", "Exploitation of Remote Services", "Lateral Movement"),
    ("device_spoofing", 1, "T1036", "Masquerading", "Defense Evasion"),
    ("device_spoofing", 2, "T1200", "Hardware Additions", "Initial Access"),
    ("low_and_slow_exfil", 1, "T1048", "Exfiltration Over Alternative Protocol", "Exfiltration"),
    ("insider_drift", 1, "T1078", "Valid Accounts", "Privilege Escalation"),
    ("insider_drift", 2, "T1098", "Account Manipulation", "Persistence"),
)


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (null counts as not holding)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def r4(col: Column) -> Column:
    """Four decimals without negative zero, so results compare exactly across engines."""
    return F.round(col.cast("double"), 4) + F.lit(0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    arc = 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.when(a.isNotNull(), arc)  # least() skips nulls, so guard explicitly


def elapsed_hours(us1: Column, us2: Column) -> Column:
    gap = F.abs(us2 - us1) / F.lit(1e6)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(60.0)) / F.lit(3600.0))


def velocity_kmh(lat1, lon1, us1, lat2, lon2, us2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) / elapsed_hours(us1, us2)


def impossible_travel(lat1, lon1, us1, lat2, lon2, us2, limit_kmh=900.0, min_km=500.0):
    """(fired, speed) of the standalone two-point test."""
    speed = velocity_kmh(lat1, lon1, us1, lat2, lon2, us2)
    far = haversine_km(lat1, lon1, lat2, lon2) >= min_km
    return F.coalesce(far & (speed > limit_kmh), F.lit(False)), F.coalesce(speed, F.lit(0.0))


def safe_log1p(col: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), F.coalesce(col.cast("double"), F.lit(0.0))))


def cyclic(position: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * position / F.lit(period)
    return F.sin(angle), F.cos(angle)


def off_hours(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) >= 22)


def ip_prefix(ip: Column, octets: int = 3) -> Column:
    return F.when(F.size(F.split(ip, r"\.")) < octets, ip).otherwise(F.substring_index(ip, ".", octets))


def risk_band(risk: Column) -> Column:
    return (
        F.when(risk >= 80, "critical").when(risk >= 60, "high").when(risk >= 40, "medium").otherwise("low")
    )


def normalise_category(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (text != "NaN"), text)


def attack_probability(p_normal: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.coalesce(p_normal, F.lit(0.0))))


def effective_risk(risk: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), risk + F.coalesce(offset, F.lit(0.0))))


def coerce_float(text: Column) -> Column:
    """'1,234' -> 1234, '83%' -> 83; null when it is not a number."""
    cleaned = F.rtrim(F.regexp_replace(F.trim(text), ",", ""))
    cleaned = F.regexp_replace(cleaned, "%+$", "")
    return F.when(cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cleaned.cast("double"))


def coerce_int(text: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(text), ",", "")
    ok = cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(ok, cleaned.cast("double").cast("bigint"))


def coerce_bool(text: Column) -> Column:
    token = F.lower(F.trim(text))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def time_split(us: Column, train_end: Column, val_end: Column) -> Column:
    return F.when(us < train_end, "train").when(us < val_end, "val").otherwise("test")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Deterministic short id: the same inputs always give the same id, so replays are idempotent."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 12))


def display_type(resolved: Column, probs: Column, is_anomaly: Column) -> Column:
    """Benign -> normal; an alert still called normal gets its most likely attack class.

    ``probs`` is a map class -> probability; ties go to the class listed first.
    """
    from tidewatch.config import ANOMALY_CLASSES

    ranked = F.array(
        *[
            F.struct(F.coalesce(probs[name], F.lit(-1.0)).alias("p"), F.lit(-i).alias("i"), F.lit(name).alias("c"))
            for i, name in enumerate(ANOMALY_CLASSES)
            if name != "normal"
        ]
    )
    best = F.array_max(ranked)["c"]
    return F.when(~is_anomaly, "normal").when(resolved != "normal", resolved).otherwise(best)
