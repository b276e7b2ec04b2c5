"""Commands of a session from overlapping windows: segments of a long session, odd rows."""

import random

import pytest

from tidewatch.operators import sessions as SE

SCHEMA = "session_id string, event_id long, ts_us long, command_sequence array<string>"


def plain(windows, hold=64):
    tail, out = [], []
    for w in windows:
        w = [t for t in w or [] if t]
        new, tail = SE.merge_overlap(tail, w, max(hold, max(len(x or []) for x in windows)))
        out.append(new)
    return out


@pytest.mark.parametrize("segment,warm", [(40, 10), (40, 0), (15, 15), (1000, 10)])
def test_segments_change_no_commands(spark, monkeypatch, segment, warm):
    monkeypatch.setattr(SE, "SEGMENT", segment)
    monkeypatch.setattr(SE, "WARM_UP", warm)
    rng = random.Random(9)
    said = [rng.choice("abc") for _ in range(400)]
    rolling = [said[max(0, k - 4) : k + 1] for k in range(200)]
    never = [["x"] for _ in range(90)]  # every window overlaps all that stood before
    odd = [None, [], ["", "a"], [None, "a", "b"], ["a", "b", "c"], []] * 12
    rows = []
    for name, windows in (("rolling", rolling), ("never", never), ("odd", odd), ("short", rolling[:3])):
        rows += [(name, len(rows) + k, k // 2, w) for k, w in enumerate(windows)]
    rows.append((None, 10_000, 0, ["a"]))
    got = SE.new_commands(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {}
    for name in ("rolling", "never", "odd", "short"):
        own = [r for r in rows if r[0] == name]
        want |= dict(zip((r[1] for r in own), plain([r[3] for r in own])))
    assert len(got) == len(want) and {r.event_id: list(r.new_tokens) for r in got} == want
    assert SE.new_commands(spark.createDataFrame([], SCHEMA)).count() == 0
