"""Chat formatting by rendering ever longer prefixes of a conversation with a template that is a black box.

A template is any function from a list of (role, text) to a string. Comparing the outputs for k and k + 1 turns locates the
new turn's span; where the longer output does not begin with the shorter one, the template rewrites history, which is
recorded with the turn and the first character that changed. Inside a span the text's place is found by rendering the turn
twice more with probe texts: what both share at either side is the turn's frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Strings that mark turns or mean something to common chat models (fixed values).
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|turn|>", "<|text|>", "<|end|>",
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape("<|turn|>") + "(.*?)" + re.escape("<|text|>") + "(.*?)" + re.escape("<|end|>"), re.DOTALL)
_PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; double backslashes."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: Turns) -> str:
    """The default template: marked turns, control strings escaped in roles and texts."""
    return "<s>" + "".join(f"<|turn|>{escape(r)}<|text|>{escape(t)}<|end|>" for r, t in turns)


def read_marked(text: str) -> Turns:
    """The turns of an output of marked()."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


@dataclass
class Rendered:
    text: str
    #: (start, end) of each turn and of the text inside it, in the final output; None if a later turn moved it.
    spans: list[tuple[int, int] | None]
    bodies: list[tuple[int, int] | None]
    #: (turn, first character that differs) for each prefix whose output the next turn rewrote.
    rewrites: list[tuple[int, int]]


def common(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def render(turns: Turns, template: Template) -> Rendered:
    """Render every prefix once; a rewritten prefix loses the spans that reach beyond the first changed character."""
    out = Rendered(template([]), [], [], [])
    for k, (role, text) in enumerate(turns):
        longer = template(turns[: k + 1])
        same = common(out.text, longer)
        if same < len(out.text):
            out.rewrites.append((k, same))
            out.spans = [s if s and s[1] <= same else None for s in out.spans]
            out.bodies = [b if b and b[1] <= same else None for b in out.bodies]
        a, b = (template([*turns[:k], (role, p)]) for p in _PROBES)
        head = common(a, b)
        tail = common(a[head:][::-1], b[head:][::-1])
        placed = len(longer) >= head + tail and longer[:head] == a[:head] and (not tail or longer[-tail:] == a[-tail:])
        out.spans.append((same, len(longer)))
        out.bodies.append((head, len(longer) - tail) if placed and head >= same else None)
        out.text = longer
    return out


def format_conversations(
    rows: DataFrame, template: Template = marked, learned: tuple[str, ...] = ("assistant",),
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: conv, formatted, turns (role, span, body), loss (spans of text to learn), rewrites.

    Turns are taken in order of turn, nulls first; equal turns in order of role and text. Null roles and texts are empty.
    Rows with a null conversation form one conversation. Repeated rows are turns of their own. Offsets are code points.
    An empty table gives none. A task holds one conversation at a time, and as many prefixes as it has turns are rendered.
    """
    each = rows.groupBy(F.col(conv).alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns")
    )

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                for turns in part.column(1).to_pylist():
                    pairs = [(t["role"], t["text"]) for t in turns]
                    r = render(pairs, template)
                    spans = [{"role": p[0], "start": s and s[0], "stop": s and s[1], "body_start": b and b[0], "body_stop": b and b[1]} for p, s, b in zip(pairs, r.spans, r.bodies)]
                    loss = [{"start": x["body_start"], "stop": x["body_stop"]} for x in spans if x["role"] in learned and x["body_start"] is not None]
                    out.append((r.text, spans, loss, [{"turn": k, "at": at} for k, at in r.rewrites]))
                yield pa.record_batch(
                    [part.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], _SPANS), pa.array([x[2] for x in out], _LOSS), pa.array([x[3] for x in out], _REWRITES)],
                    names=["conv", "formatted", "turns", "loss", "rewrites"],
                )

    kind = dict(each.dtypes)["conv"]
    return each.mapInArrow(run, f"conv {kind}, formatted string, turns array<struct<role string, start long, stop long, body_start long, body_stop long>>, loss array<struct<start long, stop long>>, rewrites array<struct<turn long, at long>>")


_SPANS = pa.list_(pa.struct([("role", pa.string()), *((k, pa.int64()) for k in ("start", "stop", "body_start", "body_stop"))]))
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_REWRITES = pa.list_(pa.struct([("turn", pa.int64()), ("at", pa.int64())]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv and digests, from the formatted text and its loss spans alone: what a reader of the output gets."""
    import hashlib

    def run(batches):
        for b in batches:
            rows = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_marked(text)
                learn = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learn), hashlib.sha256(learn.encode()).hexdigest(), len(text)))
            cols = [pa.array([r[k] for r in rows], pa.string() if k in (1, 3) else pa.int64()) for k in range(5)]
            yield pa.record_batch([b.column(0), *cols], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv"]
    return formatted.select("conv", "formatted", "loss").mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
