"""Tables too large to broadcast, looked up by pieces of text: a piece asks once for each of its distinct keys and meets what it found.

A key is asked for by each piece once, however often the piece holds it, so the hottest key has one row for each piece. Pieces are
SIZE bytes long because a longer text repeats more of its words, so that fewer keys are asked for per byte; inside a piece the
work goes by slices of some hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm import words as W
from tidewatch.llm.store import save


#: Bytes of text in a piece, about; a longer text is a piece of its own.
SIZE = 1 << 24


def numbered(rows: DataFrame, at: int) -> DataFrame:
    """rows with one more column, _piece, written once so that the numbers stay; column at holds the text."""

    def run(batches):
        serial, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for part in W.pieces(b, at):
                n = pc.sum(pc.binary_length(part.column(at))).as_py() or 0
                if held and held + n > SIZE:
                    serial, held = serial + 1, 0
                held += n
                yield pa.record_batch([*part.columns, pa.array(np.full(part.num_rows, serial, np.int64))], names=[*part.schema.names, "_piece"])

    return save(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_piece", T.LongType())])))


def _distinct(parts: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(parts).group_by(parts[0].schema.names).aggregate([])


def asked(pieces: DataFrame, keys: Callable[[pa.RecordBatch], list[np.ndarray]], names: list[str], at: int) -> DataFrame:
    """Columns _piece and names: the distinct keys of each piece. keys(slice) gives those of some of its rows; column at holds the text."""

    def run(batches):
        held, last = [], None  # a piece that two tasks read asks twice, which meet() allows
        for b in batches:
            number = b.column("_piece").to_numpy()
            for n in np.unique(number):
                if held and n != last:
                    yield from _distinct(held).to_batches()
                    held = []
                last = n
                for part in W.pieces(b.filter(pa.array(number == n)), at):
                    got = keys(part)
                    held.append(pa.record_batch([pa.array(np.full(len(got[0]), n)), *(pa.array(k) for k in got)], names=["_piece", *names]))
        if held:
            yield from _distinct(held).to_batches()

    return pieces.mapInArrow(run, ", ".join(f"{c} long" for c in ["_piece", *names]))


def meet(
    pieces: DataFrame, found: DataFrame, take: Callable[[pa.Table], object], use: Callable[[object, pa.RecordBatch], pa.RecordBatch], schema, at: int, distinct: bool = False
) -> DataFrame:
    """use(take(rows of found for a piece), slice of the piece) for every slice; found may repeat rows. distinct: equal rows of a piece once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = take(right)
        rows = left.drop_columns(["_piece"]).combine_chunks().to_batches()
        out = [use(told, part) for b in rows for part in W.pieces(b, at)]
        return _distinct(out) if distinct and out else pa.Table.from_batches(out) if out else empty

    empty = to_arrow_schema(_of(pieces, schema)).empty_table()
    return pieces.groupBy("_piece").cogroup(found.groupBy("_piece")).applyInArrow(run, schema)


def _of(pieces: DataFrame, schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
