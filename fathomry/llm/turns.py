"""Conversations, cut into pieces of bounded size in the order of their turns, and folds over the pieces.

Rows are dealt out by ranges of (conversation, order) rather than by conversation, so one with a third of all rows lies in many
tasks. A task reads its rows as a sorted stream and holds one piece at a time. A piece that is known to be a whole conversation
says so (`alone`); the others, two a task besides those of long conversations, are for a second, ordered pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pieces, sizes_of

MARKS = [T.StructField("part", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("alone", T.BooleanType())]


def changes(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before; null equals null."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def cut(rows: DataFrame, ranges: list[Column], order: list[Column], fields: list[T.StructField], make: Callable[[], Callable[[pa.ListArray, np.ndarray], list[pa.Array]]], *, conv: str = "conv_id", text: str = "text", most: int = 256, most_bytes: int = 1 << 18) -> DataFrame:
    """conv, part, at, alone and fields, one row for each piece; (part, at) orders the pieces of a conversation. A piece has at most `most` rows, and under most_bytes before its last row. ranges, of which order must be a refinement, deal the rows; make() runs once in each task and returns a function from lists of rows (structs of the other columns), and which of them are alone, to the fields."""
    head = rows.schema[conv]
    names = [f.name for f in rows.schema if f.name != conv]
    schema = T.StructType([head, *MARKS, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, f, held = TaskContext.get().partitionId(), None, None
        place = size = at = 0  # rows, bytes and pieces of the held row's conversation before it
        opening = True  # whether the held row's conversation is the task's first

        def told(batch: pa.RecordBatch, bounds: np.ndarray, ats: np.ndarray, alone: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, j in pieces(sizes.tolist()):
                a, b = int(bounds[i]), int(bounds[j])
                part_of = batch.slice(a, b - a)
                structs = pa.StructArray.from_arrays([part_of.column(n) for n in names], names)
                lists = pa.ListArray.from_arrays(pa.array((bounds[i : j + 1] - a).astype(np.int32)), structs)
                keys = batch.column(conv).take(pa.array(bounds[i:j]))
                marks = [pa.array(np.full(j - i, part, np.int32)), pa.array(ats[i:j].astype(np.int32)), pa.array(alone[i:j])]
                yield pa.RecordBatch.from_arrays([keys, *marks, *f(lists, alone[i:j])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            f = f or make()
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            new = np.r_[held is None, changes(batch.column(conv))]
            bytes_ = np.array(sizes_of(batch.column(text)), np.int64)
            before = np.cumsum(bytes_) - bytes_
            which = np.cumsum(new)
            first = np.zeros(which[-1] + 1, np.int64)  # the conversations' first rows; the one at hand has number 0 if it goes on
            first[which[new]] = np.flatnonzero(new)
            base, weight = np.arange(n) - first[which], before - before[first[which]]
            if not new[0]:
                base[which == 0] += place
                weight[which == 0] += size
            turn = np.r_[True, (base[1:] // most != base[:-1] // most) | (weight[1:] // most_bytes != weight[:-1] // most_bytes) | new[1:]]
            starts = np.flatnonzero(turn)
            group = which[starts]
            lead = np.r_[True, group[1:] != group[:-1]]
            ats = np.arange(len(starts)) - np.maximum.accumulate(np.where(lead, np.arange(len(starts)), 0))
            if not new[0]:
                ats[group == 0] += at
            task_first = (group == group[0]) & opening
            begins = (base[starts] == 0) & ~task_first
            alone = begins & np.r_[lead[1:], False]
            last = len(starts) - 1
            if last:
                bounds = starts.astype(np.int64)
                yield from told(batch, bounds, ats[:last], alone[:last], np.add.reduceat(bytes_, starts)[:last] + 1)
            s = int(starts[-1])
            held, place, size, at, opening = batch.slice(s), int(base[s]), int(weight[s]), int(ats[-1]), bool(task_first[-1])
        if held is not None:
            n = held.num_rows
            yield from told(held, np.array([0, n], np.int64), np.array([at]), np.array([False]), np.array([1]))

    columns = [F.col(c) for c in (conv, *names)]
    return rows.select(*columns).repartitionByRange(F.col(conv), *ranges).sortWithinPartitions(F.col(conv), *order).mapInArrow(run, schema)


def folded(found: DataFrame, carried: list[str], fields: list[T.StructField], make: Callable[[], Any], *, conv: str = "conv_id") -> DataFrame:
    """conv and fields: what make().told() says of each conversation after add(**carried) of its pieces in order. Pieces that are alone are told where they are; the others are sent on."""
    key = found.schema[conv]
    kept = [found.schema[c] for c in carried]
    types = list(to_arrow_schema(T.StructType(fields)).types)
    names = [key.name, *[f.name for f in fields]]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone, rows = batch.column("alone"), []
            columns = [batch.column(c) for c in carried]
            for i, go in enumerate(alone.to_pylist()):
                if go:
                    (state := make()).add(**{c: x[i].as_py() for c, x in zip(carried, columns)})
                rows.append(state.told() if go else (None,) * len(types))
            done = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            left = [pc.if_else(alone, pa.scalar(None, x.type), x) for x in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (conv, "part", "at", "alone")), *done, *left], names=first.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None

        def told(keys: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, alone, columns = batch.column(conv), batch.column("alone").to_pylist(), [batch.column(f"__{c}") for c in carried]
            new = changes(ids if last is None else pa.concat_arrays([last, ids]))
            done = list(zip(*[batch.column(n).to_pylist() for n in names[1:]]))
            keys, rows = [], []
            for i, other in enumerate(new if last is not None else [True, *new]):
                if other and held is not None:
                    keys.append(last)
                    rows.append(held.told())
                    held = None
                last = ids.slice(i, 1)
                if alone[i]:
                    keys.append(last)
                    rows.append(done[i])
                else:
                    held = held or make()
                    held.add(**{c: x[i].as_py() for c, x in zip(carried, columns)})
            if rows:
                yield told(keys, rows)
        if held is not None:
            yield told([last], [held.told()])

    first = T.StructType([key, *MARKS, *fields, *[T.StructField(f"__{f.name}", f.dataType) for f in kept]])
    sent = found.select(conv, "part", "at", "alone", *carried).mapInArrow(whole, first)
    ordered = sent.repartition(conv).sortWithinPartitions(conv, "part", "at")
    return ordered.mapInArrow(fold, T.StructType([key, *fields]))
