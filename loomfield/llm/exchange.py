"""Dealing packed arrays of many chunks out by value, and bringing each chunk its answers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a chunk is dealt to directly; with more, it is dealt to ranges of FAN parts, and many chunks' pieces of one
#: range are merged before they are dealt on. Two levels reach FAN * FAN parts.
FAN = 8192
#: Tasks of one shuffle; a task goes through its parts one after the other.
MOST_TASKS = 20_000
ROW = "dest int, chunk binary, part int, body binary"
MEMO = -1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())],
        names=["dest", "chunk", "part", "body"],
    )


def _groups(batches: Iterator[pa.RecordBatch], key: Callable) -> Iterator[tuple]:
    """Runs of rows of one key, as (key, rows); memos pass one by one under a key of None."""
    held, rows = None, []
    for b in batches:
        for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if r[2] == MEMO:
                yield None, [r]
                continue
            k = key(r)
            if rows and k != held:
                yield held, rows
                rows = []
            held = k
            rows.append(r)
    if rows:
        yield held, rows


def exchange(df: DataFrame, deal: Callable, work: Callable, parts: int) -> DataFrame:
    """Rows (chunk, part, body) sorted by chunk and part within partitions, all of a chunk in one: its memo (part MEMO) and its answers.

    ``deal(batches)`` gives (chunk, memo, [(part, body), ...]) for each chunk of ``df``; ``work(part, chunks, bodies)`` gives
    (chunk, answer) for as many chunks of the part as it likes, and (b"", note) for notes, which go to a chunk of that
    name. A chunk's rows are as many as its parts up to FAN, or the ranges of FAN parts beyond, so neither work nor rows
    grow with the product of chunks and parts. Every step is a plain shuffle that a lost executor repeats.
    """
    ranges = -(-parts // FAN)
    tasks = min(MOST_TASKS, max(2, 2 * parts))

    def send(batches):
        for chunk, memo, cells in deal(batches):
            spread = int.from_bytes(chunk[:4], "little") % parts
            if ranges == 1:
                rows = [(p, chunk, p, x) for p, x in cells]
            else:
                by_range: dict[int, list] = {}
                for p, x in cells:
                    by_range.setdefault(p // FAN, []).append((p, bytes(x)))
                rows = [(r * FAN + int.from_bytes(chunk[4:8], "little") % FAN, chunk, r, pickle.dumps(x)) for r, x in by_range.items()]
            if memo is not None:
                rows.append((spread, chunk, MEMO, memo))
            for lo in range(0, len(rows), 4096):
                yield _rows(rows[lo : lo + 4096])

    def merge(batches):
        """Pieces of one range from many chunks, as one body for each part."""
        for key, rows in _groups(batches, lambda r: r[0]):
            if key is None:
                yield _rows(rows)
                continue
            by_part: dict[int, list] = {}
            for _, chunk, _, body in rows:
                for p, x in pickle.loads(body.as_py()):
                    by_part.setdefault(p, []).append((chunk, x))
            name = int(key).to_bytes(8, "little")
            for p, x in by_part.items():
                yield _rows([(p, name, p, pickle.dumps(x))])

    def answer(batches):
        for key, rows in _groups(batches, lambda r: r[2]):
            if key is None:
                yield _rows(rows)
                continue
            if ranges == 1:
                told = [(0, c, key, x) for c, x in work(key, [r[1] for r in rows], [r[3].as_py() for r in rows])]
            else:
                merged = [(r[1], *piece) for r in rows for piece in pickle.loads(r[3].as_py())]
                home, back = {c: name for name, c, _ in merged}, {}
                for c, x in work(key, [m[1] for m in merged], [m[2] for m in merged]):
                    back.setdefault(home.get(c, b""), []).append((c, bytes(x)))
                told = [(0, name, key, pickle.dumps(x) if name else x[0][1]) for name, x in back.items() if name]
                told += [(0, b"", key, x) for _, x in back.get(b"", [])]
            for lo in range(0, len(told), 1024):
                yield _rows(told[lo : lo + 1024])

    def part_again(batches):
        """Answers of merged bodies, each chunk's for itself."""
        for key, rows in _groups(batches, lambda r: r[1]):
            if key is None or key == b"":
                yield _rows(rows)
                continue
            by_chunk: dict[bytes, list] = {}
            for _, _, p, body in rows:
                for c, x in pickle.loads(body.as_py()):
                    by_chunk.setdefault(c, []).append((0, c, p, x))
            for rows in by_chunk.values():
                yield _rows(rows)

    moved = df.mapInArrow(send, ROW)
    if ranges > 1:
        moved = moved.repartition(tasks, "dest").sortWithinPartitions("dest").mapInArrow(merge, ROW)
    told = moved.repartition(tasks, "dest").sortWithinPartitions("dest", "part").mapInArrow(answer, ROW)
    if ranges > 1:
        told = told.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(part_again, ROW)
    return told.select("chunk", "part", "body")


def by_chunk(told: DataFrame, gather: Callable, schema: str) -> DataFrame:
    """``gather(chunk, memo, [(part, answer), ...])`` for every chunk that has a memo, as batches of ``schema``."""

    def run(batches):
        chunk = memo = None
        answers: list = []
        for b in batches:
            for c, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p == MEMO:
                    if c != chunk:
                        if chunk is not None:
                            yield gather(chunk, memo, answers)
                        chunk, memo, answers = c, x.as_py(), []
                else:
                    answers.append((p, x.as_py()))
        if chunk is not None:
            yield gather(chunk, memo, answers)

    return told.where(F.col("chunk") != F.lit(b"")).repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, schema)

