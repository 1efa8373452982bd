"""Rounds over a whole graph in blocks of packed arrays: a block is the links of its own nodes, and blocks send each other values.

A node belongs to the block of its number's hash. A block asks each other block once for the nodes it is linked with; from then
on a round is one shuffle, of one packed array of values for each pair of blocks, and one pass of numpy over the links of a
block. The links themselves are dealt out once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.sources.tables import release, scope, staged

#: Links of a block, about: a task holds some 100 bytes for each.
LINKS = 1 << 20
#: Rounds between two written tables.
STAGE_EVERY = 5
#: What a row of a block holds besides the values for another block, whose number ``peer`` is then.
OWN, START = -1, -2

ROW = "block int, peer int, keys binary, starts binary, places binary, weights binary"
MESSAGE = "block int, peer int, data binary, moved boolean"

#: (own numbers, starts of their links, places of the links' other ends, weights, start values or None) of a block
Links = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def numbered(ids: DataFrame, edges: DataFrame, weight: Column) -> DataFrame:
    """(a, b, w): edges without loops by the numbers of ``ids`` (id, n), written. The hashed sides are the nodes, so edges are not sorted."""
    links = edges.where("source_id <> target_id").select("source_id", "target_id", weight.cast("double").alias("w"))
    links = links.join(ids.select(F.col("id").alias("source_id"), F.col("n").alias("a")).hint("shuffle_hash"), "source_id")
    links = links.join(ids.select(F.col("id").alias("target_id"), F.col("n").alias("b")).hint("shuffle_hash"), "target_id")
    return staged(links.select("a", "b", "w"), "links")


def both_ways(links: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return links.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way"), "w").select("way.a", "way.b", "w")


def degrees(links: DataFrame) -> DataFrame:
    """(n, links) of the nodes that have any, written."""
    return staged(both_ways(links).groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("links")), "degrees")


def crowded(degrees: DataFrame, most: int) -> bool:
    """Whether a node has more links than a block should hold."""
    return not degrees.where(F.col("links") > most).isEmpty()


def _array(cell, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    names = [part.split()[0] for part in ROW.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """A block's links, repeated ones summed, and the numbers it needs of each block, its own whole."""
    block = key[0].as_py()
    a, b, to, w = (table[c].to_numpy() for c in ("a", "b", "to", "w"))
    own = np.unique(a)
    needed, first, place = np.unique(np.concatenate([own, b]), return_index=True, return_inverse=True)
    at = np.concatenate([np.full(len(own), block, to.dtype), to])[first]
    order = np.lexsort((needed, at))
    needed, at = needed[order], at[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair = np.searchsorted(own, a) * len(needed) + rank[place[len(own) :]]
    order = np.argsort(pair, kind="stable")
    pair, w = pair[order], w[order]
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    pair, w = pair[new], np.add.reduceat(w, new)
    starts = np.searchsorted(pair, np.arange(len(own)) * len(needed))
    rows = [(block, OWN, own.tobytes(), starts.astype(np.int32).tobytes(), (pair % len(needed)).astype(np.int32).tobytes(), w.tobytes())]
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(at)]):
        rows.append((int(at[i]), block, needed[i:j].tobytes(), None, None, None))
    return _rows(rows)


def _placed(key: tuple, table: pa.Table) -> pa.Table:
    """What other blocks need of a block, as places among its own numbers."""
    peers = table["peer"].to_pylist()
    own = _array(table["keys"][peers.index(OWN)], np.int64)
    rows = []
    for i, peer in enumerate(peers):
        cells = [table[c][i].as_py() for c in ("keys", "starts", "places", "weights")]
        if peer >= 0:
            cells[0] = np.searchsorted(own, _array(table["keys"][i], np.int64)).astype(np.int32).tobytes()
        rows.append((key[0].as_py(), peer, *cells))
    return _rows(rows)


def _starts(key: tuple, table: pa.Table) -> pa.Table:
    return _rows([(key[0].as_py(), START, table["n"].to_numpy().tobytes(), None, None, table["s"].to_numpy().tobytes())])


def _links(table: pa.Table) -> Links:
    peers = table["peer"].to_pylist()
    row = peers.index(OWN)
    own, starts, places, weights = (_array(table[c][row], k) for c, k in (("keys", np.int64), ("starts", np.int32), ("places", np.int32), ("weights", np.float64)))
    start = None
    if START in peers:
        row, start = peers.index(START), np.zeros(len(own))
        keys, values = _array(table["keys"][row], np.int64), _array(table["weights"][row], np.float64)
        place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        known = own[place] == keys  # nodes without links are in no block
        start[place[known]] = values[known]
    return own, starts, places, weights, start


def _sent(block: int, table: pa.Table, values: np.ndarray, moved: bool) -> pa.Table:
    to = [(p, _array(k, np.int32)) for p, k in zip(table["peer"].to_pylist(), table["keys"]) if p >= 0]
    return pa.table({
        "block": pa.array([p for p, _ in to], pa.int32()), "peer": pa.array([block] * len(to), pa.int32()),
        "data": pa.array([values[at].tobytes() for _, at in to], pa.binary()), "moved": pa.array([moved] * len(to), pa.bool_()),
    })


def _received(table: pa.Table, kind: type) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """The values a block needs, in the order in which it needs them."""
    got = sorted(zip(table["peer"].to_pylist(), (_array(c, kind) for c in table["data"])), key=lambda m: m[0])
    return np.concatenate([v for _, v in got]), [p for p, _ in got], [v for _, v in got]


class Blocks:
    """A graph dealt out in blocks, from ``links`` (a, b, w), each link once; ``start``: (n, s)."""

    def __init__(self, links: DataFrame, start: DataFrame | None = None):
        self.spark = links.sparkSession
        self.count = max(1, -(-2 * links.count() // LINKS))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(self.count)).cast("int")
        rows = both_ways(links).select(block("a").alias("block"), "a", "b", block("b").alias("to"), "w")
        packed = staged(rows.repartition(self.count, "block").groupBy("block").applyInArrow(_packed, ROW), "blocks")
        rows = packed.repartition(self.count, "block").groupBy("block").applyInArrow(_placed, ROW)
        if start is not None:
            own = start.select(block("n").alias("block"), "n", "s").repartition(self.count, "block").groupBy("block").applyInArrow(_starts, ROW)
            rows = rows.unionByName(own.join(packed.where(F.col("peer") == OWN).select("block"), "block", "left_semi").select(*rows.columns))
        rows = staged(rows, "blocks").repartition(self.count, "block").sortWithinPartitions("block")
        self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # its lineage is a written table

    def run(self, first: Callable, step: Callable, finish: Callable, kind: str, rounds: int, until_still: bool = False) -> DataFrame:
        """(n, value) after ``rounds``, written.

        ``first(links)`` gives the values that a block's own nodes send first, ``step(links, received, old, turn)`` those after a round,
        ``finish(links, received, old)`` what is kept in the end; ``old`` are the own nodes' last ones. ``until_still`` ends with the
        first round that changes no value.
        """
        dtype, spark = np.dtype(kind).type, self.spark

        def open_(key, table):
            return _sent(key[0].as_py(), table, first(_links(table)), True)

        def turned(turn):
            def one(key, table, messages):
                block, links = key[0].as_py(), _links(table)
                received, peers, parts = _received(messages, dtype)
                old = parts[peers.index(block)]
                new = step(links, received, old, turn)
                return _sent(block, table, new, bool((new != old).any()))
            return one

        def close(key, table, messages):
            links = _links(table)
            received, peers, parts = _received(messages, dtype)
            return pa.table({"n": links[0], "value": finish(links, received, parts[peers.index(key[0].as_py())])})

        met = lambda messages: self.rows.groupBy("block").cogroup(messages.groupBy("block"))
        with scope(spark) as own:
            messages = self.rows.groupBy("block").applyInArrow(open_, MESSAGE)
            for turn in range(1, rounds + 1):
                messages = met(messages).applyInArrow(turned(turn), MESSAGE)
                if until_still or turn % STAGE_EVERY == 0:
                    messages = staged(messages, "values")
                    own.forget(1)
                    release(spark)
                if until_still and messages.where("moved").isEmpty():
                    break
        # written in the caller's scope, before what it is made from goes
        values = staged(met(messages).applyInArrow(close, f"n long, value {'double' if dtype is np.float64 else 'long'}"), "values")
        own.forget()
        self.rows.unpersist()
        return values


def most_voted(links: Links, received: np.ndarray, old: np.ndarray, turn: int) -> np.ndarray:
    """The value of most weight among each node's neighbours, the smallest of equals."""
    own, starts, places, weights, _ = links
    values, code = np.unique(received, return_inverse=True)
    row = np.repeat(np.arange(len(own)), np.diff(starts, append=len(places)))
    vote = row * len(values) + code[places]
    order = np.argsort(vote)
    vote = vote[order]
    new = np.flatnonzero(np.diff(vote, prepend=-1))
    votes, vote = np.add.reduceat(weights[order], new), vote[new]
    row = vote // len(values)
    most = np.maximum.reduceat(votes, np.flatnonzero(np.diff(row, prepend=-1)))
    best = np.flatnonzero(votes == most[row])
    best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
    return values[vote[best] % len(values)]
