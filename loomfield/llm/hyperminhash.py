"""Near-duplicates by HyperMinHash: banded compressed registers propose, a corrected estimate filters, full sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .common import bounded, staged
from .components import components
from .simhash import joined_labels

SHINGLE = 3
#: Documents link at LINK_PER_CENT percent of Jaccard similarity or more.
LINK_PER_CENT = 85
#: A register is two bytes: leading zeros of the bucket's least hash, and MANTISSA bits after the leading one.
BANDS, ROWS, MANTISSA = 32, 6, 10
BUCKETS = BANDS * ROWS
#: Rate at which the compressed minima of disjoint sets agree, times two to the MANTISSA, for sets of equal size (Yu and Weber).
COLLISIONS = 0.169919487159739093975315012348630288992889
#: Standard deviations that an estimate may fall below the threshold: a link is lost to the estimate once in 10**9.
SLACK = 6
#: Members of a cell that compares registers; members that one cell holds a pivot for.
CELL, STAR = 2048, 256
#: Rows of some numbers each that go to all tasks, so that what they pick does not move; with more, both sides shuffle.
FEW = 500_000
#: Nodes and shingles of one chunk of a family whose full sets are compared.
FAMILY, HELD = 512, 1 << 20
U64 = np.uint64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, and their offsets by text.

    Shingles are SHINGLE words in lower case (A-Z); a text of fewer words is one shingle of all of them, whose hash depends on
    how many they are; a text without words has none.
    """
    data, off = ragged.flat(column)
    data = ragged.LOWER[data]
    start, end, by_text = ragged.word_bounds(data, off)
    words, n = ragged.word_hashes(data, start, end), np.diff(by_text)
    first, _ = ragged.windows(by_text, SHINGLE)
    text, h = [np.searchsorted(by_text, first, "right") - 1], [ragged.window_hashes(words, first, SHINGLE)]
    for few in range(1, SHINGLE):
        own = np.flatnonzero(n == few)
        text.append(own)
        h.append(ragged.mix(ragged.window_hashes(words, by_text[own], few) + U64(few)))
    text, h = np.concatenate(text), np.concatenate(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of BUCKETS registers for each set, 0 where no hash falls into the bucket."""
    n = len(off) - 1
    place = np.repeat(np.arange(n), np.diff(off)) * BUCKETS + ((h >> U64(32)) * U64(BUCKETS) >> U64(32)).astype(np.int64)
    low, some = np.full(n * BUCKETS, 0xFFFFFFFFFFFFFFFF, U64), np.zeros(n * BUCKETS, bool)
    np.minimum.at(low, place, ragged.mix(h * U64(ragged.BYTE_BASE)))
    some[place] = True
    zeros = np.zeros(len(low), np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        small = low < U64(1 << (64 - k))
        zeros += k * small
        low = np.where(small, low << U64(k), low)
    packed = (np.minimum(zeros, 62) + 1 << MANTISSA) | ((low >> U64(63 - MANTISSA)) & U64((1 << MANTISSA) - 1)).astype(np.int64)
    return np.where(some, packed, 0).astype("<u2").reshape(n, BUCKETS)


def folded(regs: np.ndarray) -> np.ndarray:
    """Registers as one byte each, 0 for empty ones: what differs agrees by chance once in 255."""
    mixed = ragged.mix(regs.astype(U64) * U64(ragged.WORD_BASE))
    return np.where(regs != 0, 1 + mixed % U64(255), 0).astype(np.uint8)


def similar(equal: np.ndarray, either: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, byte: bool = False) -> np.ndarray:
    """Whether pairs may link: sizes allow it, and the estimate, less the agreements that chance brings, is not too low.

    ``equal`` counts registers that agree and are not empty, ``either`` those that one of the two sets fills; ``byte`` ones are folded.
    """
    ratio = n_a / n_b
    chance = COLLISIONS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2 * either
    if byte:
        equal = np.maximum(equal - either / 255, 0) * 255 / 254
    line = LINK_PER_CENT / 100
    least = line - SLACK * np.sqrt(line * (1 - line) / np.maximum(either, 1))
    return (100 * np.minimum(n_a, n_b) >= LINK_PER_CENT * np.maximum(n_a, n_b)) & ((equal - chance) / np.maximum(either, 1) >= least)


def _matrix(column: pa.Array, kind: str = "<u2") -> np.ndarray:
    return ragged.flat(column)[0].view(kind).reshape(-1, BUCKETS)


def _folded(reps: DataFrame) -> DataFrame:
    """``reps`` with folded registers."""

    def run(batches):
        for b in batches:
            rows = [r.tobytes() for r in folded(_matrix(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["node", "n", "regs"])

    return reps.select("node", "n", "regs").mapInArrow(run, "node bigint, n bigint, regs binary")


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, key, regs, text) for every row: its number, the size and digest of its set, its registers; staged."""

    def run(batches):
        for b in ragged.pieces(batches):
            h, off = shingle_sets(b.column(2))
            n, regs, raw = np.diff(off), registers(h, off), h.tobytes()
            key = [xxhash.xxh3_128_digest(raw[8 * lo : 8 * hi]) if hi > lo else None for lo, hi in zip(off.tolist(), off[1:].tolist(), strict=False)]
            regs = pa.array([r.tobytes() if k else None for r, k in zip(regs, key, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), regs, b.column(2)], names=["row", "doc_id", "n", "key", "regs", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(run, f"row bigint, doc_id {kind}, n bigint, key binary, regs binary, text string"), "hyperminhash")


def _bands(reps: DataFrame) -> DataFrame:
    """(band, node): a key for each band of a node's registers that is not empty."""
    part = lambda b: F.substring("regs", 2 * ROWS * b + 1, 2 * ROWS)
    keys = F.array(*[F.when(part(b) != F.lit(b"\0" * 2 * ROWS), F.xxhash64(F.lit(b), part(b))) for b in range(BANDS)])
    return reps.select(F.explode(keys).alias("band"), "node").where("band is not null")


def _shared(bands: DataFrame) -> DataFrame:
    """(band, node, pivot) of the bands that more than one node has, each with its smallest node."""
    groups = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return bands.join(groups, "band").select("band", "node", "pivot")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (node, pivot) that may link by their registers."""
    a, b = reps.select("node", F.col("n").alias("n_a"), F.col("regs").alias("r_a")), reps.select(F.col("node").alias("pivot"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    pivots = pairs.select("pivot").distinct()
    b = b.join(F.broadcast(pivots), "pivot", "left_semi") if pivots.limit(FEW + 1).count() <= FEW else b

    def run(batches):
        for t in batches:
            x, y = _matrix(t.column(4)), _matrix(t.column(5))
            keep = similar(((x == y) & (x != 0)).sum(1), ((x | y) != 0).sum(1), t.column(2).to_numpy(), t.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep)), t.column(1).filter(pa.array(keep))], names=["node", "pivot"])

    sizes = 100 * F.least("n_a", "n_b") >= LINK_PER_CENT * F.greatest("n_a", "n_b")
    return a.join(bounded(pairs, FEW), "node").join(b, "pivot").where(sizes).select("node", "pivot", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "node bigint, pivot bigint")


def _verified(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links by full sets between nodes that meet in a cell, enough to join all of a cell's components that link.

    ``asked`` has cell, side, node and comp; ``texts`` node and text. Nodes of side 0 meet those of side 1, nodes of side 2 each
    other. A cell holds the sets of its sides 0 and 2 and goes through its side 1; nodes of one component are not compared.
    """

    class Cell:
        def __init__(self, name):
            self.name, self.kept, self.index, self.root = name, [], None, {}

        def top(self, comp):
            while self.root.get(comp, comp) != comp:
                comp = self.root[comp]
            return comp

        def links(self, node, comp, own, upto):
            """Links of a set with the first ``upto`` sets held, one for each component that it joins."""
            if self.index is None:
                size = np.array([len(h) for _, _, h in self.kept])
                values, owner = np.concatenate([h for _, _, h in self.kept]), np.repeat(np.arange(len(self.kept)), size)
                order = np.argsort(values, kind="stable")
                self.index = values[order], owner[order], size
            if all(self.top(c) == self.top(comp) for c in {c for _, c, _ in self.kept[:upto]}):
                return
            values, owner, size = self.index
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            both = np.bincount(owner[ragged.ranges(hi - lo, lo)], minlength=len(size))[:upto]
            for k in np.flatnonzero(100 * both >= LINK_PER_CENT * (size[:upto] + len(own) - both)):
                other, its, _ = self.kept[k]
                if self.top(its) != self.top(comp):
                    self.root[self.top(its)] = self.top(comp)
                    yield node, other

        def inner(self):
            if self.kept and self.name[1] == 2:
                for k, (node, comp, own) in enumerate(self.kept):
                    if k:
                        yield from self.links(node, comp, own, k)

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    def run(batches):
        cell = Cell(None)
        for batch in batches:
            for b in ragged.pieces([batch]):
                h, off = shingle_sets(b.column(4))
                cells, sides, nodes, comps = (b.column(i).to_numpy() for i in range(4))
                found = []
                for i in range(len(cells)):
                    name = (cells[i], 2 if sides[i] == 2 else 0)
                    if name != cell.name:
                        found += cell.inner()
                        cell = Cell(name)
                    own = h[off[i] : off[i + 1]]
                    if sides[i] != 1:
                        cell.kept.append((nodes[i], comps[i], own))
                        cell.index = None
                    elif cell.kept:
                        found += cell.links(nodes[i], comps[i], own, len(cell.kept))
                yield rows(found)
        yield rows(list(cell.inner()))

    asked = texts.join(bounded(asked, FEW), "node").select("cell", "side", "node", "comp", "text")
    return asked.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(run, "u bigint, v bigint")


def _stars(bands: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the members of a band with its smallest node; a node with many members is held by many cells."""
    pairs = staged(bands.where("node <> pivot").select("node", "pivot").distinct(), "hyperminhash-stars")
    pairs = staged(_estimated(pairs, reps), "hyperminhash-pairs")
    cells = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("long").alias("cells"))
    member = pairs.join(cells, "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), "cells")).alias("cell"), F.lit(1).alias("side"), "node", F.col("node").alias("comp"))
    pivot = cells.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("i"))
    return _verified(member.union(pivot.select(F.xxhash64("node", "i").alias("cell"), F.lit(0), "node", "node")), texts)


def _meetings(bands: DataFrame, reps: DataFrame, root: DataFrame) -> DataFrame:
    """(u, v): nodes of different components that meet in a band and may link, enough pairs to join all that do.

    Only bands whose members are in more than one component are looked at. The members of a band's largest component meet the
    others, and the others each other, in cells of CELL members; a component's members never meet among themselves, so a hot
    group of copies costs a pass over it for each CELL of strangers in it. A cell returns a forest, never its pairs.
    """
    named = bands.join(root.select("node", F.col("root").alias("own")), "node", "left").select("band", "node", F.coalesce("own", "node").alias("comp"))
    named = staged(named, "hyperminhash-named")
    sizes = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    cells = lambda n: F.ceil(n / CELL).cast("long")
    sizes = sizes.select("band", F.col("most.comp").alias("main"), cells(F.col("most.n")).alias("mains"), cells(F.col("all") - F.col("most.n")).alias("others"))
    row = named.join(sizes, "band")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("others")))
    cell = lambda kind, i, j, side: F.struct(F.xxhash64("band", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))
    of_main = F.transform(upto("others"), lambda j: cell(0, F.col("i"), j, F.lit(0)))
    of_other = F.concat(
        F.transform(upto("mains"), lambda j: cell(0, j, F.col("i"), F.lit(1))),
        F.transform(upto("others"), lambda j: cell(1, F.least(j, F.col("i")), F.greatest(j, F.col("i")), F.when(j == F.col("i"), 2).when(F.col("i") < j, 0).otherwise(1))),
    )
    dealt = row.withColumn("i", mine).select("node", "comp", F.explode(F.when(F.col("comp") == F.col("main"), of_main).otherwise(of_other)).alias("to")).select("to.*", "node", "comp")

    def run(batches):
        held, cell = [], None

        def met():
            side, node, comp, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            regs = np.concatenate([h[4] for h in held])
            inner = np.flatnonzero(side == 2)

            def pairs():
                for rows, cols in ((np.flatnonzero(side == 0), np.flatnonzero(side == 1)), (inner, inner)):
                    full = (regs[cols] != 0).astype(np.float32)
                    for lo in range(0, len(rows), 64) if len(cols) else ():
                        r = rows[lo : lo + 64]
                        x = regs[r]
                        some = (x != 0).astype(np.float32)
                        equal = np.stack([((q == regs[cols]) & (q != 0)).sum(1) for q in x])
                        either = some.sum(1)[:, None] + full.sum(1)[None, :] - some @ full.T
                        i, j = np.nonzero(similar(equal, either, n[r][:, None], n[cols][None, :], True) & (comp[r][:, None] != comp[cols][None, :]))
                        yield r[i], cols[j]

            label = joined_labels(len(node), pairs())
            far = np.flatnonzero(label != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["u", "v"])

        for t in batches:
            cells = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and cells[lo] != cell:
                    yield met()
                    held = []
                cell = cells[lo]
                p = t.slice(lo, hi - lo)
                held.append((p.column(1).to_numpy(), p.column(2).to_numpy(), p.column(3).to_numpy(), p.column(4).to_numpy(), _matrix(p.column(5), "u1")))
        if held:
            yield met()

    dealt = dealt.join(_folded(reps), "node").select("cell", "side", "node", "comp", "n", "regs")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint").distinct()


def _between(met: DataFrame, reps: DataFrame, texts: DataFrame, root: DataFrame) -> DataFrame:
    """Links between components whose nodes met: families of nodes that may link, each compared in cells of its chunks.

    A family is one cell unless it has more than FAMILY nodes or HELD shingles; then each two of its chunks are one.
    """
    family = staged(components(met).join(reps.select("node", "n"), "node").join(root.select("node", F.col("root").alias("own")), "node", "left"), "hyperminhash-families")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY), F.ceil(F.sum("n") / HELD)).cast("long")
    row = family.join(family.groupBy("root").agg(chunks.alias("chunks")), "root").withColumn("i", F.pmod(F.xxhash64("node"), "chunks"))
    row = row.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cell, side = F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")), F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    return _verified(row.select(cell.alias("cell"), side.alias("side"), "node", F.coalesce("own", "node").alias("comp")), texts)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents of one set fall together before anything is compared. The others meet where a band of registers agrees: each
    member first with the band's smallest node, which joins families of copies in a pass over their members; then only
    members of different components, whose registers tell which may link. What the estimate lets through is compared by full
    sets of shingles. Two documents at the threshold share none of the bands once in three million; more alike ones less often.

    Defined results: null texts and texts without words have an empty set, link with nothing and are kept; repeated rows share a
    component; component_id is the smallest doc_id, nulls aside (null if there is no other), and a row is kept if that is
    its own doc_id; an empty table gives no rows; other columns are ignored.
    """
    signed = signatures(docs)
    nodes = staged(signed.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "hyperminhash-sets")
    reps = staged(signed.select(F.col("row").alias("node"), "n", "regs").join(nodes, "node", "left_semi"), "hyperminhash-reps")
    texts, bands = signed.select(F.col("row").alias("node"), "text"), staged(_shared(_bands(reps)), "hyperminhash-bands")
    links = staged(_stars(bands, reps, texts), "hyperminhash-links")
    root = components(links)
    more = staged(_between(_meetings(bands, reps, root), reps, texts, root), "hyperminhash-more")
    root = components(links.union(more)) if more.limit(1).count() else root
    named = staged(nodes.join(root, "node", "left").select("key", "low", "root"), "hyperminhash-roots")
    least = staged(named.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id")), "hyperminhash-least")
    joined = named.where("root is not null").join(bounded(least), "root").select("key", "component_id")
    whole = signed.select("doc_id", "n", "key").join(joined.union(named.where("root is null").select("key", F.col("low").alias("component_id"))), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op12_hyperminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
