"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ragged
from .common import bounded, staged
from .components import components

SHINGLE, SEED, BITS, REACH = 4, 42, 64, 4
#: With REACH differing bits, one of REACH + 1 blocks agrees in full.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Larger groups of one block are split by the blocks of the bits that are left.
GROUP = 4096
LEAF, FAN = 16, 8
#: Queries that search the index at once, and rows that are indexed at once if their groups allow.
ASK, INDEX = 1 << 14, 1 << 17


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """64-bit SimHash of each text: words in lower case, windows of SHINGLE words with XXH64, majority of each bit."""
    data, off = ragged.flat(column)
    start, end, by_text = ragged.word_bounds(data, off)
    text, at = ragged.joined(ragged.LOWER[data], start, end)
    n = np.diff(by_text)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    first = ragged.ranges(count, by_text[:-1])
    last = np.minimum(first + SHINGLE, np.repeat(by_text[1:], count))
    raw = text.tobytes()
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(raw.__getitem__, map(slice, at[first].tolist(), (at[last] - 1).tolist())), repeat(SEED)), np.uint64, len(first))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bounds = np.concatenate([[0], np.cumsum(count[some])])
        sums = np.empty((len(some), BITS), np.int64)
        lo = 0
        while lo < len(some):  # bits of a bounded number of windows at once
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 17), "right")) - 1)
            bits = np.unpackbits(h[bounds[lo] : bounds[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.reduceat(bits, bounds[lo:hi] - bounds[lo], axis=0, dtype=np.int64, out=sums[lo:hi])
            lo = hi
        set_bits = (2 * sums > count[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row: fp is the fingerprint's 64 bits as a long, whole texts however long.

    Defined results: null and blank texts have fingerprint 0; repeated rows and ids (null ones too) give a row each; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in ragged.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1)).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ", 1) + ", fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a word in the Gray order: prefix exclusive-or of its bits."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class Index:
    """Hierarchy over fingerprints sorted by group, then Gray rank.

    Leaves hold up to LEAF neighbours of one group, upper nodes FAN nodes. A node stores the bits that all of its
    members share and that its parent does not have yet; a search adds up the differences in those bits on its way
    down, drops a node with all its members when they exceed the reach, and takes it whole when even the bits that
    its members do not share cannot exceed it.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.fp, group = fp[order], group[order]
        self.order = order
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([heads, [len(fp)]]))
        self.end_of_group = np.repeat(heads + size, size)
        start, end, per = self._cut(heads, size, LEAF)
        both, either = np.bitwise_and.reduceat(self.fp, start), np.bitwise_or.reduceat(self.fp, start)
        levels = [(start, end, both, either, None)]
        while (per > 1).any():
            at = np.concatenate([[0], np.cumsum(per)[:-1]])
            first, last, per = self._cut(at, per, FAN)
            s, e, b, o, _ = levels[-1]
            levels.append((s[first], e[last - 1], np.bitwise_and.reduceat(b, first), np.bitwise_or.reduceat(o, first), (first, last)))
        self.levels, self.root_of = [], np.repeat(np.arange(len(heads)), size)
        above = None
        for s, e, b, o, kids in reversed(levels):
            mask = ~(b ^ o)
            rest = mask if above is None else mask & ~above
            self.levels.append((s, e, b & rest, rest, BITS - np.bitwise_count(mask).astype(np.int64), kids))
            above = np.repeat(mask, kids[1] - kids[0]) if kids is not None else mask
        self.open_bits = ~above

    @staticmethod
    def _cut(at: np.ndarray, size: np.ndarray, width: int):
        per = -(-size // width)
        start = np.repeat(at, per) + ragged.ranges(per) * width
        end = np.minimum(start + width, np.repeat(at + size, per))
        return start, end, per

    def links(self):
        """Pairs of positions within reach: every one, or enough of them to join all that are linked through a node taken whole."""
        for lo in range(0, len(self.fp), ASK):
            q = np.arange(lo, min(lo + ASK, len(self.fp)))
            node, gone = self.root_of[q], np.zeros(len(q), np.int64)
            for s, e, pattern, rest, free, kids in self.levels:
                gone = gone + np.bitwise_count((self.fp[q] ^ pattern[node]) & rest[node])
                keep = (gone <= REACH) & (e[node] > q + 1)  # partners that come later only
                q, node, gone = q[keep], node[keep], gone[keep]
                whole = (gone + free[node] <= REACH) & (s[node] > q)
                if whole.any():
                    taken, asker = np.unique(node[whole], return_index=True)
                    yield q[whole], s[node[whole]]
                    size = e[taken] - s[taken]
                    yield np.repeat(q[whole][asker], size), ragged.ranges(size, s[taken])
                    q, node, gone = q[~whole], node[~whole], gone[~whole]
                if kids is not None:
                    n = kids[1][node] - kids[0][node]
                    q, gone, node = np.repeat(q, n), np.repeat(gone, n), ragged.ranges(n, kids[0][node])
            for a in range(0, len(q), ASK):
                qq, nn, gg = q[a : a + ASK], node[a : a + ASK], gone[a : a + ASK]
                n = e[nn] - s[nn]
                x, y = np.repeat(qq, n), ragged.ranges(n, s[nn])
                d = np.repeat(gg, n) + np.bitwise_count((self.fp[x] ^ self.fp[y]) & np.repeat(self.open_bits[nn], n))
                hit = (d <= REACH) & (y > x)
                yield x[hit], y[hit]


def joined_labels(n: int, pairs) -> np.ndarray:
    """Smallest position reachable through the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]
    return label


def _keys(fp: np.ndarray, hot: set[tuple[int, int]]):
    """(row, key) of each fingerprint: one key for each block; in hot groups one for each block of the bits that are left."""
    for i, (lo, n) in enumerate(BLOCKS):
        value = ((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64)
        crowded = np.isin(value, [v for b, v in hot if b == i])
        rows = np.flatnonzero(~crowded)
        yield rows, (np.int64(i) << 13 | value[rows]) << 16
        rows = np.flatnonzero(crowded)
        if len(rows):
            left = [b for b in range(BITS) if not lo <= b < lo + n]
            for j in range(REACH + 1):
                own = np.zeros(len(rows), np.uint64)
                for k, b in enumerate(left[j :: REACH + 1]):
                    own |= (fp[rows] >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
                yield rows, (np.int64(i) << 13 | value[rows]) << 16 | np.int64(1 + j) << 12 | own.astype(np.int64)


def linked(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join all fingerprints within reach of another; ``fps`` has each fingerprint once (fp)."""
    blocks = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (lo, n) in enumerate(BLOCKS)])).alias("x")).groupBy("x.b", "x.v").count()
    hot = {(r["b"], r["v"]) for r in blocks.where(F.col("count") > GROUP).collect()}  # at most 36,864 keys, whatever the input

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, key in _keys(fp, hot):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows].view(np.int64))], names=["key", "fp"])

    def search(batches):
        key, fp, size = [], [], 0

        def links():
            k, f = np.concatenate(key), np.concatenate(fp).view(np.uint64)
            index = Index(k, f)
            label = joined_labels(len(f), index.links())
            far = np.flatnonzero(label != np.arange(len(f)))
            s = index.fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(s[far]), pa.array(s[label[far]])], names=["u", "v"])

        for b in batches:
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            if size >= INDEX and len(k):
                cut = int(np.searchsorted(k, key[-1][-1], "right"))  # the group that is open ends here
                key.append(k[:cut]), fp.append(f[:cut])
                if cut == len(k):
                    continue
                yield links()
                key, fp, size, k, f = [], [], 0, k[cut:], f[cut:]
            key.append(k), fp.append(f)
            size += len(k)
        if size:
            yield links()

    dealt = fps.select("fp").mapInArrow(deal, "key bigint, fp bigint")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Copies fall together before the search: only distinct fingerprints are dealt out, by five blocks of bits of
    which one must agree, and crowded blocks again by the bits that are left, so no task gathers a hot group. A task
    searches its groups through the index and returns a forest of links, never all pairs.

    Defined results: null and blank texts have fingerprint 0 and link like others; rows that repeat share a
    component; component_id is the smallest doc_id, nulls aside; an empty table gives no rows; extra columns are
    ignored.
    """
    fp = staged(fingerprints(docs), "simhash")
    first = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    root = components(linked(first))
    named = staged(first.join(root, first["fp"] == root["node"], "left").select("fp", "low", "root"), "simhash-roots")
    # fingerprints without a link are their own component; of the others a component's smallest id is joined back
    least = named.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    joined = named.where("root is not null").join(bounded(staged(least, "simhash-least")), "root").select("fp", "component_id")
    alone = named.where("root is null").select("fp", F.col("low").alias("component_id"))
    return fp.join(joined.unionByName(alone), "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id, ties by the text's SHA-256.

    Defined results: rows are told apart by doc_id and text together, so rows of one doc_id and unlike texts are
    documents of their own; of rows that agree in both, the one with the smallest hash over all columns stays. Ids order
    as numbers where they are, before others as text; a null doc_id comes last, by its text. Null and blank texts are
    copies of each other. An empty table gives no rows. Columns, whatever their names, stay as they are.
    """
    number = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    name = F.when(F.col("doc_id").isNull(), "~").otherwise("" if number else F.concat(F.lit("="), F.col("doc_id").cast("string")))
    own = F.struct(
        F.coalesce(F.col("doc_id").try_cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), name.alias("name"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("text"),
    ).cast("struct<id:bigint,name:string,text:binary>")  # as it is read back: the join and the window then share one shuffle
    first = staged(near_duplicates(docs.select(own.alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("own")).distinct(), "simhash-kept")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    held = docs.select(own.alias("own"), hashed.alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(first, "own", "left_semi")
    place = F.row_number().over(Window.partitionBy("own").orderBy("hash"))
    return held.withColumn("place", place).where("place = 1").select("row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
