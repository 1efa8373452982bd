"""Benchmark decontamination: size-partitioned MinHash containment search with an exact check."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import ragged
from .common import bounded, staged

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of item texts that one scan of the documents looks for; more items take more scans.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 20


def _words(texts: pa.Array):
    """Bytes in lower case, start, end and hash of each word, and the words' offsets by text."""
    data, off = ragged.flat(texts)
    data = ragged.LOWER[data]
    start, end, by_text = ragged.word_bounds(data, off)
    return data, start, end, by_text, ragged.word_hashes(data, start, end)


def _phrase(data, start, end, first: int, n: int) -> bytes:
    return b" ".join(data[start[i] : end[i]].tobytes() for i in range(first, first + n))


class ItemIndex:
    """Bottom-k MinHash signatures of items, in classes of about equal size.

    An item of q shingles that lies in a document to the share THRESHOLD lacks at most q - need of them there, so one
    of any q - need + 1 of its shingles is in the document; the ones with the smallest hashes are its signature. A
    class spans a power of two of sizes; it has a largest signature hash, above which no document needs a look, and
    a least number of shingles, below which no document can contain an item of it. An index holds the items of one
    shingle length: SHINGLE words, or all words of the items that have fewer.
    """

    def __init__(self, rows: list[tuple], length: int):
        self.length = length
        data, start, end, by_text, words = _words(pa.array([r[1] or "" for r in rows], pa.string()))
        first, win_off = ragged.windows(by_text, length)
        hashes = ragged.window_hashes(words, first, length)
        self.ids, self.need, self.phrases, self.hashes = [], [], [], []
        for i, r in enumerate(rows):
            lo, hi = win_off[i], win_off[i + 1]
            if hi > lo and (length == SHINGLE or by_text[i + 1] - by_text[i] == length):
                self.ids.append(r[0])
                self.phrases.append(frozenset(_phrase(data, start, end, f, length) for f in first[lo:hi].tolist()))
                self.hashes.append(np.unique(hashes[lo:hi]))
                self.need.append(-(-len(self.phrases[-1]) * 4 // 5))
        classes: dict[int, list[tuple[int, int]]] = {}
        for k, h in enumerate(self.hashes):
            keep = len(self.phrases[k]) - self.need[k] + 1
            classes.setdefault(len(h).bit_length(), []).extend((int(x), k) for x in h[:keep])
        self.classes = []
        for size, pairs in sorted(classes.items()):
            pairs.sort()
            sig = np.array([p[0] for p in pairs], np.uint64)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(sig & np.uint64(len(seen) - 1)).astype(np.int64)] = True
            self.classes.append((-(-(1 << size - 1) * 4 // 5), sig, np.array([p[1] for p in pairs]), seen))

    def find(self, data, start, end, by_text, words):
        """(text, item, shared, total) of each containment of THRESHOLD or more, for texts as ``_words`` gives them."""
        first, win_off = ragged.windows(by_text, self.length)
        hashes = ragged.window_hashes(words, first, self.length)
        low = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        n_windows, found = np.diff(win_off), set()
        for least, sig, item, seen in self.classes:
            at = np.flatnonzero(seen[low])
            at = at[hashes[at] <= sig[-1]]
            lo, hi = np.searchsorted(sig, hashes[at], "left"), np.searchsorted(sig, hashes[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(win_off, at, "right") - 1
            fits = n_windows[text] >= least
            text, lo, hi = text[fits], lo[fits], hi[fits]
            found.update(zip(np.repeat(text, hi - lo).tolist(), item[ragged.ranges(hi - lo, lo)].tolist(), strict=True))
        for t, k in sorted(found):
            lo, hi = win_off[t], win_off[t + 1]
            hits = np.flatnonzero(np.isin(hashes[lo:hi], self.hashes[k]))
            if len(hits) + len(self.phrases[k]) - len(self.hashes[k]) < self.need[k]:
                continue
            shared = len(self.phrases[k] & {_phrase(data, start, end, f, self.length) for f in first[lo + hits].tolist()})
            if shared >= self.need[k]:
                yield t, self.ids[k], shared, len(self.phrases[k])


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items of which THRESHOLD of the shingles are in a document.

    Shingles are sets of five words in lower case (A-Z); an item of fewer words is one shingle of all its words. Items
    are a stated query set: blocks of BLOCK_BYTES of them are indexed on the driver and sent to the executors, and each
    block scans all documents once, without a shuffle.

    Defined results: null and blank texts match nothing on either side; rows that repeat on either side give a row
    each; empty tables give no rows; other columns are ignored, so their names don't matter.
    """
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"doc_id {kind(docs, 'doc_id')}, item_id {kind(items, 'item_id')}, n_shared bigint, n_item bigint, containment double"
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-(total["b"] + 64 * total["n"]) // BLOCK_BYTES))
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def scan(indices: list[ItemIndex]):
        def run(batches):
            for b in ragged.pieces(batches):
                words = _words(b.column(1))
                hits = [h for index in indices for h in index.find(*words)]
                if hits:
                    ids = pa.array([h[1] for h in hits], item_type)
                    shared, size = pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())
                    share = pa.array([h[2] / h[3] for h in hits], pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([h[0] for h in hits])), ids, shared, size, share], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return docs.mapInArrow(run, schema)

    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        made = [ItemIndex([tuple(r) for r in rows], n) for n in range(1, SHINGLE + 1)]
        part = scan([index for index in made if index.ids])
        parts.append(part if blocks == 1 else staged(part, "contained"))
    return reduce(DataFrame.union, parts)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that contain no item, with their own columns, whatever their names.

    Defined results: rows are told apart by doc_id and text together (SHA-256 of both), so rows of one doc_id are
    judged each by its text; null and blank texts stay; empty tables change nothing.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("~"))
    own = F.unhex(F.sha2(F.concat(F.length(name).cast("string"), name, F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    held = docs.select(own.alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    bad = staged(contained(docs.select(own.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("own")).distinct(), "contaminated")
    return held.join(bounded(bad), "own", "left_anti").select("row.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def contained_sql(docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL of op8."""
    words = lambda t, k: f"select {k}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {t} where text is not null"
    cut = lambda k: f"select distinct {k}, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as s"
    return f"""
with iw as ({words(items, 'item_id')}), dw as ({words(docs, 'doc_id')}), i as ({cut('item_id')} from (select *, least(len(w), {SHINGLE}) as n from iw where len(w) > 0)),
d as ({cut('doc_id')} from dw join (select distinct n from i) on len(w) >= n), size as (select item_id, count(*) as n_item from i group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*) / any_value(n_item)::double as containment
from d join i using (n, s) join size using (item_id) group by doc_id, item_id having 5 * count(*) >= 4 * any_value(n_item)
"""
