"""Which keys of a corpus occur more than once, with keys held as packed arrays instead of rows."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .common import staged
from .exchange import by_chunk, exchange

#: Keys that one task compares at once.
PART_KEYS = 2_000_000
#: Keys that are dealt out as one chunk; a text with more is a chunk of its own.
CHUNK_KEYS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (nulls empty) and key, the MD5 of the text: rows of one text share whatever is found in it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]


def recurring(docs: DataFrame, keys_of: Callable, parts: int, more: str | None = None) -> DataFrame:
    """(key, hits): for each text the indices (uint32 array) of its keys that another key of the corpus equals.

    ``keys_of(batch)`` gives for a batch of ``docs`` (key, text, ...) the keys of all its texts in a row (uint64), a
    flag for each key or None, the number of keys of each text and, if ``more`` is "wide", 32 further bits of each
    key. With flags only flagged keys are looked up, among all keys: the flagged ones are the index, all are probes.

    A chunk sends each of its keys once, dealt out by value as one packed array for each part, four bytes a key (the
    upper bits choose the part) or twelve if wide. What a chunk holds twice is a hit at once and only needs to be seen by
    others, so copies of one key, however many, reach a part once for each chunk that has them. A directory row keeps
    where the keys stood, so answers need indices only. Work and rows of a chunk are bounded by its keys, whatever the
    number of parts, and no task gets more at once than the keys of one part, of PART_KEYS or so.
    """
    wide = more == "wide"

    def dealt_out(text_keys, keys, flag, counts, extra):
        order = np.lexsort((extra, keys)) if wide else np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        if wide:
            same &= extra[order][1:] == extra[order][:-1]
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        alone = np.diff(np.append(head, len(order))) == 1
        flagged = np.ones(len(keys), bool) if flag is None else flag
        again = order[np.repeat(~alone, np.diff(np.append(head, len(order))))]
        again = again[flagged[again]].astype(np.uint32)  # hits within the chunk
        one = order[head]
        asks = alone & flagged[one]
        part = ((keys[one] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part * 2 + ~asks, kind="stable")
        one, part, asks = one[by_part], part[by_part], asks[by_part]
        some, edge = np.unique(part, return_index=True)
        edge, asked = np.append(edge, len(part)), np.concatenate([[0], np.cumsum(asks)])
        low = keys[one] if wide else (keys[one] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        chunk = hashlib.md5(b"".join(text_keys)).digest()
        body = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            body.append(np.int64(asked[hi] - asked[lo]).tobytes() + low[lo:hi].tobytes() + (extra[one[lo:hi]].tobytes() if wide else b""))
        memo = pickle.dumps((text_keys, counts.astype(np.uint32), again, some.astype(np.int32), asked[edge[:-1]].astype(np.int64), one[asks].astype(np.uint32)))
        return chunk, memo, list(zip(some.tolist(), body, strict=True))

    def deal(batches):
        text_keys, held, size = [], [], 0

        def chunk():
            keys, flag, counts, extra = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
            return dealt_out(text_keys, keys, flag, counts, extra)

        for b in ragged.pieces(batches):
            got = keys_of(b)
            if len(got[0]):
                text_keys += b.column("key").to_pylist()
                held.append(got)
                size += len(got[0])
            if size >= CHUNK_KEYS:
                yield chunk()
                text_keys, held, size = [], [], 0
        if size:
            yield chunk()

    def compare(part, chunks, bodies):
        size = 12 if wide else 4
        first = [int(np.frombuffer(x, np.int64, 1)[0]) for x in bodies]
        n = [(len(x) - 8) // size for x in bodies]
        keys = np.concatenate([np.frombuffer(x, np.uint64 if wide else np.uint32, k, 8) for x, k in zip(bodies, n, strict=True)])
        if wide:
            rest = np.concatenate([np.frombuffer(x, np.uint32, k, 8 + 8 * k) for x, k in zip(bodies, n, strict=True)])
            order = np.lexsort((rest, keys))
            same = (keys[order][1:] == keys[order][:-1]) & (rest[order][1:] == rest[order][:-1])
            twice = np.zeros(len(keys), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
        else:
            ordered = np.sort(keys)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])  # the probes' keys that came twice
            at = np.minimum(np.searchsorted(twice, keys), max(len(twice) - 1, 0))
            twice = twice[at] == keys if len(twice) else np.zeros(len(keys), bool)
        at = 0
        for chunk, f, k in zip(chunks, first, n, strict=True):
            hit = np.flatnonzero(twice[at : at + f]).astype(np.uint32)
            at += k
            if len(hit):
                yield chunk, hit.tobytes()

    def gather(_, memo, answers):
        text_keys, counts, again, some, edge, place = pickle.loads(memo)
        hits = [again] + [place[edge[np.searchsorted(some, p)] + np.frombuffer(x, np.uint32)] for p, x in answers]
        off = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        at = np.unique(np.concatenate(hits)).astype(np.int64)
        bound = np.searchsorted(at, off)
        texts = np.flatnonzero(bound[1:] > bound[:-1])
        return pa.RecordBatch.from_arrays([pa.array([text_keys[i] for i in texts], pa.binary()), pa.array([(at[bound[i] : bound[i + 1]] - off[i]).astype(np.uint32).tobytes() for i in texts], pa.binary())], names=["key", "hits"])

    back = by_chunk(exchange(docs, deal, compare, parts), gather, "key binary, hits binary")
    return staged(back.groupBy("key").agg(F.max("hits").alias("hits")), "recurring")


def parts_for(n_keys: float) -> int:
    return max(1, int(n_keys // PART_KEYS) + 1)
