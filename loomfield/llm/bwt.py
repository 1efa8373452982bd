"""Exact repeats of byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .anchors import release
from .common import bounded, shuffled, staged
from .recurring import keyed, parts_for, recurring, total_bytes

LENGTH = 200
#: Bytes of the strings that choose which texts are compared; every LENGTH bytes hold LENGTH - SAMPLE + 1 of them.
SAMPLE = 96
#: Bytes of segments in one transform, and of one sample's distinct segments beyond which longer samples split them.
BATCH, GROUP_BYTES = 1 << 18, 1 << 17
#: Windows after which a segment of text that repeats itself ends at its next period; bytes of segments held at once.
LONGEST, HELD = 4096, 1 << 22


class Transform:
    """Burrows-Wheeler transform of segments, ordered as deep as ``depth`` needs; no match crosses a segment's end."""

    def __init__(self, data: np.ndarray, off: np.ndarray, depth: int):
        size = np.diff(off)
        sym = np.zeros(len(data) + len(size), np.int64)
        place = ragged.ranges(size, off[:-1] + np.arange(len(size)))
        sym[place] = data.astype(np.int64) + 1
        self.left = np.zeros(len(sym), np.int64)  # bytes up to the segment's end
        self.left[place] = np.repeat(size, size) - ragged.ranges(size)
        self.place = place
        n, step = len(sym), 7
        pad = np.concatenate([sym, np.zeros(step, np.int64)])
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(step):
            alive &= pad[k : n + k] != 0
            key = key << 9 | np.where(alive, pad[k : n + k], 0)
        order = np.argsort(key)
        # a suffix that meets its end within the depth so far is unlike all others
        rank, open_ = self._ranks(key[order], order, alive)
        while step < depth and len(open_):
            base, nxt = rank[order[open_]], order[open_] + step
            key = base << 32 | np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
            sub = np.argsort(key)
            order[open_] = order[open_][sub]
            step *= 2
            alive = self.left[order[open_]] >= step
            key = key[sub]
            head = np.concatenate([[True], (key[1:] != key[:-1]) | ~alive[1:] | ~alive[:-1]])
            at = open_[head]
            rank[order[open_]] = np.repeat(at, np.diff(np.append(np.flatnonzero(head), len(open_))))
            single = head & np.append(head[1:], True)
            open_ = open_[~single]
        self.suffix = order
        self.bwt = sym[order - 1].astype(np.uint16)
        by_char = np.argsort(self.bwt, kind="stable")
        self.last_to_first = np.empty(n, np.int64)
        self.last_to_first[by_char] = np.arange(n)

    @staticmethod
    def _ranks(key, order, alive):
        whole = alive[order]
        head = np.concatenate([[True], (key[1:] != key[:-1]) | ~whole[1:] | ~whole[:-1]])
        rank = np.empty(len(key), np.int64)
        heads = np.flatnonzero(head)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, len(key))))
        return rank, np.flatnonzero(~(head & np.append(head[1:], True)))

    def repeated(self, length: int) -> np.ndarray:
        """Flag of each byte of the segments: a string of ``length`` bytes that starts there starts elsewhere too.

        Intervals of rows that share a prefix grow by one byte on the left, all of one prefix length at a time. An
        interval's end that no shorter prefix has marked parts two rows whose common prefix has that length, and only
        such intervals grow on. After ``length`` rounds the rows that are not parted share ``length`` bytes or more.
        """
        n = len(self.bwt)
        parted = np.zeros(n + 1, bool)
        parted[[0, n]] = True
        lo, hi = np.array([0]), np.array([n])
        for _ in range(length):
            size = hi - lo
            total = int(size.sum())
            if not total:
                break
            rows = ragged.ranges(size, lo)
            owner = np.repeat(np.arange(len(lo)), size)
            real = self.bwt[rows] != 0
            to, owner, char = self.last_to_first[rows[real]], owner[real], self.bwt[rows[real]]
            if not len(to):
                break
            if total > n >> 4:
                row_owner, row_char = np.full(n, -1, np.int64), np.zeros(n, np.uint16)
                row_owner[to], row_char[to] = owner, char
                to = np.flatnonzero(row_owner >= 0)
                owner, char = row_owner[to], row_char[to]
            else:
                order = np.argsort(to)
                to, owner, char = to[order], owner[order], char[order]
            head = np.concatenate([[True], (np.diff(to) != 1) | (owner[1:] != owner[:-1]) | (char[1:] != char[:-1])])
            lo = to[head]
            hi = to[np.append(np.flatnonzero(head)[1:], len(to)) - 1] + 1
            new = ~parted[hi]
            lo, hi = lo[new], hi[new]
            parted[hi] = True
        long = self.left[self.suffix] >= length
        alike = ~parted[1:n] & long[1:] & long[:-1]
        row = np.zeros(n, bool)
        row[1:] |= alike
        row[:-1] |= alike
        out = np.zeros(n, bool)
        out[self.suffix[row]] = True
        return out[self.place]


def segments(data: np.ndarray, off: np.ndarray, length: int, sample: int):
    """Start, windows, sample hash of each segment, and the segments' offsets by text.

    A segment is a run of windows of ``length`` bytes whose smallest sample hash is the same one, at the same place:
    equal windows lie in segments of equal hash, wherever they are. Where the text repeats itself within a window, the
    place moves on by a period while the hash stays; from its first move on, a segment holds many periods.
    """
    span = length - sample + 1
    n_samples = len(data) - sample + 1
    count = np.maximum(np.diff(off) - length + 1, 0)
    if n_samples < span or not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    sums = ragged.prefix(data.astype(np.uint64) + np.uint64(1), ragged.BYTE_BASE)
    at = np.arange(n_samples)
    h = ragged.mix(ragged.span_hash(sums, at, at + sample, ragged.BYTE_BASE))
    full = np.concatenate([h, np.full(-n_samples % span, np.uint64(2**64 - 1))]).reshape(-1, span)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n = n_samples - span + 1
    least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
    valid = np.zeros(n + 1, bool)
    valid[ragged.ranges(count, off[:-1])] = True
    moved = np.zeros(n, bool)  # the sample of window i has the value of window i - 1, at another place
    moved[1:] = (least[1:] == least[:-1]) & (h[: n - 1] == least[:-1]) & valid[: n - 1]
    apart = np.ones(n, bool)  # window i does not go on the segment of window i - 1
    apart[1:] = (least[1:] != least[:-1]) | ~valid[: n - 1]
    apart[off[:-1][off[:-1] < n]] = True
    moved &= ~apart
    at = np.flatnonzero(moved)
    if len(at):
        # text that repeats itself: two segments of one sample at least, and the second goes on for LONGEST windows
        run = np.cumsum(apart)[at]
        edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            k = lo
            while k < hi:
                apart[at[k]] = True
                k = lo + int(np.searchsorted(at[lo:hi], at[k] + LONGEST))
    start = np.flatnonzero(apart & valid[:n])
    ends = np.flatnonzero(valid[:n] & (np.append(apart[1:], True) | ~valid[1:])) + 1
    return start, ends - start, least[start], np.searchsorted(start, off)


def _segments_of(batch: pa.RecordBatch, length: int, sample: int):
    data, off = ragged.flat(batch.column("text"))
    return data, off, *segments(data, off, length, sample)


def _judge(length: int):
    """Windows that recur of segments sorted by sample: (sample, name, body, n) to (name, flags), where any do."""

    def judge(batches):
        sample_, name, body, n, done = [], [], [], [], 0

        def out():
            flag = []
            s = np.array(sample_)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            many = np.repeat(np.diff(edge) > 1, np.diff(edge))
            at = np.flatnonzero(many)
            got = {}
            if len(at):
                off = np.concatenate([[0], np.cumsum([len(body[i]) for i in at])])
                rep = Transform(np.frombuffer(b"".join(body[i] for i in at), np.uint8), off, length).repeated(length)
                got = {i: rep[off[k] : off[k + 1] - length + 1] for k, i in enumerate(at.tolist())}
            for i, x in enumerate(body):
                w = len(x) - length + 1
                f = np.ones(w, bool) if n[i] > 1 else got.get(i, np.zeros(w, bool))
                flag.append(np.packbits(f).tobytes() if f.any() else None)
            keep = [i for i, f in enumerate(flag) if f]
            return pa.RecordBatch.from_arrays([pa.array([name[i] for i in keep], pa.binary()), pa.array([flag[i] for i in keep], pa.binary())], names=["name", "flags"])

        for b in batches:
            for s, x, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if done >= BATCH and s != sample_[-1]:
                    yield out()
                    sample_, name, body, n, done = [], [], [], [], 0
                sample_.append(s), name.append(x), body.append(t), n.append(k)
                done += len(t)
        if body:
            yield out()

    return judge


def _judged(distinct: DataFrame, length: int, longer: list[int]) -> DataFrame:
    """(name, flags) of the segments of ``distinct`` (sample, name, body, n); ``longer`` samples split crowded ones."""
    few, extra = distinct, None
    sizes = distinct.groupBy("sample").agg(F.sum(F.octet_length("body")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    crowded = staged(sizes.where((F.col("bytes") > GROUP_BYTES) & (F.col("n") > 1)).select("sample"), "bwt-crowded") if longer else None
    if crowded is not None and crowded.take(1):
        few = distinct.join(bounded(crowded), "sample", "left_anti")
        many = distinct.join(bounded(crowded), "sample", "left_semi").select("name", "body", "n")

        def split(batches):
            for b in batches:
                for name, body, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data = np.frombuffer(body, np.uint8)
                    start, size, key, _ = segments(data, np.array([0, len(data)]), length, longer[0])
                    parts = [body[x:y] for x, y in zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(parts), pa.binary()), pa.array(start.astype(np.int32)), pa.array(key.view(np.int64)), pa.array([hashlib.md5(x).digest() for x in parts], pa.binary()), pa.array(parts, pa.binary()), pa.array([n] * len(parts), pa.int64())],
                        names=["whole", "at", "sample", "name", "body", "n"],
                    )

        parts = staged(many.mapInArrow(split, "whole binary, at int, sample bigint, name binary, body binary, n bigint"), "bwt-parts")
        inner = staged(parts.groupBy("sample", "name").agg(F.first("body").alias("body"), F.sum("n").alias("n")), "bwt-segments")
        got = parts.select("whole", "at", "name").join(shuffled(_judged(inner, length, longer[1:])), "name").groupBy("whole").agg(F.collect_list(F.struct("at", "flags")).alias("found"))

        def pack(batches):
            for b in batches:
                flags = []
                for found in b.column(1).to_pylist():
                    f = np.zeros(max(x["at"] + 8 * len(x["flags"]) for x in found), bool)
                    for x in found:
                        one = np.unpackbits(np.frombuffer(x["flags"], np.uint8)).astype(bool)
                        f[x["at"] : x["at"] + len(one)] |= one
                    flags.append(np.packbits(f).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flags, pa.binary())], names=["name", "flags"])

        extra = got.mapInArrow(pack, "name binary, flags binary")
    judged = few.repartition("sample").sortWithinPartitions("sample").mapInArrow(_judge(length), "name binary, flags binary")
    return judged if extra is None else judged.union(extra)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """Add to every (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, spans of removed bytes [first, last).

    Every window of ``length`` bytes is dealt out by its smallest sample hash, so equal windows meet; windows in a
    row with the same one travel as one segment. Segments whose sample occurs once are done. Equal segments fall
    together before they are dealt out, with their number. Where different segments share a sample, a
    Burrows-Wheeler transform of them finds the windows that recur; a segment alone on its sample recurs if it came
    twice. Samples with over GROUP_BYTES of different segments are split by longer samples of the same windows, in the
    end by whole windows, and go through the same transform, so no task gathers a hot sample.

    Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; removing may
    cut a character in two, so only the hash of the bytes that remain is returned with the spans; repeated rows are
    repeats of each other; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    n_bytes = total_bytes(docs)

    def sample_keys(batch):
        _, _, _, _, key, by_text = _segments_of(batch, length, sample)
        return key, None, np.diff(by_text), None

    def flagless(batch):
        key, _, count, _ = sample_keys(batch)
        return key, np.ones(len(key), bool), count, None

    hits = recurring(docs.select("key", "text"), flagless, parts_for(2 * n_bytes / (length - sample + 2)))
    release(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def first_pass(batches):
        for b in ragged.pieces(batches):
            texts, hit = b.column("text").to_pylist(), b.column("hits").is_valid().to_pylist()
            raw = [t.encode() for t in texts]
            sha = [None if h else hashlib.sha256(t).hexdigest() for t, h in zip(raw, hit, strict=True)]
            text = pa.array([t if h else None for t, h in zip(texts, hit, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, b.column("key"), b.column("hits"), pa.array([len(t) for t in raw], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text", "key", "hits", "n_bytes", "sha"])

    met = staged(docs.join(shuffled(hits), "key", "left").select("doc_id", "text", "key", "hits").mapInArrow(first_pass, f"doc_id {kind}, text string, key binary, hits binary, n_bytes bigint, sha string"), "bwt")
    release(spark)
    open_ = met.where("hits is not null")

    def hit_segments(b):
        """Some of a batch's hit segments at a time: text, place in it, sample, body and name of each."""
        data, off, start, size, key, by_text = _segments_of(b, length, sample)
        some = [by_text[i] + np.frombuffer(h, np.uint32).astype(np.int64) for i, h in enumerate(b.column("hits").to_pylist())]
        text = np.repeat(np.arange(len(some)), [len(x) for x in some])
        at = np.concatenate(some) if some else np.zeros(0, np.int64)
        upto, lo = np.cumsum(size[at] + length - 1), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HELD, "right")))
            first, last = start[at[lo:hi]], start[at[lo:hi]] + size[at[lo:hi]] + length - 1
            body = [data[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            yield text[lo:hi], first - off[text[lo:hi]], key[at[lo:hi]].view(np.int64), body, [hashlib.md5(x).digest() for x in body]
            lo = hi

    def emit(batches):
        for b in ragged.pieces(batches):
            for _, _, key, body, name in hit_segments(b):
                first, count = {}, {}
                for i, x in enumerate(name):
                    first.setdefault(x, i)
                    count[x] = count.get(x, 0) + 1
                at = list(first.values())
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(list(first), pa.binary()), pa.array([body[i] for i in at], pa.binary()), pa.array(list(count.values()), pa.int64())], names=["sample", "name", "body", "n"])

    distinct = open_.select("text", "hits").mapInArrow(emit, "sample bigint, name binary, body binary, n bigint").groupBy("sample", "name").agg(F.first("body").alias("body"), F.sum("n").alias("n"))
    distinct = staged(distinct, "bwt-segments")
    release(spark)
    longer = [x for x in (length - (length - sample) // 2, length - (length - sample) // 8, length) if x > sample]
    judged = staged(_judged(distinct, length, longer), "bwt-judged")
    release(spark)

    def places(batches):
        for b in ragged.pieces(batches):
            keys = b.column("key").to_pylist()
            for text, at, _, _, name in hit_segments(b):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in text.tolist()], pa.binary()), pa.array(at.astype(np.int32)), pa.array(name, pa.binary())], names=["key", "at", "name"])

    where = open_.select("key", "text", "hits").mapInArrow(places, "key binary, at int, name binary")
    found = where.join(shuffled(judged), "name").groupBy("key").agg(F.collect_set(F.struct("at", "flags")).alias("found"))

    def last_pass(batches):
        for b in ragged.pieces(batches):
            removed, n_spans, sha, spans = [], [], [], []
            for t, got in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                raw = np.frombuffer(t.encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int64)
                for x in got or ():
                    first = x["at"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["flags"], np.uint8)))
                    gone[first] += 1
                    gone[first + length] -= 1
                cover = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
                removed.append(int(cover.sum()))
                n_spans.append(len(edge) // 2)
                sha.append(hashlib.sha256(raw[~cover].tobytes()).hexdigest())
                spans.append(",".join(f"{x}:{y}" for x, y in edge.reshape(-1, 2).tolist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = open_.join(shuffled(found), "key", "left").select("doc_id", "text", "found", "n_bytes").mapInArrow(last_pass, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string")
    zero = F.lit(0).cast("long")
    clear = met.where("hits is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit("").alias("spans"))
    return done.union(clear)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
