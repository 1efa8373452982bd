"""Exact repeats of word passages by fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.sources.tables import release

from . import ragged
from .common import shuffled, staged
from .recurring import keyed, parts_for, recurring, total_bytes

WINDOW = 35
#: Bytes of text for each word that the number of parts reckons with; a wrong guess makes parts larger or smaller, no more.
WORD_BYTES = 6


def block_of(window: int) -> int:
    """Largest block length of which every window holds a whole aligned block."""
    return (window + 1) // 2


def _words(batch: pa.RecordBatch):
    data, off = ragged.flat(batch.column("text"))
    start, end, by_text = ragged.word_bounds(data, off)
    return data, start, end, by_text, ragged.word_hashes(data, start, end)


def _block_keys(window: int):
    block = block_of(window)

    def keys_of(batch):
        _, _, _, by_text, words = _words(batch)
        n = np.diff(by_text)
        count = np.where(n >= window, n - block + 1, 0)
        first = ragged.ranges(count, by_text[:-1])
        return ragged.window_hashes(words, first, block), (first - np.repeat(by_text[:-1], count)) % block == 0, count, None

    return keys_of


def _blocks_hit(hits: bytes, n: int, block: int) -> np.ndarray:
    """Block numbers from indices among a text's aligned windows: key i of the text is its window of words i on."""
    return np.frombuffer(hits, np.uint32).astype(np.int64) // block


def _candidates(hits: bytes, n: int, window: int) -> np.ndarray:
    """First words of the windows whose own aligned block was hit: the block is the first whole one inside."""
    block = block_of(window)
    q = _blocks_hit(hits, n, block) * block
    lo = np.maximum(q - block + 1, 0)
    hi = np.minimum(q + 1, n - window + 1)
    return ragged.ranges(np.maximum(hi - lo, 0), lo)


def _window_keys(window: int):
    def keys_of(batch):
        data, start, end, by_text, words = _words(batch)
        each = [_candidates(h, int(n), window) for h, n in zip(batch.column("hits").to_pylist(), np.diff(by_text), strict=True)]
        count = np.array([len(x) for x in each], np.int64)
        if not count.sum():
            return np.zeros(0, np.uint64), None, count, np.zeros(0, np.uint32)
        first = np.concatenate(each) + np.repeat(by_text[:-1], count)
        other = ragged.window_hashes(ragged.mix(words + np.uint64(0x632BE59BD9B4E019)), first, window)
        return ragged.window_hashes(words, first, window), None, count, (other >> np.uint64(32)).astype(np.uint32)

    return keys_of


def _sha(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    text, _ = ragged.joined(data, start, end)
    return hashlib.sha256(text[:-1].tobytes()).hexdigest() if len(start) else hashlib.sha256(b"").hexdigest()


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add to every (doc_id, text): n_words, n_removed, spans, kept_sha256; spans are maximal runs of repeated words.

    Non-overlapping blocks of half a window index the corpus; every rolling window of a block's length probes them.
    A window that is repeated holds a whole aligned block that another place of the corpus equals. Around such
    blocks the hits are extended: windows over a hit block are compared in full (96 bits of hash), and those that
    recur join to maximal spans [first word, last word). The text travels once to meet its hits, and texts with
    hits once more; copies, however many, share their text's key and are never paired.

    Defined results: null and blank texts have no words, kept_sha256 is that of the empty text; a text shorter than
    the window loses nothing; repeated rows are repeats of each other; an empty table gives no rows; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    words = total_bytes(docs) / WORD_BYTES
    blocks = recurring(docs.select("key", "text"), _block_keys(window), parts_for(words))
    release(spark)

    def first_pass(batches):
        for b in ragged.pieces(batches):
            data, off = ragged.flat(b.column("text"))
            start, end, by_text = ragged.word_bounds(data, off)
            hit = b.column("hits").is_valid().to_pylist()
            sha = [None if h else _sha(data, start[a:z], end[a:z]) for h, a, z in zip(hit, by_text[:-1], by_text[1:], strict=True)]
            text = pa.array([t if h else None for t, h in zip(b.column("text").to_pylist(), hit, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, b.column("key"), b.column("hits"), pa.array(np.diff(by_text)), pa.array(sha, pa.string())], names=["doc_id", "text", "key", "hits", "n_words", "sha"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    met = staged(docs.join(shuffled(blocks), "key", "left").select("doc_id", "text", "key", "hits").mapInArrow(first_pass, f"doc_id {kind}, text string, key binary, hits binary, n_words bigint, sha string"), "anchors")
    release(spark)
    open_ = met.where("hits is not null")
    found = recurring(open_.select("key", "text", "hits"), _window_keys(window), parts_for(open_.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]), "wide")
    found = found.withColumnRenamed("hits", "again")
    release(spark)

    def second_pass(batches):
        for b in ragged.pieces(batches):
            data, off = ragged.flat(b.column("text"))
            start, end, by_text = ragged.word_bounds(data, off)
            removed, sha, spans = [], [], []
            for i, (hits, again) in enumerate(zip(b.column("hits").to_pylist(), b.column("again").to_pylist(), strict=True)):
                a, z = by_text[i], by_text[i + 1]
                gone, runs = np.zeros(z - a, bool), []
                if again:
                    first = _candidates(hits, int(z - a), window)[np.frombuffer(again, np.uint32)]
                    first = np.sort(first)
                    new = np.flatnonzero(np.concatenate([[True], np.diff(first) > window]))
                    last = np.append(new[1:], len(first)) - 1
                    runs = list(zip(first[new].tolist(), (first[last] + window).tolist(), strict=True))
                    for x, y in runs:
                        gone[x:y] = True
                removed.append(int(gone.sum()))
                sha.append(_sha(data, start[a:z][~gone], end[a:z][~gone]))
                spans.append(",".join(f"{x}:{y}" for x, y in runs))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    done = open_.join(shuffled(found), "key", "left").select("doc_id", "text", "hits", "again", "n_words").mapInArrow(second_pass, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans string")
    clear = met.where("hits is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit("").alias("spans"))
    return done.union(clear)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def repeats_sql(docs: str = "documents", window: int = WINDOW) -> str:
    """DuckDB SQL of op4."""
    return f"""
with w as (
  select row_number() over () as id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {docs}
), win as (
  select id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) as s from (select id, w, unnest(range(1, len(w) - {window - 2})) as i from w)
), again as (
  select id, i from (select id, i, count(*) over (partition by s) as c from win) where c > 1
), edge as (
  select id, i, case when i - lag(i) over (partition by id order by i) <= {window} then 0 else 1 end as new from again
), run as (
  select id, min(i) as a, max(i) + {window} as b from (select id, i, sum(new) over (partition by id order by i) as r from edge) group by id, r
), gone as (
  select id, sum(b - a) as n, list((a - 1)::varchar || ':' || (b - 1)::varchar order by a) as spans, flatten(list(range(a, b) order by a)) as lost from run group by id
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, coalesce(array_to_string(spans, ','), '') as spans,
       sha256(coalesce(array_to_string(case when lost is null then w else (select list(w[k] order by k) from (select unnest(list_filter(range(1, len(w) + 1), lambda j: not list_contains(lost, j))) as k)) end, ' '), '')) as kept_sha256
from w left join gone using (id)
"""
