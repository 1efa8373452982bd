"""Texts on their way in: chunks with overlap, and the hashed embedding that needs no model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text as texts

# Sizes in code points, white space at the ends of a chunk, seed of the sign's hash, width.
SIZE, OVERLAP = 2000, 200
BLANK = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SIGN_SEED = 0x9DC5811C
WIDTH = 768
# End of fixed values.
#: Texts whose features are summed at once.
ROWS = 1024


def _pieces(text: str, size: int) -> Iterator[tuple[str, str, bool]]:
    """(joiner, piece, whether it must open a chunk): paragraphs, and the words of those longer than a chunk."""
    for paragraph in re.split(r"\n\n+", text):
        if len(paragraph) <= size:
            yield "\n\n", paragraph, False
        else:
            for i, word in enumerate(paragraph.split(" ")):
                yield " ", word, i == 0


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole paragraphs, or of words where a paragraph is too long; from the second on, each is preceded by
    the end of the one before. Null and empty texts have none."""
    raw: list[str] = []
    held: list[str] = []
    length = 0
    for joiner, piece, opens in _pieces(text or "", size):
        if opens or length + len(joiner) + len(piece) > size:
            if length:
                raw.append("".join(held).strip(BLANK))
            held, length = [piece], len(piece)
        else:
            held += [joiner, piece] if length else [piece]
            length += len(piece) + (len(joiner) if length else 0)
    if length:
        raw.append("".join(held).strip(BLANK))
    if overlap <= 0:
        return raw
    return raw[:1] + [f"{before[-overlap:]}\n\n{own}" for before, own in zip(raw, raw[1:])]


def chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, total, section, chunk, content_hash) of every text, without a shuffle.

    Packing needs what stands in the chunk so far, so Arrow batches go through Python; sections and hashes do not.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        for b in batches:
            for own, body in zip(b.column(0), b.column(1), strict=True):
                found = split_text(body.as_py(), size, overlap)
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * n, b.column(0).type), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(found, pa.string())], names=[key, "chunk_index", "total", "chunk"])

    out = docs.select(key, F.col(text).cast("string").alias("chunk")).mapInArrow(cut, f"`{key}` {kind}, chunk_index int, total int, chunk string")
    section = texts.section_of(F.col("chunk"), F.col("chunk_index"), F.col("total"))
    return out.withColumn("section", section).withColumn("content_hash", texts.content_hash(F.col("section"), F.col("chunk")))


def features(text: Column) -> Column:
    """Words, trigrams of words over three letters and pairs of neighbours, repeats included."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    trigrams = lambda w: F.when(F.length(w) > 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("#"), F.substring(w, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    pairs = F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b)), lambda p: p.isNotNull())
    return F.concat(words, F.flatten(F.transform(words, trigrams)), pairs)


def hashed_embedding(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, place, value): the places of a unit vector that are not zero.

    Each feature adds its sign at its place; the sums are damped by a square root, then scaled to length one. A text
    without features, or whose signs cancel, points to place 0. A text is one row, so nothing is shuffled or grouped:
    features and hashes come from Catalyst, numpy sums a batch's. ``key`` must be unique.
    """
    kind = docs.schema[key].dataType.simpleString()
    said = docs.select(key, features(F.col(text)).alias("f"))
    place = F.transform("f", lambda f: (texts.fnv1a(f) % width).cast("int"))
    even = F.transform("f", lambda f: texts.fnv1a(f, SIGN_SEED) % 2 == 0)

    def run(batches):
        for whole in batches:
            for b in (whole.slice(lo, ROWS) for lo in range(0, whole.num_rows, ROWS)):
                at = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                sign = np.where(b.column(2).flatten().to_numpy(zero_copy_only=False), 1.0, -1.0)
                cell, own = np.unique(at * width + b.column(1).flatten().to_numpy(), return_inverse=True)
                sums = np.bincount(own, sign, len(cell))
                cell, sums = cell[sums != 0], sums[sums != 0]
                row = cell // width
                size = np.sqrt(np.bincount(row, np.abs(sums), b.num_rows))
                none = np.flatnonzero(size == 0)
                row, cell = np.concatenate([row, none]), np.concatenate([cell % width, np.zeros(len(none), np.int64)])
                value = np.concatenate([np.sign(sums) * np.sqrt(np.abs(sums)) / size[row[: len(sums)]], np.ones(len(none))])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(value)], names=[key, "place", "value"])

    return said.select(key, place.alias("at"), even.alias("even")).mapInArrow(run, f"`{key}` {kind}, place int, value double")
