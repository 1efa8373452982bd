"""Token counts by rank-synchronous merging of byte-pair symbols in ragged arrays."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged

LIMIT = 2048
#: Distinct pre-tokens whose counts a worker remembers; beyond it starts anew.
REMEMBERED = 1 << 20
NO_RANK = np.int64(1) << 40
# Letters whose lower-case form the library has and Python's tables lack, and sigma, which it does not fit to its place.
NEWER_CASE = {0x3A3: 0x3C3, 0xA7CB: 0x264, 0xA7DC: 0x19B}
# Letters and numbers that Unicode 16.0, the library's version, added to Python's tables.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# End of fixed values.


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts the symbols that are left of pre-tokens when all merges are made."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab, suffix = held["model"]["vocab"], held["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in held["added_tokens"]]
        signs = byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], np.int64)
        self.final = np.array([vocab[c + suffix] for c in signs], np.int64)
        pairs, made = [], []
        for left, right in held["model"]["merges"]:
            pairs.append(vocab[left] << 32 | vocab[right])
            made.append(vocab[left + right])
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs, self.rank, self.made = np.array(pairs, np.int64)[order], order.astype(np.int64), np.array(made, np.int64)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kinds = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
        for kind, ranges in ((1, NEWER_LETTERS), (2, NEWER_NUMBERS)):
            for first, last in ranges:
                kinds[first : last + 1] = kind
        blank = regex.compile(r"\p{White_Space}")
        kinds[[c for c in range(0x3001) if blank.match(chr(c))]] = 0
        self.kinds = kinds
        letter, number = (self._class(kinds == kind) for kind in (1, 2))  # both paths take their classes from one table
        self.space = regex.compile(r"\p{White_Space}+")
        self.parts = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\p{{White_Space}}{letter}{number}]+")
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    @staticmethod
    def _class(member: np.ndarray) -> str:
        """The code points of a mask as ranges of a character class."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2).tolist())

    def merged(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token. All sequences merge their lowest-ranked pair at once, round by round."""
        size = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        off = np.concatenate([[0], np.cumsum(size)])
        sym = self.inner[data]
        sym[off[1:] - 1] = self.final[data[off[1:] - 1]]
        seq = np.repeat(np.arange(len(tokens)), size)
        left = size.copy()
        while len(sym) > 1:
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (seq[:-1] == seq[1:]), self.rank[at], NO_RANK)
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(np.append(rank, NO_RANK), heads)
            n = np.diff(np.append(heads, len(sym)))
            pick = (rank == np.repeat(best, n)[:-1]) & (rank < NO_RANK)
            # of overlapping pairs every second one merges, from the left
            run = np.flatnonzero(pick)
            if not len(run):
                break
            new_run = np.concatenate([[True], np.diff(run) > 1])
            run = run[(run - np.maximum.accumulate(np.where(new_run, run, 0))) % 2 == 0]
            sym[run] = self.made[rank[run]]
            alive = np.repeat(best < NO_RANK, n)
            np.subtract.at(left, seq[run], 1)
            alive[run + 1] = False
            sym, seq = sym[alive], seq[alive]
        return left

    def counts_of(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Counts of distinct pre-tokens by hash; text_of(i) gives the bytes of those not met yet."""
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero((at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != hashes) if len(self.known) else np.ones(len(hashes), bool))
        if len(new):
            got = self.merged([text_of(i) for i in new.tolist()])
            if len(self.known) > REMEMBERED:
                out = np.empty(len(hashes), np.int64)
                old = np.setdiff1d(np.arange(len(hashes)), new, assume_unique=True)
                out[new], out[old] = got, self.counts[at[old]]
                order = np.argsort(hashes)
                self.known, self.counts = hashes[order], out[order]
            else:
                known = np.concatenate([self.known, hashes[new]])
                order = np.argsort(known)
                self.known, self.counts = known[order], np.concatenate([self.counts, got])[order]
            at = np.searchsorted(self.known, hashes)
        return self.counts[at]

    def clean(self, text: str) -> str:
        """Composed, with runs of white space as one space, in lower case letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(NEWER_CASE)
        return self.space.sub(" ", text).lower() if not text.isascii() else text.lower()

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        flat, owner = [], []
        odd: list[tuple[int, bytes]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            bits = self.cut.split(text) if self.cut and "<|" in text else [text]
            total[i] += len(bits) - 1
            for bit in bits:
                bit = self.clean(bit)
                if "'" in bit:
                    odd.extend((i, m.encode()) for m in self.parts.findall(bit))
                elif bit:
                    flat.append(bit), owner.append(i)
        if flat:
            text = " ".join(flat)
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            kind = self.kinds[code]
            start = kind != 0
            start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            first = np.flatnonzero(start)
            end = kind != 0
            end[:-1] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            last = np.flatnonzero(end) + 1
            h = ragged.word_hashes(code.view(np.uint8), 4 * first, 4 * last)
            if len(h):
                unique, where, back = np.unique(h, return_index=True, return_inverse=True)
                n = self.counts_of(unique, lambda k: text[first[where[k]] : last[where[k]]].encode())[back]
                begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in flat])])[:-1]
                sums = np.concatenate([[0], np.cumsum(n)])
                edge = np.append(np.searchsorted(first, begins), len(first))
                np.add.at(total, owner, sums[edge[1:]] - sums[edge[:-1]])
        if odd:
            distinct = {t: k for k, t in enumerate(dict.fromkeys(t for _, t in odd))}
            n = self.merged(list(distinct))
            np.add.at(total, [i for i, _ in odd], n[[distinct[t] for _, t in odd]])
        return total


_mergers: dict[str, Merger] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a tokenizers .json file of word pairs with word ends, readable on every executor
    (it is part of the installed environment). Texts are split into pre-tokens in flat arrays, a batch's distinct
    pre-tokens are merged together, and a worker remembers a bounded number of counts.

    Defined results: null and empty texts have no bytes and no tokens; special strings inside a text count as one
    token each; long texts and long pre-tokens are counted whole; other columns are ignored.
    """

    def run(batches):
        merger = _mergers.get(vocabulary) or _mergers.setdefault(vocabulary, Merger(vocabulary))
        for b in ragged.pieces(batches):
            n = merger.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
