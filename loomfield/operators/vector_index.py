"""A stored vector index: inverted lists around k-means centres, product-quantised codes, exact scores for what the codes leave."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.operators.retrieval import BLOCK, DECIMALS, _best, _matrix
from loomfield.sources.tables import staged

#: Vectors that the centres are fitted on for each cell, and those that a quantiser is fitted on; all vectors are indexed.
PER_CELL, TRAIN = 64, 16_384
#: Codewords of a quantiser: a code takes a byte for each of a vector's parts.
WORDS, PARTS = 256, 16
#: Most cells by default; their centres go to every task.
MOST_CELLS = 16_384
#: The type that is compatible with every other.
ANY_TYPE = "paper"


def _parts(m: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into equal parts, padded with zeros: (parts, rows, width)."""
    width = -(-m.shape[1] // parts)
    padded = np.zeros((len(m), parts * width))
    padded[:, : m.shape[1]] = m
    return padded.reshape(len(m), parts, width).transpose(1, 0, 2)


def _nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each row."""
    return ((words**2).sum(1)[None, :] - 2 * x @ words.T).argmin(1)


def _lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of the rows of ``x``; if there are fewer rows than centres, the rows and zeros."""
    if len(x) <= k:
        return np.concatenate([x, np.zeros((k - len(x), x.shape[1]))])
    words = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest_word(x, words)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


@dataclass(frozen=True)
class VectorIndex:
    """Segments of (id, code, vector, ...) in folders by cell, with the model that made them."""

    spark: SparkSession
    path: str
    centers: np.ndarray
    words: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def insert(self, rows: DataFrame) -> VectorIndex:
        """Add (id, vector, ...) to the cells of the stored model; columns are those of the first rows. Nothing else is rewritten."""
        kept = [c for c in rows.columns if c not in ("id", "vector")]
        kind, wide = rows.schema["id"].dataType.simpleString(), rows.schema["vector"].dataType.simpleString()
        sent = self.spark.sparkContext.broadcast((self.centers, self.words))

        def encode(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                centers, words = sent.value
                m = _matrix(b.column(1))
                cell = (m @ centers.T).argmax(1)
                rest = _parts(m - centers[cell], len(words))
                code = np.stack([_nearest_word(x, w) for x, w in zip(rest, words, strict=True)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=[*b.schema.names, "cell", "code"])

        more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
        coded = rows.where("vector is not null").select("id", "vector", *kept).mapInArrow(encode, f"id {kind}, vector {wide}{more}, cell int, code binary")
        # a range sort spreads a crowded cell over tasks and files
        coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        return self

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells nearest to each vector, as a matrix of truth by cell."""
        out = np.zeros((len(vectors), len(self.centers)), bool)
        for lo in range(0, len(vectors), 64):
            score = vectors[lo : lo + 64] @ self.centers.T
            near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            np.put_along_axis(out[lo : lo + 64], near, True, axis=1)
        return out

    def files(self, vector: list[float], probes: int) -> DataFrame:
        """(file, bytes) of the cells that a question of this vector opens, for measuring."""
        cells = np.flatnonzero(self.probed(np.array([vector]), probes)[0]).tolist()
        return self.rows.where(F.col("cell").isin(cells)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()

    def search(self, questions: DataFrame, k: int, probes: int = 32, rerank: int | None = 40, where: Column | None = None, block: int = BLOCK) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` rows of greatest cosine for each question among its ``probes`` cells; ties by id.

        ``questions``: (query_id, vector), a stated set; with a column ``type`` on both sides, only rows of a question's type, or
        with ANY_TYPE on either side, count. ``where`` is a condition on the stored columns, part of the scan. Codes choose
        ``rerank`` times ``k`` candidates for each question among the rows of a cell that come to a task at once, whose vectors
        are compared where they lie, so candidates never travel; with ``rerank`` None all vectors of the cells are, and with as
        many probes as cells the result is the exact one.

        The cells of a block of questions prune the folders that are read; a task keeps its best for each question.
        """
        kind = self.rows.schema["id"].dataType.simpleString()
        typed = "type" in questions.columns and "type" in self.rows.columns
        columns = ["query_id", "vector", *(["type"] if typed else [])]
        asked = questions.where("vector is not null").withColumn("query_id", F.col("query_id").cast("string")).withColumn("vector", F.col("vector").cast("array<double>")).select(*columns)
        asked = staged(asked, "questions")
        blocks, parts = -(-asked.count() // block), []
        for i in range(blocks):
            held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # one block
            if held.num_rows:
                part = self._block(held, k, probes, rerank, where, typed, kind)
                parts.append(part if blocks == 1 else staged(part, "searched"))
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"query_id string, id {kind}, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _block(self, held: pa.Table, k: int, probes: int, rerank: int | None, where: Column | None, typed: bool, kind: str) -> DataFrame:
        names, vectors = held.column(0).to_pylist(), _matrix(held.column(1).combine_chunks())
        types = np.array(held.column(2).to_pylist(), object) if typed else None
        probed = self.probed(vectors, probes)
        sent = self.spark.sparkContext.broadcast((vectors, probed, self.centers, self.words, types))
        cells = np.flatnonzero(probed.any(0)).tolist()
        rows = self.rows if len(cells) == len(self.centers) else self.rows.where(F.col("cell").isin(cells))
        rows = rows if where is None else rows.where(where)
        own = [F.col("type")] if typed else []

        def by_code(q, cell, codes):
            vectors, _, centers, words, _ = sent.value
            code = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
            score = np.repeat((vectors[q] @ centers[cell])[:, None], len(codes), 1)
            for j, part in enumerate(_parts(vectors[q], len(words))):
                score += (part @ words[j].T)[:, code[:, j]]
            return score

        def run(batches):
            """Best ``k`` of each question in each task: of a batch's rows of one cell the codes choose, and the vectors decide."""
            found = None
            for b in batches:
                if not b.num_rows:
                    continue
                vectors, probed, _, _, types = sent.value
                ids, at = np.asarray(b.column(0).to_pylist()), b.column(1).to_numpy()
                for cell in np.unique(at):
                    q, rows = np.flatnonzero(probed[:, cell]), np.flatnonzero(at == cell)
                    fits = np.ones((len(q), len(rows)), bool)
                    if types is not None:
                        of_row = np.array(b.column("type").take(pa.array(rows)).to_pylist(), object)
                        fits = (types[q][:, None] == of_row[None, :]) | (types[q] == ANY_TYPE)[:, None] | (of_row == ANY_TYPE)[None, :]
                    if rerank is not None and len(rows) > rerank * k:
                        near = np.where(fits, by_code(q, cell, b.column("code").take(pa.array(rows))), -np.inf)
                        fits &= near >= np.partition(near, -rerank * k, axis=1)[:, -rerank * k][:, None]
                        some = np.flatnonzero(fits.any(0))
                        rows, fits = rows[some], fits[:, some]
                    if not fits.any():
                        continue
                    score = np.where(fits, np.round(vectors[q] @ _matrix(b.column(2).take(pa.array(rows))).T, DECIMALS), -np.inf)
                    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                    i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                    new = q[i], ids[rows[j]], score[i, j]
                    found = _best(*(new if found is None else (np.concatenate(x) for x in zip(found, new, strict=True))), k)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(found[1].tolist(), b.column(0).type), pa.array(found[2])], names=["q", "id", "score"])

        codes = [] if rerank is None else ["code"]
        near = rows.select("id", "cell", F.col("vector").cast("array<double>").alias("vector"), *codes, *own).mapInArrow(run, f"q int, id {kind}, score double")
        named = F.array(*[F.lit(n) for n in names])
        return near.select(named[F.col("q")].alias("query_id"), "id", "score")


def create(rows: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, seed: int = 42) -> VectorIndex:
    """Index (id, vector, ...) under ``path``; other columns are stored for conditions.

    Centres come from a distributed k-means over at most PER_CELL vectors for each cell, the quantisers of the vectors' parts
    from TRAIN of them, each part in a task of its own; both samples are the first by a hash, so reruns agree. Every vector is
    indexed: null ones are left out, zero vectors are similar to nothing, unequal widths raise.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)).select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = usable.count()
    cells = max(1, min(cells or int(n**0.5), n, MOST_CELLS))
    place = F.xxhash64(F.col("id").cast("string"))
    sample = staged(usable.orderBy(place).limit(PER_CELL * cells), "index-sample")
    if cells > 1:
        fitted = KMeans(k=cells, maxIter=10, seed=seed, initMode="random", distanceMeasure="cosine", featuresCol="v").fit(sample.select(array_to_vector("vector").alias("v")))
        centers = np.array(fitted.clusterCenters())
    else:
        centers = _matrix(sample.limit(1).toArrow().column(1).combine_chunks()) if n else np.zeros((1, 1))
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    parts = max(1, min(parts, centers.shape[1]))
    sent = spark.sparkContext.broadcast(centers)

    def cut(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                for j, x in enumerate(_parts(m - sent.value[(m @ sent.value.T).argmax(1)], parts)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, np.int32)), pa.array(list(x), pa.list_(pa.float64()))], names=["part", "x"])

    def quantiser(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        words = _lloyd(np.stack(sorted(map(tuple, df["x"]))), WORDS)
        return pd.DataFrame({"part": key[0], "word": range(WORDS), "x": list(words)})

    train = sample.orderBy(place).limit(TRAIN).select("vector")
    fitted = train.mapInArrow(cut, "part int, x array<double>").groupBy("part").applyInPandas(quantiser, "part int, word int, x array<double>")
    model = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "word int, x array<double>").select(F.lit(-1).alias("part"), "word", "x")
    model.union(fitted).write.parquet(f"{path}/model")
    return opened(spark, path).insert(rows)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index under ``path``; its model, bounded by cells and codewords, comes to the driver."""
    got = spark.read.parquet(f"{path}/model").orderBy("part", "word").toPandas()
    of = lambda p: np.stack(got["x"][got["part"] == p])
    parts = int(got["part"].max()) + 1
    width = -(-len(of(-1)[0]) // max(parts, 1))
    words = np.stack([of(j) for j in range(parts)]) if parts else np.zeros((1, WORDS, width))
    return VectorIndex(spark, path, of(-1), words)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers (query_id, id) that were found."""
    n = exact.count()
    return exact.join(found, ["query_id", "id"], "left_semi").count() / n if n else 1.0
