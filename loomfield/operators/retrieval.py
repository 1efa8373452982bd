"""Retrieval: cosine and lexical rankings, reciprocal rank fusion, compression by maximal marginal relevance."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomfield.functions import words
from loomfield.sources.tables import staged

#: Fused score of a rank: weight / (FUSE + rank).
FUSE = 60
#: BM25 term saturation and length normalisation.
K1, B = 1.2, 0.75
#: Questions compared with all rows in one pass.
BLOCK = 1024
#: Texts whose terms a task holds at once.
TEXTS = 128
#: Decimals of a cosine that count: equal vectors tie however their products were rounded.
DECIMALS = 12


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as the rows of a matrix, each of length one (zero vectors stay zero)."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = set(pc.list_value_length(column).to_pylist())
    if len(widths) != 1:
        raise ValueError(f"vectors of unequal widths: {sorted(widths)}")
    m = flat.reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The ``k`` rows of greatest score for each query, ties by id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    head = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(query)), 0)) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], score[keep]


def nearest(questions: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of greatest cosine for each question; ties by id.

    ``questions``: (query_id, vector), a stated set; ``rows``: (id, vector). Questions go out in blocks of about
    ``block`` vectors, of which one is on the driver at a time; a task multiplies matrices and keeps its best ``k``, so
    only those are shuffled. Null vectors are left out on both sides, zero vectors are similar to nothing (0), and
    unequal widths raise.
    """
    spark, kind, kind_of_id = rows.sparkSession, rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    asked = staged(questions.where("vector is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "questions")
    blocks = -(-asked.count() // block)
    rows = rows.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    schema = f"query_id string, id {kind}, score double"

    def scan(names: list[str], sent):
        def run(batches):
            found = None
            for b in batches:
                if not b.num_rows:
                    continue
                score = np.round(sent.value @ _matrix(b.column(1)).T, DECIMALS)
                ids = np.asarray(b.column(0).to_pylist())
                least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                query, at = np.nonzero(score >= least[:, None])
                new = query, ids[at], score[query, at]
                found = _best(*(new if found is None else (np.concatenate(x) for x in zip(found, new, strict=True))), k)
            if found is not None:
                query, ids, score = found
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query], pa.string()), pa.array(ids.tolist(), kind_of_id), pa.array(score)], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, schema)

    parts = []
    for i in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # one block
        if held.num_rows:
            sent = spark.sparkContext.broadcast(_matrix(held.column(1).combine_chunks()))
            part = scan(held.column(0).to_pylist(), sent)
            parts.append(part if blocks == 1 else staged(part, "nearest"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_index(docs: DataFrame, id_column: str, text_column: str, stemmed: bool = False, only: frozenset | None = None) -> DataFrame:
    """Inverted index (id, term, tf, length), one text a row, made without a shuffle.

    Terms are lower-case runs of letters and digits; ``stemmed`` leaves out stop words and strips suffixes. ``only``
    keeps just these terms, so a search never moves the others, and adds a row of the empty term for each text that has any.
    """
    kind, split = docs.schema[id_column].dataType.simpleString(), words.terms if stemmed else words.words

    def run(batches):
        for whole in batches:
            for b in (whole.slice(lo, TEXTS) for lo in range(0, whole.num_rows, TEXTS)):
                ids, terms, tf, length = [], [], [], []
                for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    listed = split(text)
                    counts = Counter(listed)
                    if only is not None and listed:
                        counts[""] = len(listed)
                    for t in counts if only is None else counts.keys() & (only | {""}):
                        ids.append(own), terms.append(t), tf.append(counts[t]), length.append(len(listed))
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(length, pa.int64())], names=["id", "term", "tf", "length"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, term string, tf bigint, length bigint")


def lexical(docs: DataFrame, id_column: str, text_column: str, questions: dict[str, str], stemmed: bool = True) -> DataFrame:
    """(query_id, id, score) of the texts with every term of a question, scored by BM25; blank questions find nothing.

    ``questions`` is a stated set of id and text. Only their terms leave the scan.
    """
    split = words.terms if stemmed else words.words
    asked = [(q, t, len(set(split(text)))) for q, text in questions.items() for t in sorted(set(split(text)))]
    spark = docs.sparkSession
    if not asked:
        return spark.createDataFrame([], f"query_id string, id {docs.schema[id_column].dataType.simpleString()}, score double")
    found = staged(lexical_index(docs, id_column, text_column, stemmed, frozenset(t for _, t, _ in asked)), "lexical")
    size = found.where("term = ''").agg(F.count("*").alias("n"), F.sum("tf").alias("terms")).first()
    n_docs, mean, hits = size["n"], (size["terms"] or 0) / max(size["n"], 1), found.where("term <> ''")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (mean or 1.0)))
    wanted = F.broadcast(spark.createDataFrame(asked, "query_id string, term string, n int"))  # a stated set
    scored = hits.join(F.broadcast(df), "term").withColumn("part", idf * tf).join(wanted, "term")  # df: terms of the questions only
    return scored.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("found"), F.first("n").alias("n")).where("found = n").select("query_id", "id", "score")


def ranked(scores: DataFrame, signal: str, weight: float) -> DataFrame:
    """A list for fusion: (query_id, signal, id, rank, weight), by score, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.select("query_id", F.lit(signal).alias("signal"), "id", F.row_number().over(order).alias("rank"), F.lit(weight).alias("weight"))


def fuse(lists: DataFrame, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, score, relevance, rank, signals); weight 0 counts for nothing, ties by id.

    ``relevance`` is the score over the best one of the question.
    """
    summed = lists.where("weight > 0").groupBy("query_id", "id").agg(
        F.sum(F.col("weight") / (FUSE + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals")
    )
    best = F.max("score").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    fused = summed.withColumn("relevance", F.when(best > 0, F.col("score") / best).otherwise(0.0)).withColumn("rank", F.row_number().over(order))
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def compress(candidates: DataFrame, items: int = 12, budget: float = float("inf"), balance: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance for each question: (query_id, id, place).

    ``candidates``: (query_id, id, relevance, cost, vector), already bounded by fusion's ``limit``. Each step takes the
    candidate of greatest balance * relevance - (1 - balance) * greatest cosine with those taken (0 at least); those over
    the remaining budget are passed over; the first in (relevance, id) order wins ties.
    """
    kind = candidates.schema["id"].dataType.simpleString()

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["relevance", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = np.array([np.asarray(v, dtype=float) for v in rows["vector"]])
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
        relevance, cost = rows["relevance"].to_numpy(float), rows["cost"].to_numpy(float)
        near, open_, left, taken = np.zeros(len(rows)), np.ones(len(rows), bool), budget, []
        while len(taken) < items and (fits := open_ & (cost <= left)).any():
            gain = np.where(fits, balance * relevance - (1 - balance) * near, -np.inf)
            i = int(gain.argmax())
            taken.append(i)
            open_[i], left = False, left - cost[i]
            near = np.maximum(near, unit @ unit[i])
        return pd.DataFrame({"query_id": rows["query_id"].iloc[taken], "id": rows["id"].iloc[taken], "place": range(1, len(taken) + 1)})

    need = candidates.select(F.col("query_id").cast("string").alias("query_id"), "id", "relevance", "cost", "vector")
    return need.groupBy("query_id").applyInPandas(pick, f"query_id string, id {kind}, place int")
