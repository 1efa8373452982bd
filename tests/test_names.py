import pytest
from pyspark.sql import functions as F

from loomfield.functions import names, text

PAIRS = [
    ("GNMT + RL [38]", "GNMT + RL Ensemble [38]", "model", False),
    ("Deep-Att + PosUnk Ensemble [39]", "Deep-Att + PosUnk [39]", "model", False),
    ("WMT 2014 English-to-German translation task", "WMT 2014 English-to-French translation task", "task", False),
    ("recurrent neural networks", "gated recurrent neural networks", "model", False),
    ("averaging the last 20 checkpoints", "averaging the last 5 checkpoints", "concept", False),
    ("Helios", "Helios system", "method", True),
    ("3DGS", "3D Gaussian Splatting", "method", True),
    ("PPR", "personalized page rank", "method", True),
    ("residual connection", "residual connection technique", "technique", True),
    ("Transformer", "Transformer models", "model", True),
    ("self-attention", "self-attention layers", "concept", True),
    ("Attention Is All You Need", "Attention Is All You Need Too", "paper", False),
    ("BERT", "bert", "model", True),
    ("", "BERT", "model", False),
    (None, "BERT", "model", False),
    ("4-layer transformer", "6-layer transformer", "model", False),
    ("BERT 2018 model", "BERT 2018", "model", True),
    ("3D-GS", "3D Gaussian Splatting", "method", True),
    ("P.P.R.", "personalized page rank", "method", True),
    ("x", "xylophone", "concept", False),
]
NAMES = [
    ("dmodel = 512", "drop", "high"),
    ("FFN(x) = max(0, xW1 + b1)W2 + b2 (2)", "drop", "high"),
    ("a model architecture eschewing recurrence and instead relying", "drop", "high"),
    ("input-feeding approach in which attentional vectors ht are con", "drop", "high"),
    ("learning contextual representations through a task to predict", "drop", "high"),
    ("Transformer", "keep", "high"),
    ("WMT 2014 English-to-German translation task", "keep", "high"),
    ("BLEU", "keep", "high"),
    ("3D Gaussian Splatting", "keep", "high"),
    ("GNMT + RL [38]", "review", "medium"),
    ("Bahdanau et al., 2015", "review", "medium"),
    ("  ", "drop", "high"),
    (None, "drop", "high"),
]


def test_merge_guard_is_symmetric(spark):
    df = spark.createDataFrame([p[:3] for p in PAIRS], "a string, b string, kind string")
    got = df.select("a", "b", names.may_merge(F.col("a"), F.col("b"), F.col("kind")).alias("x"), names.may_merge(F.col("b"), F.col("a"), F.col("kind")).alias("y")).collect()
    assert {(r["a"], r["b"]): (r["x"], r["y"]) for r in got} == {(a, b): (e, e) for a, b, _, e in PAIRS}


def test_judged_names(spark):
    df = spark.createDataFrame([(n,) for n, *_ in NAMES], "name string")
    got = df.select("name", names.judge_name(F.col("name")).alias("j")).collect()
    assert {r["name"]: tuple(r["j"])[:2] for r in got} == {n: (v, c) for n, v, c in NAMES}


@pytest.mark.parametrize(
    "a, b, verdict",
    [("our input-feeding approach", "input-feeding approach", "merge"), ("Base + reverse", "Base + reverse + dropout", "review"), ("BLEU", "Transformer", "keep"), ("our X system", "X", "merge"), ("The X", "x models", "merge")],
)
def test_judged_pairs(spark, a, b, verdict):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(names.judge_pair(F.col("a"), F.col("b"), F.lit("method")).alias("j"), names.survivor(F.col("a"), F.col("b")).alias("s")).first()
    assert row["j"]["verdict"] == verdict
    assert not a.endswith("approach") or row["s"] == "input-feeding approach"


def test_papers_on_either_side_never_merge(spark):
    df = spark.createDataFrame([("Helios", "Helios system", "paper", "method"), ("Helios", "Helios system", "method", "paper_reference"), ("Helios", "Helios system", "method", "concept")], "a string, b string, x string, y string")
    assert [r[0] for r in df.select(names.may_merge(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()] == [False, False, True]


def test_types(spark):
    kinds = spark.createDataFrame([(" Paper_Reference ", " exposes"), ("METHOD", "Outperforms X"), (" ", "belongs_to "), (None, None)], "t string, p string")
    got = kinds.select(text.entity_type(F.col("t")), text.edge_type(F.col("p")), text.inverted(F.col("p"))).collect()
    assert [tuple(r)[:2] for r in got] == [("paper", "exposes"), ("method", "improves"), ("concept", "belongs_to"), ("concept", "uses")]
    assert [r[0] for r in spark.createDataFrame([("extends",), ("improves",), ("belongs_to",), ("evaluates_on",)], "p string").select(text.inverted(F.col("p"))).collect()] == ["extended by", "improved by", "belongs to by", "evaluates on by"]


def test_identifiers(spark):
    df = spark.createDataFrame([("2308.04079",), ("2308.04079v2",), ("cs/0112017",), (" arXiv:2308.04079",), ("2308.04079/../x",), (None,)], "raw string")
    assert [r[0] for r in df.select(text.arxiv_id(F.col("raw"))).collect()] == ["2308.04079", "2308.04079v2", "cs/0112017", "2308.04079", None, None]


def test_model_replies(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('```json\n{"a": 1,}\n```',), ('Sure: {"a": 1} .',), ("nothing",)], "t string")
    got = df.select(F.try_variant_get(text.json_repaired(F.col("t")), "$.a", "int")).collect()
    assert [r[0] for r in got] == [1, 1, 1, None]
