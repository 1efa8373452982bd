"""Rounds in blocks against rounds of rows, on a graph dealt out in many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from loomfield.operators import blocks, graph


@pytest.fixture(scope="module")
def odd(spark):
    """Loops, edges both ways, repeated ones, ends that are no nodes, nodes without edges, and a hub."""
    draw = random.Random(7)
    ids = [f"n{i}" for i in range(60)]
    rows = [(draw.choice(ids[:50]), draw.choice(ids[:50]), draw.choice([0.2, 0.9, 0.0, None])) for _ in range(150)]
    rows += [("n3", ids[i], 1.0) for i in range(40)] + [rows[0], ("n1", "n1", 1.0), ("n1", "nobody", 1.0)]
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(rows, "source_id string, target_id string, confidence double")


def _both(monkeypatch, ask):
    """Answers by blocks of 32 links, whatever the hub, and by rows."""
    monkeypatch.setattr(blocks, "LINKS", 32)
    monkeypatch.setattr(blocks, "crowded", lambda degrees, most: False)
    in_blocks = ask()
    monkeypatch.setattr(blocks, "crowded", lambda degrees, most: True)
    return in_blocks, ask()


def test_pagerank_in_blocks(spark, odd, monkeypatch):
    seeds = spark.createDataFrame([("n1", 2.0), ("n55", 1.0)], "id string, weight double")
    found, rows = _both(monkeypatch, lambda: {r["id"]: r["mass"] for r in graph.personalized_pagerank(*odd, seeds, rounds=7).collect()})
    assert len(found) == 60 and abs(sum(found.values()) - 1) < 1e-9 and found["n55"] > 0
    assert found == pytest.approx(rows, abs=1e-12)


def test_labels_in_blocks(odd, monkeypatch):
    found, rows = _both(monkeypatch, lambda: {r["id"]: r["label"] for r in graph.label_propagation(*odd, rounds=4).collect()})
    assert found == rows and found["n59"] == "n59" and len(set(found.values())) < 50


def test_a_crowded_node_is_no_task(odd):
    nodes, edges = odd
    links = blocks.numbered(nodes.withColumn("n", F.substring("id", 2, 9).cast("long")), edges, F.lit(1.0))
    held = blocks.degrees(links)
    assert blocks.crowded(held, 40) and not blocks.crowded(held, 400)


def test_ids_of_a_domain_are_not_broadcast(odd):
    nodes, edges = odd
    kept = graph.within_domain(nodes, edges, F.col("id") != "n3")
    assert kept.count() == edges.where("source_id <> 'n3' and target_id not in ('n3', 'nobody')").count()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=shuffle_hash") == 2
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
