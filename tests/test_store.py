"""Connectors, writes, audits, listings, queues and the hierarchy: small fixtures with results known by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield import api, domains
from loomfield.operators import audit, browse, dataflow, evaluation, field, hyperbolic, maintenance, writes
from loomfield.sources import connectors, generate

SPEC = {
    "openapi": "3.0.0", "info": {"title": " Pets ", "version": "1.2", "description": "All pets. "},
    "components": {"securitySchemes": {"key": {"type": "apiKey", "description": "A key."}}},
    "paths": {
        "/pets": {
            "get": {"operationId": "listPets", "summary": "List", "tags": ["Pets", "pets", " "], "security": [{"key": []}], "responses": {"200": {"schema": {"items": [{"$ref": "#/components/schemas/Pet"}, {"$ref": "#/components/schemas/Pet"}]}}}},
            "post": {"requestBody": {"$ref": "#/components/schemas/New.Pet"}, "deprecated": True, "responses": {"default": {"$ref": "other.json#/Error"}}},
        },
        "/x": None,
    },
}


def test_api_descriptions(spark):
    bodies = [("a", json.dumps(SPEC)), ("b", "openapi: 3.0"), ("c", "{"), ("d", '{"openapi": "3"}'), ("e", '{"swagger": "2", "paths": {}}'), ("f", None), ("g", "[1]")]
    docs = connectors.connector(" OpenAPI ").collect(spark.createDataFrame(bodies, "source_id string, body string"))
    got = {r["source_id"]: r for r in docs.collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a": None, "b": "YAML, not JSON", "c": "not valid JSON", "d": "no paths", "e": "no operations", "f": "not valid JSON", "g": "no version field"}
    assert (got["a"]["title"], got["a"]["external_id"], got["a"]["summary"]) == ("Pets v1.2", "openapi:Pets v1.2", "All pets.")
    entities, relations = connectors.unit_rows(docs)
    seen = [(r["unit"], r["mention"], r["type"]) for r in entities.orderBy("unit", "place").collect()]
    assert seen == [(0, "Pets v1.2", "api"), (0, "key", "auth"), (1, "Pets v1.2", "api"), (1, "listPets", "endpoint"), (1, "Pets", "capability"), (1, "key", "auth"), (1, "Pet", "schema"), (2, "Pets v1.2", "api"), (2, "POST /pets", "endpoint"), (2, "New.Pet", "schema")]
    said = [(r["section"], r["subject"], r["predicate"], r["object"]) for r in relations.orderBy("unit", "place").collect()]
    assert said[0] == ("api", "Pets v1.2", "requires", "key") and ("GET /pets", "listPets", "returns", "Pet") in said and ("POST /pets", "POST /pets", "accepts", "New.Pet") in said and len(said) == 7
    evidence = {r["object"]: r["evidence"] for r in relations.where("predicate = 'exposes'").collect()}
    assert evidence == {"listPets": "listPets (GET /pets) in Pets v1.2: List", "POST /pets": "POST /pets (POST /pets) in Pets v1.2. This operation is deprecated."}
    with pytest.raises(connectors.UnknownConnectorError):
        connectors.connector("soap")


def test_paper_metadata(spark):
    feed = "<feed><title>query</title><entry><title>On\n Things</title><summary> Many\n things. </summary><published>2023-08-08T17:00:00Z</published><author> <name>Ada B</name></author><author><name> Bo C </name></author></entry></feed>"
    gone = "<feed><title>query</title><entry><title>Error</title><summary>bad id</summary></entry></feed>"
    docs = connectors.connector("arxiv").collect(spark.createDataFrame([("1", feed), ("2", gone), ("3", "<feed><title>query</title></feed>"), ("4", None)], "source_id string, body string"))
    got = {r["source_id"]: tuple(r)[1:] for r in docs.collect()}
    assert got == {"1": ("On Things", "Many things.", ["Ada B", "Bo C"], "2023-08-08", None), "2": ("Error", "bad id", [], "", "no such paper: bad id"), "3": ("Paper 3", "", [], "", None), "4": ("Paper 4", "", [], "", None)}
    papers = spark.createDataFrame([("p1", ["Ada B", "Bo C", "ada b ", " "]), ("p2", ["BO C"])], "paper_id string, authors array<string>")
    authors, links = connectors.author_links(papers)
    assert sorted(map(tuple, authors.collect())) == [("ada b", "Ada B"), ("bo c", "Bo C")]
    assert sorted(map(tuple, links.collect())) == [("p1", "ada b", 1, True), ("p1", "bo c", 2, False), ("p2", "bo c", 1, True)]
    assert sorted(map(tuple, connectors.coauthors(links).collect())) == [("ada b", 1, 1), ("bo c", 2, 1)]
    asked = spark.createDataFrame(list(enumerate(["2308.04079", "arXiv:2308.04079", "nope", "2005.14165", "1706.03762"])), "place int, raw string")
    known = spark.createDataFrame([("2005.14165",)], "paper string")
    status = lambda most: [r["status"] for r in connectors.arxiv_batch(asked, known, most).orderBy("place").collect()]
    assert status(500) == ["accepted", "repeated", "invalid", "known", "accepted"] and status(1) == ["rejected", "repeated", "invalid", "known", "rejected"]


def test_mentions_twins_and_relationships(spark):
    entities = spark.createDataFrame([(1, 0, " Helios ", "Method"), (1, 1, "helios", "dataset"), (1, 2, "Helios system", "method"), (1, 3, "", "x"), (2, 0, "Helios", "method"), (1, 4, "BERT", "model"), (1, 5, "bert models", "model")], "chunk int, place int, mention string, type string")
    relations = spark.createDataFrame([(1, 0, "Helios", "improves upon", "Zeus", None, "e1"), (1, 1, "Helios", "uses", "Helios System", 0.9, "e2"), (1, 2, "Helios", "uses", None, 0.9, "e3")], "chunk int, place int, subject string, predicate string, object string, confidence double, evidence string")
    mentions = writes.gather_mentions(entities, relations)
    got = [(r["chunk"], r["place"], r["key"], r["mention"], r["type"]) for r in mentions.orderBy("chunk", "place").collect()]
    assert got == [(1, 1, "helios", "Helios", "method"), (1, 2, "helios system", "Helios system", "method"), (1, 3, "bert", "BERT", "model"), (1, 4, "bert models", "bert models", "model"), (1, 5, "zeus", "Zeus", "concept"), (2, 1, "helios", "Helios", "method")]
    vector = F.when(F.col("key").startswith("helios"), F.array(F.lit(1.0), F.lit(0.1))).when(F.col("key").startswith("bert"), F.array(F.lit(0.1), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.11)))
    fresh = mentions.withColumn("vector", vector)
    names = writes.twins(fresh)
    held = {(r["chunk"], r["key"]): r["canonical"] for r in names.collect()}
    assert held == {(1, "helios"): "Helios", (1, "helios system"): "Helios", (1, "bert"): "BERT", (1, "bert models"): "BERT", (1, "zeus"): "Zeus", (2, "helios"): "Helios"}
    assert {r["canonical"] for r in writes.twins(fresh, writes.Merging.EXACT).collect()} == {"Helios", "Helios system", "BERT", "bert models", "Zeus"}
    said = writes.canonical_relations(relations, names).collect()
    assert [(r["source"], r["target"], r["type"], r["confidence"]) for r in said] == [("Helios", "Zeus", "improves", 0.5)]


def test_nodes_and_mention_edges_are_written_once(spark):
    nodes = spark.createDataFrame([("n1", "method", None, "Helios", "p0")], "id string, type string, domain string, name string, paper_id string")
    wanted = spark.createDataFrame([("method", None, "HELIOS ", "p1"), ("method", "nlp", "helios", "p1"), ("paper", "nlp", "On Things", "p1"), ("method", "nlp", "Helios", "p2")], "type string, domain string, name string, paper_id string")
    once = writes.create_or_get(nodes, wanted)
    assert sorted((r["name"], r["domain"], r["paper_id"]) for r in once.collect() if r["id"] != "n1") == [("On Things", "nlp", None), ("helios", "nlp", "p1")]
    assert once.count() == writes.create_or_get(once, wanted).count() == 3
    edges = spark.createDataFrame([("e1", "P", "a", "mentions", None, 1.0)], "id string, source_id string, target_id string, type string, domain string, confidence double")
    sources = spark.createDataFrame([("e1", "p", "s", 0, None)], "edge_id string, paper_id string, section string, chunk_index int, text string")
    named = spark.createDataFrame([("P", "a", None, "p", "s", 0), ("P", "a", None, "p", "s", 1), ("P", "b", None, "p", "s", 1), ("P", "P", None, "p", "s", 1)], "paper_node string, target_id string, domain string, paper_id string, section string, chunk_index int")
    one = writes.mention_edges(edges, sources, named)
    two = writes.mention_edges(*one, named)
    assert [df.count() for df in one] == [df.count() for df in two] == [2, 3]
    known = spark.createDataFrame([(1, 0, "Big Helios", "x"), (1, 1, "Helios", "y")], "chunk int, place int, name string, id string")
    asked = spark.createDataFrame([(1, "helios"), (1, "Helios model"), (1, "lio"), (1, "Zeus"), (2, "helios")], "chunk int, name string")
    assert {(r["chunk"], r["name"]): r["id"] for r in writes.fuzzy_ends(asked, known).collect()} == {(1, "helios"): "y", (1, "Helios model"): "y", (1, "lio"): "x"}
    accepted = spark.createDataFrame([("r1", "a", "b", " ", "nlp", 0.0, "p", "s", 0, "x" * 1200), ("r2", "a", "b", "uses", "nlp", 0.7, "p", "s", 0, "")], "id string, source_id string, target_id string, type string, domain string, confidence double, paper_id string, section string, chunk_index int, evidence string")
    e, s, p = (df.collect() for df in writes.relation_rows(accepted))
    assert [(r["type"], r["confidence"]) for r in e] == [("uses", 0.5), ("uses", 0.7)] and [len(r["text"]) for r in s] == [1000, 0] and [len(r["text"]) for r in p] == [500]


def graph_tables(spark):
    nodes = [("a", "input-feeding approach", "method", None), ("b", "our input-feeding approach", "method", None), ("c", "Base", "method", None), ("d", "Base + dropout", "method", None), ("e", "x = 3", "method", None), ("f", "Lonely", "method", None), ("g", "Far", "method", "nlp"), ("P", "A paper", "paper", None), ("Q", "Q paper", "paper", None)]
    edges = [("1", "P", "a", "mentions", 1), ("2", "P", "b", "mentions", 2), ("3", "P", "c", "mentions", 3), ("4", "P", "d", "mentions", 4), ("5", "P", "e", "mentions", 5), ("6", "a", "b", "uses", 6), ("7", "b", "c", "uses", 7), ("8", "a", "c", "uses", 8), ("9", "Q", "b", "mentions", 9), ("10", "g", "P", "uses", 1)]
    return {
        "nodes": spark.createDataFrame(nodes, "id string, name string, type string, domain string"),
        "edges": spark.createDataFrame([(*e, None) for e in edges], "id string, source_id string, target_id string, type string, created_at int, domain string"),
        "sources": spark.createDataFrame([(str(i), f"p{i}") for i in range(1, 11)], "edge_id string, paper_id string"),
        "propositions": spark.createDataFrame([("q1", ["b", "c"]), ("q2", ["a", "b"]), ("q3", ["d"])], "id string, node_ids array<string>"),
        "node_vectors": spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("e", [1.0])], "id string, vector array<double>"),
    }


def test_audit_and_acting_on_it(spark):
    tables = graph_tables(spark)
    found = audit.audit(tables["nodes"], tables["edges"], "default")
    got = {(r["node_id"], r["related_id"]): (r["detector"], r["verdict"], r["confidence"]) for r in found.collect()}
    assert got == {("b", "a"): ("duplicate-within-paper", "merge", "high"), ("c", "d"): ("duplicate-within-paper", "review", "low"), ("e", None): ("malformed-name", "drop", "high"), ("f", None): ("orphan", "review", "medium")}
    ids = {r["node_id"]: r["id"] for r in found.collect()}
    assert audit.audit(tables["nodes"], tables["edges"], "nlp").count() == 0
    after, marked = audit.applied(tables, found, [ids["b"], ids["e"]])
    assert sorted(r["id"] for r in after["nodes"].collect()) == ["P", "Q", "a", "c", "d", "f", "g"]
    assert sorted((r["id"], r["source_id"], r["target_id"]) for r in after["edges"].collect()) == [("1", "P", "a"), ("10", "g", "P"), ("3", "P", "c"), ("4", "P", "d"), ("7", "a", "c"), ("9", "Q", "a")]
    assert sorted((r["edge_id"], r["paper_id"]) for r in after["sources"].collect()) == [("1", "p1"), ("1", "p2"), ("10", "p10"), ("3", "p3"), ("4", "p4"), ("7", "p7"), ("7", "p8"), ("9", "p9")]
    assert {r["id"]: r["node_ids"] for r in after["propositions"].collect()} == {"q1": ["a", "c"], "q2": ["a"], "q3": ["d"]}
    assert [r["id"] for r in after["node_vectors"].collect()] == ["a"]
    assert {r["node_id"]: r["status"] for r in marked.collect()} == {"b": "applied", "e": "applied", "c": "proposed", "f": "proposed"}
    for bad in ([ids["c"]], ["unknown"]):
        with pytest.raises(ValueError):
            audit.applied(tables, found, bad)
    with pytest.raises(ValueError):
        audit.applied(tables, marked, [ids["b"]])
    kept = audit.dismissed(marked, [ids["f"], ids["b"]])
    assert {r["node_id"]: r["status"] for r in kept.collect()}["f"] == "dismissed" and {r["node_id"]: r["status"] for r in kept.collect()}["b"] == "applied"
    assert audit.replaced(kept, found, "default").count() == 3 + 4
    assert [r["confidence"] for r in audit.listed(found).collect()] == ["high", "high", "medium", "low"]
    assert sorted(map(tuple, audit.summary(found).collect())) == [("drop", "high", 1), ("merge", "high", 1), ("review", "low", 1), ("review", "medium", 1)]


def test_chains_of_merges(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "loser string, keeper string")
    got = audit.keepers(pairs(("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"))).collect()
    assert sorted(map(tuple, got)) == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "d")]
    with pytest.raises(ValueError):
        audit.keepers(pairs(("a", "b"), ("b", "a")))
    nodes = spark.createDataFrame([("n2", "X ", None, 1), ("n1", "x", None, 2), ("n3", "x", "nlp", 0)], "id string, name string, domain string, created_at int")
    assert [tuple(r) for r in audit.identity_mapping(nodes).collect()] == [("n1", "n2")]


def test_pages_and_lookups(spark):
    assert [browse.bounded(x, 50) for x in (None, "x", "nan", -3, 10**9, "7")] == [50, 50, 50, 1, 500, 7]
    nodes = spark.createDataFrame([("n1", "3D Gaussian Splatting", "method"), ("n2", "50% off", "concept"), ("n3", "gaussian", "method")], "id string, name string, type string")
    assert [r["id"] for r in browse.search(nodes, "GAUSS", "method").orderBy("id").collect()] == ["n1", "n3"] and browse.search(nodes, "%").count() == 1
    rows, total = browse.page(nodes, ["id"], 2, 1)
    assert [r["id"] for r in rows.collect()] == ["n2", "n3"] and total.first()["total"] == 3
    assert browse.lookup(nodes, ["n1", "zz"]).count() == 1 and browse.lookup(nodes, ["n1"], strict=True).count() == 0
    names = spark.createDataFrame([(" Gaussian",), ("none",)], "name string")
    assert [tuple(r) for r in browse.probe(names, nodes).collect()] == [(" Gaussian", "n3")]
    edges = spark.createDataFrame([("e1", "n3", "n1", "improves", 0.9), ("e2", "n3", "n2", "evaluates_on", 0.5)], "id string, source_id string, target_id string, type string, confidence double")
    assert [r["source_name"] for r in browse.pointing_at(edges, nodes, "improves", ["%3dgs%", "%3D gaussian splatting%"]).collect()] == ["gaussian"]
    assert sorted((r["direction"], r["method"], r["peer"]) for r in browse.relationships(edges, nodes, "splatting").collect()) == [("in", "3D Gaussian Splatting", "gaussian")]
    sources = spark.createDataFrame([("e1", "p1", "intro", 1, "late"), ("e1", "p1", "intro", 0, "early")], "edge_id string, paper_id string, section string, chunk_index int, text string")
    papers = spark.createDataFrame([("p1", "On")], "id string, title string")
    assert browse.provenance(edges, nodes, sources, papers, "e1").count() == 2
    got = browse.lens_rows(nodes, edges, sources, "n1").collect()
    assert [(r["role"], r["phrase"], r["peer_name"], r["evidence"]) for r in got] == [("contributes", "improved by", "gaussian", "early")]
    props = spark.createDataFrame([("q1", ["n1"]), ("q2", ["n1", "n2"]), ("q3", ["n3"])], "id string, node_ids array<string>")
    assert [r["id"] for r in browse.mentioning(props, "n1", 1).collect()] == ["q1"] and browse.mentioning_any(props, ["n2", "n3"]).count() == 2


def test_papers_that_are_documents(spark):
    nodes = spark.createDataFrame([("a", "On Things", "paper", None, "p1"), ("b", "arXiv preprint", "paper", None, "p1"), ("c", "Alone", "paper", None, "p2"), ("d", "On Things", "method", None, "p1")], "id string, name string, type string, domain string, paper_id string")
    documents = spark.createDataFrame([("p1", "ON things"), ("p2", "alone")], "id string, title string")
    edges = spark.createDataFrame([("a", "b", "mentions"), ("a", "d", "uses"), ("b", "d", "uses")], "source_id string, target_id string, type string")
    assert [tuple(r)[0:1] + tuple(r)[3:] for r in browse.papers(nodes, edges, documents).collect()] == [("a", 1, 1, 2), ("c", 0, 0, 1)]


def test_anchored_windows_by_hand(spark):
    rng = random.Random(2)
    events = [(i, rng.choice(["x", "x", "x", "y", None]), round(rng.uniform(0, 300), 1)) for i in range(200)]
    got = {r["event_id"]: r for r in dataflow.anchored_windows(spark.createDataFrame(events, "event_id bigint, who string, t double").repartition(5), "who", F.col("t"), 20.0, 3).collect()}
    state = {}
    for i, who, t in sorted(events, key=lambda e: (e[2], e[0])):
        start, n = state.get(who, (None, 0))
        start, n = (start, n + 1) if start is not None and t < start + 20 else (t, 1)
        state[who] = start, n
        r = got[i]
        assert (r["window_start"], r["place"], r["allowed"], r["remaining"], r["reset"]) == (start, n, n <= 3, max(3 - n, 0), start + 20)


def test_jobs_and_batches(spark):
    log = [("a", o) for o in ("claimed", "failed", "claimed", "interrupted", "claimed", "failed")] + [("b", "permanent"), ("c", "failed"), ("c", "failed"), ("c", "failed"), ("d", "failed"), ("d", "completed")] + [("e", "claimed")] * 25
    got = {r["job"]: r["status"] for r in dataflow.after_attempts(spark.createDataFrame(log, "job string, outcome string")).collect()}
    assert got == {"a": "queued", "b": "failed", "c": "failed", "d": "completed", "e": "failed"}
    jobs = spark.createDataFrame([("j1", "failed", "w", 3, f"{dataflow.MISCOUNTED} (3)", 5), ("j2", "failed", "w", 3, "boom", 5), ("j3", "queued", None, 0, None, None)], "id string, status string, owner string, attempts int, error string, lease_expires_at int")
    assert {r["id"]: (r["status"], r["owner"], r["attempts"]) for r in dataflow.requeued(jobs).collect()} == {"j1": ("queued", None, 0), "j2": ("failed", "w", 3), "j3": ("queued", None, 0)}
    rows = spark.createDataFrame([("x", "completed"), ("x", "failed"), ("y", "completed"), ("y", "paused")], "batch string, status string")
    got = {r["batch"]: (r["completed"], r["paused"], r["total"], r["complete"]) for r in dataflow.batch_progress(rows, "batch", ("completed", "paused")).collect()}
    assert got == {"x": (1, 0, 2, True), "y": (1, 1, 2, False)}
    asked = spark.createDataFrame([("x", 10), ("y", 500)], "batch string, incoming int")
    assert [r["admitted"] for r in dataflow.admitted(asked, 5).orderBy("batch").collect()] == [True, False]
    chunks = spark.createDataFrame([("p", 0, 1), ("p", 1, 5), ("q", 0, 9)], "paper_id string, chunk_index int, started_at int")
    assert dataflow.until_paused(chunks, spark.createDataFrame([("p", 5), ("p", 7)], "paper_id string, paused_at int")).count() == 2
    lanes = spark.createDataFrame([(i, "ab"[i % 3 == 0], None if i % 5 else "w", i // 2) for i in range(500)], "id int, lane string, owner string, created_at int").repartition(7)
    want = {}
    for lane in "ab":
        rest = sorted((i // 2, i) for i in range(500) if "ab"[i % 3 == 0] == lane and i % 5)
        want |= {i: n for n, (_, i) in enumerate(rest, 1)}
    assert {r["id"]: r["position"] for r in dataflow.queue_position(lanes, "lane").collect()} == want


def test_maintenance(spark):
    tables = graph_tables(spark)
    props = spark.createDataFrame([("p", "P", "s", None, ["a", "f", "P"])], "paper_id string, paper_node string, section string, domain string, node_ids array<string>")
    edges, new = maintenance.backfilled(tables["edges"].withColumn("confidence", F.lit(1.0)), props)
    assert edges.count() == 11 and [(r["paper_id"], r["section"]) for r in new.collect()] == [("p", "s")]
    assert sorted(r["id"] for r in maintenance.without_vector(tables["nodes"], tables["node_vectors"]).collect()) == ["P", "Q", "c", "d", "f", "g"]
    row = maintenance.coverage(tables["nodes"], tables["edges"]).first()
    assert (row["nodes"], row["edges"], row["isolated"], row["edges_per_node"], row["percent_isolated"]) == (9, 10, 1, pytest.approx(10 / 9), pytest.approx(100 / 9))
    store = {
        "papers": spark.createDataFrame([("p1", None, "completed"), ("p2", "nlp", "completed")], "id string, domain string, status string"),
        "nodes": spark.createDataFrame([("a", "p1", None), ("b", "p1", None), ("c", "p2", None), ("d", "p1", "nlp")], "id string, paper_id string, domain string"),
        "edges": spark.createDataFrame([("e1", "a", "c"), ("e2", "b", "c")], "id string, source_id string, target_id string"),
        "sources": spark.createDataFrame([("e1", "p1", 0), ("e2", "p1", 0), ("e2", "p2", 0)], "edge_id string, paper_id string, chunk_index int"),
    }
    moved = maintenance.moved_paper(store, "p1", "nlp")
    assert sorted(r["id"] for r in moved["nodes"].collect()) == ["b", "c", "d"] and [r["id"] for r in moved["edges"].collect()] == ["e2"]
    assert {r["id"]: (r["domain"], r["status"]) for r in moved["papers"].collect()} == {"p1": ("nlp", "pending"), "p2": ("nlp", "completed")}
    assert maintenance.moved_paper(store, "p2", "nlp")["edges"].count() == 2
    log = spark.createDataFrame([("field", "embed", 5, 1.0, "m1"), ("field", "ask", 7, 2.0, "m2"), ("field", "ask", 1, 1.0, None)], "mode string, operation string, tokens int, latency double, model string")
    assert {(r["operation"], r["calls"], r["tokens"], tuple(r["models"])) for r in maintenance.usage(log).collect()} == {("embed", 1, 5, ("m1",)), ("ask", 2, 8, ("m2",)), (None, 3, 13, ("m1", "m2"))}
    versions = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (1, "w", 0)], "k int, v string, version int")
    picks = {maintenance.upsert(versions.where("v = 'w'"), versions.where("v <> 'w'").repartition(n), ["k"], "version").first()["v"] for n in (1, 2, 5)}
    assert len(picks) == 1
    papers = spark.createDataFrame([("p1", "T" * 60, "nlp")], "id string, title string, domain string")
    nodes = spark.createDataFrame([("a", "p1", None, True), ("b", "p1", "nlp", True), ("c", "p1", None, False)], "id string, paper_id string, domain string, connected boolean")
    assert [tuple(r) for r in maintenance.drift_by_title(papers, nodes).collect()] == [("T" * 44, "nlp", None, 2, 1)]
    assert sorted((r["name"], r["rows"], r["unowned"]) for r in maintenance.null_domains({"nodes": nodes, "papers": papers}).collect()) == [("nodes", 3, 2), ("papers", 1, 0)]
    both = browse.lasts([papers, papers.withColumn("title", F.lit("new"))], "id").collect()
    assert [r["title"] for r in both] == ["new"]
    assert sorted(map(str, browse.domains_used({"n": nodes, "p": papers}).collect())) == sorted(map(str, [("n", None), ("n", "nlp"), ("p", "nlp")])) or browse.domains_used({"n": nodes, "p": papers}).count() == 3


def test_hierarchy_orders_a_tree(spark):
    edges = [(f"n{i}", f"n{(i - 1) // 2}", "extends", None) for i in range(1, 15)]
    nodes = spark.createDataFrame([(f"n{i}", None) for i in range(15)], "id string, domain string")
    links = spark.createDataFrame(edges, "source_id string, target_id string, type string, domain string")
    points = hyperbolic.train(nodes, links, ("extends",), epochs=60)
    held = {r["id"]: np.array(r["point"]) for r in points.collect()}
    again = {r["id"]: np.array(r["point"]) for r in hyperbolic.train(nodes.repartition(4), links.repartition(3), ("extends",), epochs=60).collect()}
    assert all((held[k] == again[k]).all() for k in held) and all(np.linalg.norm(p) < 1 for p in held.values())
    near = np.mean([hyperbolic.distances(held[a], held[b]) for a, b, *_ in edges])
    assert near < np.mean([hyperbolic.distances(held[a], held[b]) for a in held for b in held if a != b])
    got = hyperbolic.hierarchy(points.select("id", "point"), "n1", 3).collect()
    size = np.linalg.norm(held["n1"])
    assert got and all((r["norm"] < size) == (r["side"] == "general") for r in got)
    assert {r["id"] for r in got} <= set(sorted((k for k in held if k != "n1"), key=lambda k: (hyperbolic.distances(held["n1"], held[k]), k))[:9])
    assert hyperbolic.hierarchy(points.select("id", "point"), "zz").count() == 0


def test_slope_is_that_of_the_distance():
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 4)) / 5
    for i in range(4):
        step = np.eye(4)[i] * 1e-5
        assert hyperbolic._slope(u[None], v[None])[0, i] == pytest.approx((hyperbolic.distances(u + step, v) - hyperbolic.distances(u - step, v)) / 2e-5, rel=1e-2)


def test_generated_graph(spark):
    nodes, vectors = generate.load_nodes(spark, 500, width=8)
    edges = generate.load_edges(spark, 500, 4)
    assert nodes.count() == 500 and edges.count() == 2000 and edges.where("source_id = target_id").count() == 0
    assert all(abs(math.hypot(*r["vector"]) - 1) < 1e-9 for r in vectors.limit(50).collect())
    gap = edges.select(F.pmod(F.substring("target_id", 6, 10).cast("int") - F.substring("source_id", 6, 10).cast("int"), F.lit(500)).alias("g"))
    assert 0.05 < gap.where("g > 51").count() / 2000 < 0.2
    assert sorted(map(tuple, generate.load_edges(spark, 50).collect())) == sorted(map(tuple, generate.load_edges(spark, 50).repartition(3).collect()))


def test_the_api(spark):
    registry = domains.Registry.standard()
    listing = {r["id"]: r for r in registry.listing(spark).collect()}
    assert sorted(listing) == ["api-surface", "default", "gaussian-splatting", "nlp"] and listing["nlp"]["seeds"][0] == "1706.03762"
    from loomfield.operators import evalset

    store, *_ = evalset.corpus(spark, 2)
    front = api.Field(store, registry)
    assert front.list_domains() == sorted(listing)
    got = front.query_field(["zeta1 corvid1 analysis1"], "nlp").first()["context"]
    assert got.startswith("[1] EVALSET zeta1 corvid1 analysis1 is evaluated directly")
    assert [r["id"] for r in front.find_entity("ZETA0", "nlp").collect()] == ["00000-anchor"] and front.find_entity("zeta0", "api-surface").count() == 0
    nodes, edges = front.get_subgraph("00000-hub", 1, "nlp")
    assert nodes.count() == 15 and edges.count() == 14
    with pytest.raises(domains.UnknownDomainError):
        front.query_field(["x"], "nlpp")
    assert {r["name"]: (r["rows"], r["unfit"]) for r in front.health().collect()} == {"nodes": (36, 0), "edges": (32, 0), "node_vectors": (36, 0), "propositions": (36, 0)}
    shares = evaluation.shares(spark.createDataFrame([("a", 999), ("b", 1)], "t string, n int")).collect()
    assert {r["t"]: (round(r["share"], 3), r["bar"]) for r in shares} == {"a": (99.9, 100.0), "b": (0.1, 1.5)}
    assert isinstance(field.Options().depth, int)


def test_rules_extract_stated_relationships(spark):
    from loomfield.operators import extraction
    from loomfield import protocols

    text = "Mip-Splatting improves 3D Gaussian Splatting model by a lot. We like it. Scaffold-GS is evaluated on the Tanks and Temples dataset! nothing uses this"
    entities, relations = extraction.by_rules(spark.createDataFrame([(1, text), (2, None), (3, "")], "chunk int, text string"))
    got = [(r["chunk"], r["subject"], r["type"], r["object"]) for r in relations.orderBy("place").collect()]
    assert got == [(1, "Mip-Splatting", "improves", "3D Gaussian Splatting"), (1, "Scaffold-GS", "evaluates_on", "Tanks and Temples")]
    assert {(r["mention"], r["type"]) for r in entities.collect()} == {("Mip-Splatting", "concept"), ("3D Gaussian Splatting", "method"), ("Scaffold-GS", "concept"), ("Tanks and Temples", "dataset")}
    assert "edge_type" in protocols.register_functions(spark)
    assert tuple(spark.sql("SELECT edge_type('Improved by X'), edge_type(' exposes '), entity_type(' PAPER_REFERENCE'), edge_role('extends'), normalise_name(' A ')").first()) == ("improves", "exposes", "paper", "builds_on", "a")


def test_leases(spark):
    rows = [("a", "queued", None, 0, None), ("b", "running", "w1", 1, "2024-01-01 00:00:00"), ("c", "running", "w2", 25, "2023-01-01 00:00:00"), ("d", "running", "w2", 1, "2024-01-01 02:00:00")]
    jobs = spark.createDataFrame(rows, "id string, status string, owner string, attempts int, lease string").withColumn("lease_expires_at", F.to_timestamp("lease")).drop("lease")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    state = lambda df: {r["id"]: (r["status"], r["owner"], r["attempts"], str(r["lease_expires_at"])[11:]) for r in df.collect()}
    taken = state(dataflow.leased(jobs, spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), "w3", now))
    assert taken["a"] == ("running", "w3", 1, "01:02:00") and taken["b"] == ("running", "w1", 1, "00:00:00")
    assert state(dataflow.heartbeat(jobs, "w1", now))["b"][3] == "01:02:00"
    assert {k: v[0] for k, v in state(dataflow.reap(jobs, now)).items()} == {"a": "queued", "b": "queued", "c": "failed", "d": "running"}
    assert {k: v[0] for k, v in state(dataflow.swept(jobs, "w2", now)).items()} == {"a": "queued", "b": "queued", "c": "failed", "d": "queued"}
    done = spark.createDataFrame([("i1", "ingest", "completed", "p1"), ("i2", "ingest", "completed", "p1"), ("i3", "ingest", "failed", "p2")], "id string, type string, status string, paper_id string")
    assert [tuple(r) for r in dataflow.chained(done).collect()] == [("process-p1", "process", "queued", "p1")]


def test_community_rows_and_evidence_repair(spark):
    from loomfield.operators import graph

    nodes = spark.createDataFrame([(f"n{i}", f"name {i}") for i in range(6)], "id string, name string")
    labels = spark.createDataFrame([(f"n{i}", "x" if i < 4 else "y") for i in range(6)], "id string, label string")
    props = spark.createDataFrame([(f"p{i:02d}", f"text {i}", ["n0", "n1"]) for i in range(10)] + [("p99", "text", ["n5"])], "id string, text string, node_ids array<string>")
    got = graph.community_rows(nodes, labels, props).collect()
    assert [(r["label"], r["size"], r["title"], r["summary"], r["evidence"]) for r in got] == [("x", 4, "name 0, name 1, name 2", "Cluster of: name 0, name 1, name 2, name 3", [f"text {i}" for i in range(8)])]
    said = spark.createDataFrame([("q1", "p1", "nlp"), ("q2", "p1", None), ("q3", None, None)], "id string, paper_id string, domain string")
    papers = spark.createDataFrame([("p1", "nlp")], "id string, domain string")
    assert sorted(r["id"] for r in maintenance.repaired_evidence(said, papers).collect()) == ["q1", "q3"]


def test_events_are_published(spark, tmp_path):
    from loomfield.streaming import events

    spark.createDataFrame([(i,) for i in range(5)], "id int").coalesce(1).write.parquet(f"{tmp_path}/in.parquet")
    seen = []
    stream = spark.readStream.schema("id int").parquet(f"{tmp_path}/in.parquet")
    events.publish(stream, "bus", [lambda df, n: seen.extend(r["id"] for r in df.collect()), lambda df, n: seen.append(-1)])
    assert sorted(seen) == [-1, 0, 1, 2, 3, 4]


def test_small_pieces(spark):
    from loomfield.functions import text, vectors

    state = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(map(tuple, maintenance.insert_new(state, spark.createDataFrame([(1, "z"), (2, "b"), (2, "b")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "b")]
    chunks = spark.createDataFrame([("p", 0, "x"), ("p", 1, "y")], "paper_id string, chunk_index int, content_hash string")
    assert [r["chunk_index"] for r in dataflow.unfinished_chunks(chunks, chunks.withColumn("content_hash", F.lit("x"))).collect()] == [1]
    props = spark.createDataFrame([("P", ["a", "b"])], "paper_id string, node_ids array<string>")
    held = spark.createDataFrame([("P", "a", "mentions"), ("P", "b", "uses")], "source_id string, target_id string, type string")
    assert [tuple(r) for r in maintenance.missing_mentions(props, held).collect()] == [("P", "b")]
    grants = spark.createDataFrame([(["*"], ["read"]), (["nlp"], ["admin"]), ([], None), (None, ["write"])], "d array<string>, s array<string>")
    got = [tuple(r) for r in grants.select(domains.granted(F.col("d"), F.lit("nlp")), domains.granted(F.col("d"), F.lit("x")), domains.has_scope(F.col("s"), "write")).collect()]
    assert got == [(True, True, False), (True, False, True), (False, False, False), (False, False, True)]
    row = spark.range(1).select(text.truncate(F.lit("abcdef"), 4), text.truncate(F.lit("abcd"), 4), text.slugify(F.lit(" A b--C! ")), vectors.poincare_distance(F.array(F.lit(0.0)), F.array(F.lit(0.5)))).first()
    assert tuple(row)[:3] == ("abc…", "abcd", "a-b-c") and row[3] == pytest.approx(hyperbolic.distances(np.array([0.0]), np.array([0.5])))
    assert [r["id"] for r in browse.by_type_then_id(spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "x")], "id string, type string")).collect()] == ["a", "b", "a"]
    feed = spark.createDataFrame([("A", "Mip-Splatting", "uses")], "id string, name string, type string")
    assert browse.types(feed).first()["type"] == "uses" and browse.datasets(spark.createDataFrame([("e", "m", "d", "evaluates_on", 0.5)], "id string, source_id string, target_id string, type string, confidence double"), spark.createDataFrame([("m", "M", "method"), ("d", "D", "dataset")], "id string, name string, type string")).first()["dataset"] == "D"


def test_pdf_files(spark, tmp_path):
    import base64
    import zlib

    from loomfield.sources import pdf

    shown = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) w) Tj T* [(or) -20 (ld) -300 (again)] TJ 0 -14 Td <48692E> Tj ET"
    packed = zlib.compress(shown)
    stream = lambda head, body: b"1 0 obj\n<< " + head + b" /Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n"
    files = {
        "a.pdf": b"%PDF-1.4\n" + stream(b"/Filter /FlateDecode", packed) + stream(b"/Filter /DCTDecode", b"\xff\xd8(BT no) Tj"), "b.pdf": b"%PDF-1.4\n" + stream(b"", shown),
        "c.pdf": b"plain", "d.pdf": b"%PDF-1.4\n/Encrypt", "e.pdf": b"%PDF-1.4\n" + stream(b"/Filter /FlateDecode", b"broken"), "f.txt": b"%PDF-",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in pdf.read(spark, str(tmp_path)).collect()}
    words = ("Hello (PDF) w\norld again\nHi.", None)
    assert got == {"a.pdf": words, "b.pdf": words, "c.pdf": (None, "not a PDF"), "d.pdf": (None, "encrypted"), "e.pdf": (None, "no text")}
    assert pdf.text_of(files["b.pdf"], -1)[1] == "took too long"
    hexed, a85 = stream(b"/Filter /ASCIIHexDecode", shown.hex().encode() + b">"), stream(b"/Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(packed, adobe=True))
    assert [pdf.text_of(b"%PDF-1.4\n" + x)[1] for x in (hexed, a85)] == [None, None] and pdf.text_of(b"%PDF-1.4\n" + hexed)[0].split() == words[0].split()
    assert pdf.text_of(b"%PDF-1.4\n" + stream(b"", shown) + stream(b"/Filter /LZWDecode", b"x"))[1] == "streams not read: LZWDecode"
    bomb = stream(b"/Filter /FlateDecode", zlib.compress(bytes(pdf.MOST_BYTES + 1)))
    assert pdf.text_of(b"%PDF-1.4\n" + bomb)[1].startswith("a stream unpacks to more")


def test_co_mentioned_names_meet_as_names(spark):
    from loomfield.operators import audit

    words = ["red", "red ring", "our red ring", "ring", "Red", " red ", "blue", "", None, "a", "aa", "é", "éé", "red ring k1", "k1"]
    nodes = spark.createDataFrame([(f"n{i:02d}", w) for i, w in enumerate(words)], "id string, name string")
    held = [(f"s{s}", f"n{i:02d}") for s in range(5) for i in range(len(words)) if (i * 7 + s) % 3] + [("s0", "n01")]
    edges = spark.createDataFrame([(a, b, "mentions") for a, b in held] + [("s9", "n00", "uses"), ("s9", "n01", "uses")], "source_id string, target_id string, type string")
    low = {f"n{i:02d}": w.strip(" ").lower() for i, w in enumerate(words) if w}
    related = lambda x, y: low.get(x) and low.get(y) and (low[x].startswith(low[y]) or low[x].endswith(low[y]))
    want = {(a, b) for s, a in held for t, b in held if s == t and a < b and (related(a, b) or related(b, a))}
    assert {tuple(r) for r in audit.co_mentioned(nodes, edges, F.lit(True)).collect()} == want
    assert {tuple(r) for r in audit.co_mentioned(nodes, edges, F.col("id") == "n00").collect()} == {p for p in want if p[0] == "n00"}
    # spelt once for each name, however many sources mention it: nothing of the edges is needed
    names = spark.createDataFrame([("x", "red ring"), ("y", "red"), ("z", "blue"), ("u", "tin"), ("v", "tin")], "id string, name string")
    assert {tuple(r) for r in audit.name_cuts(names).collect()} == {("red ring", "red"), ("tin", "tin")}


def test_listing_findings_without_a_limit(spark):
    from loomfield.operators import audit

    found = spark.range(700).select(F.col("id").cast("string").alias("id"), F.lit("low").alias("confidence"), F.lit("d").alias("detector"))
    assert audit.listed(found).count() == 500 and audit.listed(found, None).count() == 700


def test_backfilled_links_meet_in_as_many_tasks_as_asked(spark):
    from loomfield.operators import maintenance

    edges = spark.createDataFrame([("e", "p1", "n1", "mentions", None, 1.0)], "id string, source_id string, target_id string, type string, domain string, confidence double")
    props = spark.createDataFrame([("1", "p1", "body", None, ["n1", "n2"]), ("1", "p1", "end", None, ["n2"])], "paper_id string, paper_node string, section string, domain string, node_ids array<string>")
    links, new = maintenance.backfilled(edges, props, 7)
    assert {(r["source_id"], r["target_id"]) for r in links.collect()} == {("p1", "n1"), ("p1", "n2")}
    assert [r["section"] for r in new.collect()] == ["body"]
    assert new._jdf.queryExecution().optimizedPlan().toString().count(", 7") == 2
