import hashlib
import re

import pytest

from loomfield.operators import ingestion
from loomfield.operators.ingestion import chunks, hashed_embedding, split_text


def test_paragraphs_are_packed_and_overlap():
    assert split_text(None) == split_text("") == []
    assert split_text("aa\n\nbb\n\n\ncc", 6, 0) == ["aa\n\nbb", "cc"]
    assert split_text("aa\n\nbb\n\ncc", 6, 1) == ["aa\n\nbb", "b\n\ncc"]
    assert split_text("aaaaaa", 6, 0) == ["aaaaaa"]


def test_long_paragraphs_split_at_spaces_and_their_tail_stays_open():
    assert split_text("aaa bbb ccc d\n\ne", 8, 0) == ["aaa bbb", "ccc d\n\ne"]
    assert split_text("x\n\n" + "y" * 12, 8, 0) == ["x", "y" * 12]
    assert "".join(split_text("word " * 5000, 2000, 0)).replace(" ", "") == "word" * 5000


def test_chunks_number_every_text(spark):
    docs = spark.createDataFrame([(1, "aa\n\nbb\n\ncc"), (2, None), (3, "")], "id long, text string")
    got = [(r["id"], r["chunk_index"], r["chunk"], r["section"]) for r in chunks(docs, "id", "text", 6, 0).orderBy("chunk_index").collect()]
    assert got == [(1, 0, "aa\n\nbb", "abstract"), (1, 1, "cc", "methods")]


def test_embedding_is_a_unit_vector(spark):
    docs = spark.createDataFrame([(1, "Graph splatting graph"), (2, None), (3, "?!"), (4, "ab")], "id long, text string")
    rows = hashed_embedding(docs, "id", "text").collect()
    for i in (1, 2, 3, 4):
        assert sum(r["value"] ** 2 for r in rows if r["id"] == i) == pytest.approx(1)
    assert [(r["place"], r["value"]) for r in rows if r["id"] in (2, 3)] == [(0, 1.0)] * 2


def test_sessions_end_after_a_gap(spark):
    from loomfield.streaming.events import session_counts

    log = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:20:00'), ('a', timestamp'2024-01-01 02:00:00') AS t(k, at)")
    assert sorted(r["n"] for r in session_counts(log, "at", "k", "30 minutes").collect()) == [1, 2]


def chunked(text, size, overlap):
    """Chunks by a state of one open string, paragraph by paragraph."""
    raw, cur = [], ""
    strip = lambda t: t.strip(ingestion.BLANK)

    def close():
        nonlocal cur
        if cur:
            raw.append(strip(cur))
        cur = ""

    for paragraph in re.split("\n\n+", text or ""):
        if len(paragraph) > size:
            close()
            for word in paragraph.split(" "):
                if len(cur) + len(word) + 1 > size:
                    close()
                cur = f"{cur} {word}" if cur else word
        elif len(cur) + len(paragraph) + 2 <= size:
            cur = f"{cur}\n\n{paragraph}" if cur else paragraph
        else:
            close()
            cur = paragraph
    close()
    return [c if i == 0 else raw[i - 1][-overlap:] + "\n\n" + c for i, c in enumerate(raw)]


def test_chunks_of_all_documents_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in ingestion.chunks(docs, "doc_id", "text").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["section"], r["content_hash"]))
    for r in docs.collect():
        want = chunked(r["text"], ingestion.SIZE, ingestion.OVERLAP)
        found = got.get(r["doc_id"], [])
        assert [c for c, _, _ in found] == want
        assert [h for _, _, h in found] == [hashlib.sha1(f"{s}\0{c}".encode()).hexdigest() for c, s, _ in found]


def test_embedding_needs_no_shuffle(spark):
    """the sums of a text need its own row only."""
    docs = spark.createDataFrame([(1, "one two one"), (2, None), (3, "")], "id bigint, text string").repartition(1)
    assert hashed_embedding(docs, "id", "text")._jdf.queryExecution().executedPlan().toString().count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_descriptions_of_a_brand_are_bounded(spark, monkeypatch):
    """no description grows with the table."""
    from dataclasses import replace

    from loomfield.plans import paper_queries
    from loomfield.sources import connectors

    read, own = [], connectors.REGISTRY["openapi"]
    monkeypatch.setitem(connectors.REGISTRY, "openapi", replace(own, collect=lambda sources: read.append(sources) or own.collect(sources)))
    whole = sorted(map(tuple, paper_queries.api_units(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(paper_queries, "API_PARTS", 20, raising=False)
    assert sorted(map(tuple, paper_queries.api_units(spark, "/root/testdata/sf0.001").collect())) == whole
    assert max(r["body"].count('"get"') for r in read[-1].collect()) <= 20


def test_an_index_holds_few_texts_at_once(spark):
    """what a task holds does not depend on the texts of an Arrow batch."""
    import pyarrow as pa

    from loomfield.operators import retrieval

    class Docs:
        schema = spark.range(1).selectExpr("id", "'' as text").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run

    docs = Docs()
    retrieval.lexical_index(docs, "id", "text")
    out = list(docs.run([pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["a b a"] * 1000})]))
    assert sum(b.num_rows for b in out) == 2000 and max(b.num_rows for b in out) <= 512
