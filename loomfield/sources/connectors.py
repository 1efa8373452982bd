"""Connectors: outside descriptions, already fetched as text, to documents and typed graph units."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import arxiv_id, normalise_name

# The operations of an API description, the form of a reference to a schema, and the sentences of evidence.
METHODS = ["get", "put", "post", "delete", "patch", "options", "head", "trace"]
SCHEMA_REF = re.compile(r"#/components/schemas/([A-Za-z0-9_.-]+)$")
UNTITLED = "Untitled API"
SUPPORTS = '{api} supports the {kind} authentication scheme "{name}".'
EXPOSES = "{label} ({place}) in {api}"
DEPRECATED = " This operation is deprecated."
PART_OF = '{label} is part of the "{name}" capability of {api}.'
REQUIRES = '{label} requires the "{name}" authentication scheme.'
ACCEPTS = "{label} accepts a {name} request body."
RETURNS = "{label} returns a {name} in its response."
# End of fixed values.


class UnknownConnectorError(ValueError):
    """A connector id that the registry lacks."""


@dataclass(frozen=True)
class Connector:
    """``collect`` takes (source_id, body) and gives a row for each source, with its ``error`` where it cannot be read.

    A structured connector brings its own units and needs no extraction.
    """

    id: str
    name: str
    structured: bool
    collect: Callable[[DataFrame], DataFrame]


# -- descriptions of APIs ---------------------------------------------------------------------------------------------


def schema_refs(node) -> list[str]:
    """Names of the schemas that a sub-tree of JSON refers to, each once, in the order met."""
    found: dict[str, None] = {}
    open_ = [node]
    while open_:
        at = open_.pop()
        if isinstance(at, list):
            open_ += reversed(at)
        elif isinstance(at, dict):
            ref = at.get("$ref")
            hit = SCHEMA_REF.search(ref) if isinstance(ref, str) else None
            if hit:
                found[hit[1]] = None
            open_ += reversed([v for k, v in at.items() if k != "$ref"])
    return list(found)


def _first(rows: list[tuple], key: Callable) -> list[tuple]:
    held: dict = {}
    for r in rows:
        held.setdefault(key(r), r)
    return list(held.values())


def _text(value) -> str:
    return value.strip() if isinstance(value, str) else ""


def _mapping(value) -> dict:
    return value if isinstance(value, dict) else {}


def _operation(api: str, path: str, method: str, op: dict) -> tuple[str, list, list]:
    """One operation as a unit: section, entities (mention, type), relations (subject, predicate, object, evidence)."""
    place = f"{method.upper()} {path}"
    label = _text(op.get("operationId")) or place
    said = ". ".join(x for x in (_text(op.get("summary")), _text(op.get("description"))) if x)
    evidence = EXPOSES.format(label=label, place=place, api=api) + (f": {said}" if said else ".") + (DEPRECATED if op.get("deprecated") else "")
    entities, relations = [(api, "api"), (label, "endpoint")], [(api, "exposes", label, evidence)]

    def add(name: str, kind: str, predicate: str, sentence: str) -> None:
        entities.append((name, kind))
        relations.append((label, predicate, name, sentence.format(label=label, name=name, api=api)))

    for tag in op.get("tags") or []:
        if _text(tag):
            add(tag, "capability", "belongs_to", PART_OF)
    for need in op.get("security") or []:
        for scheme in _mapping(need):
            add(scheme, "auth", "requires", REQUIRES)
    for name in schema_refs(op.get("requestBody")):
        add(name, "schema", "accepts", ACCEPTS)
    for name in schema_refs(op.get("responses")):
        add(name, "schema", "returns", RETURNS)
    return place, _first(entities, lambda e: (e[1], e[0].lower())), _first(relations, lambda r: (r[0].lower(), r[1], r[2].lower()))


def openapi_document(body: str | None) -> dict:
    """title, summary, units and error of one description in JSON."""
    try:
        spec = json.loads(body or "")
    except ValueError:
        yaml = re.search(r"(?m)^\s*(openapi|swagger)\s*:", body or "")
        return {"error": "YAML, not JSON" if yaml else "not valid JSON"}
    spec = _mapping(spec)
    if not (spec.get("openapi") or spec.get("swagger")):
        return {"error": "no version field"}
    if not isinstance(spec.get("paths"), (dict, list)):
        return {"error": "no paths"}
    info = _mapping(spec.get("info"))
    api = (_text(info.get("title")) or UNTITLED) + (f" v{info['version']}" if info.get("version") else "")
    schemes = _mapping(_mapping(spec.get("components")).get("securitySchemes"))
    own = [(api, "api")] + [(s, "auth") for s in schemes]
    needs = [
        (api, "requires", s, SUPPORTS.format(api=api, kind=_mapping(d).get("type") or "unspecified", name=s) + (f" {_mapping(d)['description']}" if _mapping(d).get("description") else ""))
        for s, d in schemes.items()
    ]
    operations = [
        _operation(api, path, method, item[method])
        for path, item in _mapping(spec["paths"]).items() if isinstance(item, dict) for method in METHODS if isinstance(item.get(method), dict)
    ]
    if not operations:
        return {"error": "no operations"}
    return {"title": api, "summary": _text(info.get("description")) or None, "units": [("api", own, needs), *operations], "error": None}


ENTITY = pa.struct([("mention", pa.string()), ("type", pa.string())])
RELATION = pa.struct([("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("evidence", pa.string()), ("confidence", pa.float64())])
UNIT = pa.struct([("section", pa.string()), ("entities", pa.list_(ENTITY)), ("relations", pa.list_(RELATION))])
UNITS = "array<struct<section:string,entities:array<struct<mention:string,type:string>>,relations:array<struct<subject:string,predicate:string,object:string,evidence:string,confidence:double>>>>"


def openapi(sources: DataFrame) -> DataFrame:
    """(source_id, title, external_id, summary, units, error) of API descriptions in JSON (source_id, body).

    The structure is stated by the description, so nothing is inferred. A description is walked whole in Python: its
    references may stand at any depth.
    """
    kind = sources.schema["source_id"].dataType.simpleString()

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):  # one description at a time
                d = openapi_document(b.column(1)[i].as_py())
                units = [{"section": s, "entities": [dict(zip(("mention", "type"), e)) for e in es], "relations": [dict(zip(("subject", "predicate", "object", "evidence"), r)) | {"confidence": 1.0} for r in rs]} for s, es, rs in d.get("units", [])]
                title = d.get("title")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([title], pa.string()), pa.array([title and f"openapi:{title}"], pa.string()), pa.array([d.get("summary")], pa.string()), pa.array([units], pa.list_(UNIT)), pa.array([d.get("error")], pa.string())],
                    names=["source_id", "title", "external_id", "summary", "units", "error"],
                )

    return sources.select("source_id", "body").mapInArrow(read, f"source_id {kind}, title string, external_id string, summary string, units {UNITS}, error string")


def unit_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (source_id, unit, place, section, mention, type) and relations (source_id, unit, place, section, subject, predicate,
    object, evidence, confidence) of structured documents; the unit is the chunk of what follows."""
    unit = documents.where("error is null").select("source_id", F.posexplode("units").alias("unit", "u"))
    entities = unit.select("source_id", "unit", "u.section", F.posexplode("u.entities").alias("place", "e")).select("source_id", "unit", "place", "section", "e.*")
    return entities, unit.select("source_id", "unit", "u.section", F.posexplode("u.relations").alias("place", "r")).select("source_id", "unit", "place", "section", "r.*")


# -- metadata of papers -----------------------------------------------------------------------------------------------


def arxiv(sources: DataFrame) -> DataFrame:
    """(source_id, title, abstract, authors, published, error) of Atom metadata (source_id, body), inside Catalyst.

    The second title is the paper's (the first is the feed's); a paper titled "Error" is a permanent error.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    titles = F.regexp_extract_all(body, F.lit("<title>([^<]+)</title>"), F.lit(1))
    title = F.coalesce(flat(F.get(titles, F.lit(1))), F.concat(F.lit("Paper "), F.col("source_id").cast("string")))
    abstract = flat(F.regexp_extract(body, r"(?s)<summary>(.*?)</summary>", 1))
    authors = F.transform(F.regexp_extract_all(body, F.lit(r"<author>\s*<name>([^<]+)</name>"), F.lit(1)), lambda a: F.trim(a))
    published = F.split(F.regexp_extract(body, "<published>([^<]+)</published>", 1), "T")[0]
    missing = F.lower(title) == "error"
    error = F.when(missing, F.concat(F.lit("no such paper"), F.when(abstract != "", F.concat(F.lit(": "), F.left(abstract, F.lit(200)))).otherwise("")))
    return sources.select("source_id", title.alias("title"), abstract.alias("abstract"), authors.alias("authors"), published.alias("published"), error.alias("error"))


def author_links(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors (author_id, name), one for each name in lower case, and links (paper_id, author_id, position, corresponding).

    ``papers``: (paper_id, authors). Positions count from 1, the first author corresponds; an author named twice in one
    paper keeps the first place; the display name is that of the smallest paper and place.
    """
    each = papers.select("paper_id", F.posexplode("authors").alias("at", "name")).select("paper_id", (F.col("at") + 1).alias("position"), F.trim("name").alias("name"), normalise_name(F.col("name")).alias("author_id")).where("author_id <> ''")
    authors = each.groupBy("author_id").agg(F.min_by("name", F.struct("paper_id", "position")).alias("name"))
    links = each.groupBy("paper_id", "author_id").agg(F.min("position").alias("position")).withColumn("corresponding", F.col("position") == 1)
    return authors, links


def coauthors(links: DataFrame) -> DataFrame:
    """(author_id, papers, led): papers of each author, through the links."""
    return links.groupBy("author_id").agg(F.count("*").alias("papers"), F.count_if("corresponding").alias("led"))


def arxiv_batch(requested: DataFrame, known: DataFrame, most: int = 500) -> DataFrame:
    """(place, paper, status) of a requested batch (place, raw): invalid, repeated, known, rejected or accepted.

    Each identifier counts at its first place; one that ``known`` (paper) has is not fetched again; a batch of more than
    ``most`` new papers is rejected whole. A window over the papers of one batch, which the request bounds.
    """
    named = requested.select("place", arxiv_id(F.col("raw")).alias("paper"))
    first = named.withColumn("again", F.row_number().over(Window.partitionBy("paper").orderBy("place")) > 1)
    held = first.join(known.select("paper").distinct().withColumn("held", F.lit(True)), "paper", "left")
    status = F.when(F.col("paper").isNull(), "invalid").when(F.col("again"), "repeated").when(F.col("held"), "known").otherwise("accepted")
    judged = held.select("place", "paper", status.alias("status"))
    new = judged.agg(F.count_if(F.col("status") == "accepted").alias("new"))  # one row
    over = (F.col("status") == "accepted") & (F.col("new") > most)
    return judged.join(F.broadcast(new)).select("place", "paper", F.when(over, "rejected").otherwise(F.col("status")).alias("status"))


REGISTRY = {c.id: c for c in (Connector("openapi", "OpenAPI", True, openapi), Connector("arxiv", "arXiv metadata", False, arxiv))}


def connector(name: str) -> Connector:
    """The connector of an id, blanks and case aside; an unknown one raises."""
    found = REGISTRY.get((name or "").strip().lower())
    if found is None:
        raise UnknownConnectorError(f"unknown connector {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return found
