"""String expressions: names, sections, edge types, roles, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword ladders, first match wins, in the order listed.
EDGE_TYPES = [
    ("extends", "extend"),
    ("improves", "improv|outperform|better than"),
    ("introduces", "introduc|propos|present"),
    ("cites", "cite|referenc"),
    ("evaluates_on", "evaluat|benchmark|tested on|trained on"),
    ("compares_to", "compar"),
    ("authored_by", "author|written by"),
]
ROLES = [
    ("contributes", "introduc|propos|present|contribut"),
    ("builds_on", "extend|improv|build|fine_tune|based"),
    ("validated_on", "evaluat|achiev|measur|trained_on|tested"),
    ("compared_with", "outperform|compar|beat|versus"),
    ("uses", "use|comput|appl|requir"),
]
ROLE_ORDER = ["contributes", "builds_on", "uses", "validated_on", "compared_with", "covers"]
SECTIONS = [
    ("introduction", "introduction"),
    ("related_work", "related work|background|prior work"),
    ("methods", "method|approach|our model"),
    ("results", "experiment|evaluation|results"),
    ("conclusion", "conclusion|discussion|future work"),
    ("references", "reference|bibliography"),
]
# End of fixed values.


def ladder(value: Column, steps, otherwise: Column) -> Column:
    """The label of the first pattern found in ``value``."""
    first, *rest = steps
    start = F.when(value.rlike(first[1]), first[0])
    return reduce(lambda w, s: w.when(value.rlike(s[1]), s[0]), rest, start).otherwise(otherwise)


def normalise_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def entity_type(kind: Column) -> Column:
    """Trimmed, in lower case; references to papers are papers, nothing is a concept."""
    bare = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(bare == "paper_reference", "paper").when(bare == "", "concept").otherwise(bare)


def edge_type(predicate: Column) -> Column:
    """Identifiers stay as they are; prose takes the first matching keyword, else ``uses``."""
    bare = F.trim(F.coalesce(predicate, F.lit("")))
    return F.when(bare.rlike("^[a-z][a-z0-9_]*$"), bare).otherwise(ladder(F.lower(bare), EDGE_TYPES, F.lit("uses")))


def role(kind: Column, incoming: Column | None = None) -> Column:
    """Role of an edge seen from its source; from its target, contributes and builds_on change places."""
    out = F.when(kind == "mentions", "covers").otherwise(ladder(F.lower(kind), ROLES, F.lit("covers")))
    if incoming is None:
        return out
    swapped = F.when(out == "contributes", "builds_on").when(out == "builds_on", "contributes").otherwise(out)
    return F.when(incoming, swapped).otherwise(out)


def inverted(phrase: Column) -> Column:
    """A phrase seen from its other end, underscores as spaces: ``improves`` becomes ``improved by``, others gain ``by``."""
    spaced = F.lower(F.regexp_replace(F.coalesce(phrase, F.lit("")), "_", " "))
    return F.when(spaced.endswith("s"), F.regexp_replace(spaced, "e?s$", "ed by")).otherwise(F.concat(spaced, F.lit(" by")))


def section_of(text: Column, position: Column, total: Column) -> Column:
    """Section of a chunk by keywords in its first 500 characters, else by its place in the document."""
    head = F.lower(F.substring(text, 1, 500))
    place = position / total
    by_place = F.when(place < 0.2, "introduction").when(place < 0.6, "methods").when(place < 0.85, "results").otherwise("conclusion")
    return F.when(position == 0, "abstract").otherwise(ladder(head, SECTIONS, by_place))


def clean_text(text: Column) -> Column:
    """Line ends to LF, hyphenated breaks joined, blank lines and spaces collapsed, other than ASCII to spaces."""
    steps = [("\r\n?", "\n"), ("-\n", ""), ("[^\\x00-\\x7F]", " "), ("[ \t]+", " "), ("\n{3,}", "\n\n")]
    return F.btrim(reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text), F.lit(" \n\t"))


def arxiv_id(raw: Column) -> Column:
    """Bare identifier of the new or old style, a version allowed; null for anything else."""
    bare = F.regexp_replace(F.trim(raw), "(?i)^arxiv:", "")
    return F.when(bare.rlike("^([0-9]{4}\\.[0-9]{4,5}|[a-z-]+(\\.[A-Z]{2})?/[0-9]{7})(v[0-9]+)?$"), bare)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def content_hash(section: Column, body: Column) -> Column:
    return F.sha1(F.concat_ws("\u0000", F.coalesce(section, F.lit("")), F.coalesce(body, F.lit(""))).cast("binary"))


def fnv1a(text: Column, seed: int = 0x811C9DC5) -> Column:
    """32-bit FNV-1a over code points, as a long."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def json_repaired(text: Column) -> Column:
    """A JSON value out of a model's reply: fences and prose around it go, trailing commas go; null if it still does not parse."""
    inner = F.regexp_extract(F.regexp_replace(text, "```[a-z]*", ""), "(?s)([\\[{].*[\\]}])", 1)
    return F.try_parse_json(F.regexp_replace(inner, ",\\s*([\\]}])", "$1"))
