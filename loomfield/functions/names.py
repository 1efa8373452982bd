"""Judging names: whether two may be merged, and whether one is a name at all."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without identity of their own, and the patterns of malformed names.
GENERIC = [
    "a", "an", "the", "of", "for", "and", "to", "in", "on", "with", "based",
    "system", "systems", "model", "models", "method", "methods", "methodology", "technique", "techniques",
    "approach", "approaches", "algorithm", "algorithms", "framework", "frameworks", "module", "modules",
    "layer", "layers", "mechanism", "mechanisms", "architecture", "architectures", "component", "components",
    "strategy", "strategies", "scheme", "schemes",
]
BY_NAME_ONLY = ["paper", "paper_reference"]
DETERMINERS = "(?i)^(our|the|a|an|this|these|their|its|such)\\s+"
FORMULA = "[=∑∈≈≤≥←→∇·×÷^]|\\b\\d+\\s*[+\\-*/]\\s*\\d+\\b"
CLAUSE = "(?i)\\b(we|which|that|when|where|whose|because|while|although|however|therefore|thus|hence)\\b"
CUT_SHORT = "(?i)\\b(of|in|on|to|for|with|and|or|the|a|an|at|by|from)$"
INFINITIVE = "(?i)\\bto\\s+\\w+$"
ARTICLE = "(?i)^(a|an|the)\\s+"
CITATION = "(?i)\\[\\d+\\]|\\bet\\s+al\\.?,?\\s*\\d{4}"
LONG, TOO_LONG = 45, 80
# End of fixed values.


def tokens(name: Column) -> Column:
    """Lower-case runs of letters and digits; a blank name has none."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _abbreviates(short: Column, long: Column) -> Column:
    """A name whose letters and digits are all initials of the other's words, or its first word and the initials of the rest."""
    letters = _letters(short)
    tail = F.slice(long, 2, F.greatest(F.size(long) - 1, F.lit(0)))
    led = F.concat(F.get(long, F.lit(0)), _initials(tail))
    return (F.length(letters) > 1) & (F.size(long) > 1) & ((letters == _initials(long)) | (letters == led))


def may_merge(a: Column, b: Column, kind: Column, other: Column | None = None) -> Column:
    """Whether two names, of the types ``kind`` and ``other`` (the same where left out), may denote one thing.

    Papers, on either side, and empty names never; the multisets of numbers must agree; equal token sets and initialisms
    may; otherwise every differing token must be generic. Symmetric in the two names; nulls are empty.
    """
    left, right = tokens(a), tokens(b)
    by_name = [F.lower(F.coalesce(k, F.lit(""))).isin(*BY_NAME_ONLY) for k in ((kind,) if other is None else (kind, other))]

    def numbers(words: Column) -> Column:
        return F.array_sort(F.filter(words, lambda w: w.rlike("^[0-9]+$")))

    same = F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))
    apart = F.concat(F.array_except(left, right), F.array_except(right, left))
    generic = F.forall(apart, lambda w: w.isin(*GENERIC))
    decided = (
        F.when((F.size(left) == 0) | (F.size(right) == 0), False)
        .when(reduce(or_, by_name), False)
        .when(numbers(left) != numbers(right), False)
        .when(same | _abbreviates(a, right) | _abbreviates(b, left), True)
        .otherwise(generic)
    )
    return F.coalesce(decided, F.lit(False))


def _letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^\\p{L}\\p{N}]+", "")


def merge_keys(name: Column, other_side: bool = False) -> Column:
    """Keys of a name; two names that ``may_merge`` share one of them, if one of the two gives those of the ``other_side``.

    Such names have the same words but for generic ones, or one's letters are the other's initials. Names without a word have no key.
    """
    words = tokens(name)
    tail = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    bare = F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*GENERIC))))
    letters, initials = F.array(_letters(name)), F.array(_initials(words), F.concat(F.get(words, F.lit(0)), _initials(tail)))
    short, long = (initials, letters) if other_side else (letters, initials)
    marked = lambda keys, mark: F.transform(keys, lambda k: F.concat(F.lit(mark), k))
    own = F.concat(F.array(F.concat(F.lit("words "), F.array_join(bare, " "))), marked(short, "short "), marked(long, "long "))
    return F.when(F.size(words) > 0, F.array_distinct(own)).otherwise(F.array().cast("array<string>"))


def _says(verdict: str, confidence: str, reason: str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def judge_name(name: Column) -> Column:
    """(verdict, confidence, reason) of a name, by the first rule that applies."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    long = F.length(bare) > LONG
    prose = [(CLAUSE, "clause"), (CUT_SHORT, "cut short"), (INFINITIVE, "cut at an infinitive"), (ARTICLE, "begins with an article")]
    found = F.when(bare == "", _says("drop", "high", "empty")).when(bare.rlike(FORMULA), _says("drop", "high", "formula"))
    for pattern, reason in prose:
        found = found.when(long & bare.rlike(pattern), _says("drop", "high", reason))
    found = found.when(bare.rlike(CITATION), _says("review", "medium", "citation")).when(F.length(bare) > TOO_LONG, _says("review", "low", "too long"))
    return found.otherwise(_says("keep", "high", "a name"))


def judge_connectivity(degree: Column) -> Column:
    return F.when(degree == 0, _says("review", "medium", "no edges")).otherwise(_says("keep", "high", "connected"))


def bare_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, DETERMINERS, ""))


def judge_pair(a: Column, b: Column, kind: Column, other: Column | None = None) -> Column:
    """(verdict, confidence, reason) for two co-mentioned names, both without their leading determiner: ``merge`` where they
    are equal or pass the guard, ``review`` where one begins with the other, else ``keep``."""
    x, y = bare_name(a), bare_name(b)
    low_x, low_y = F.lower(x), F.lower(y)
    return (
        F.when(low_x == low_y, _says("merge", "high", "equal but for a determiner"))
        .when(may_merge(x, y, kind, other), _says("merge", "medium", "generic words only"))
        .when(low_x.startswith(low_y) | low_y.startswith(low_x), _says("review", "low", "one extends the other"))
        .otherwise(_says("keep", "high", "distinct"))
    )


def survivor(a: Column, b: Column) -> Column:
    """The name to keep: well-formed before malformed, then without a determiner and shorter, then by order."""

    def rank(n: Column) -> Column:
        return F.struct((judge_name(n)["verdict"] != "keep").cast("int"), F.length(F.trim(n)), n.alias("name"))

    return F.least(rank(a), rank(b))["name"]
