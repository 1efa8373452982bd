"""Domains: isolated namespaces of one graph. Rows without a domain belong to ``default`` and to no other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "default"
# The papers that a new store of a domain starts with.
SPLATTING = (
    "2308.04079", "2308.14737", "2309.16585", "2310.08528", "2311.12775", "2311.16099", "2311.17977", "2312.00109", "2312.02126", "2312.03203",
    "2312.07504", "2312.13772", "2401.01339", "2401.02436", "2402.00752", "2402.03715", "2402.10259", "2403.02176", "2403.11625", "2403.17888",
    "2404.00109", "2404.01133", "2404.07613", "2405.00121", "2405.12872",
)
LANGUAGE = ("1706.03762", "1810.04805", "2005.14165")
# End of fixed values.


class UnknownDomainError(ValueError):
    """A domain id that no registry entry has; never answered with a fallback."""


@dataclass(frozen=True)
class Domain:
    id: str
    hierarchical: tuple[str, ...] = ("extends", "improves", "cites")
    name: str = ""
    seeds: tuple[str, ...] = ()


class Registry:
    """Known domains. Ids are trimmed and lower-cased; empty and null name the default one."""

    def __init__(self, *domains: Domain):
        self.domains = {d.id: d for d in (Domain(DEFAULT, name="research papers"), *domains)}

    @classmethod
    def standard(cls) -> Registry:
        return cls(
            Domain("gaussian-splatting", name="3D Gaussian Splatting", seeds=SPLATTING),
            Domain("nlp", name="Natural Language Processing", seeds=LANGUAGE),
            Domain("api-surface", ("belongs_to", "exposes"), "API Surface"),
        )

    def resolve(self, domain: str | None) -> str:
        found = (domain or "").strip().lower() or DEFAULT
        if found not in self.domains:
            raise UnknownDomainError(f"unknown domain {domain!r}; known: {', '.join(sorted(self.domains))}")
        return found

    def listing(self, spark: SparkSession) -> DataFrame:
        """(id, name, hierarchical, seeds) of every domain, seeds in their order."""
        rows = [(d.id, d.name, list(d.hierarchical), list(d.seeds)) for _, d in sorted(self.domains.items())]
        return spark.createDataFrame(rows, "id string, name string, hierarchical array<string>, seeds array<string>")

    def scope(self, df: DataFrame, domain: str | None, column: str = "domain") -> DataFrame:
        """Rows of one domain; ``None`` keeps all rows, unknown ids raise."""
        return df if domain is None else df.where(domain_is(F.col(column), self.resolve(domain)))


def domain_is(column: Column, domain: str) -> Column:
    return (column == domain) | column.isNull() if domain == DEFAULT else column == domain


def granted(domains: Column, domain: Column) -> Column:
    """Default deny: a grant names the domain or is an explicit ``*``; null grants allow nothing."""
    return F.coalesce(F.array_contains(domains, "*") | F.array_contains(domains, domain), F.lit(False))


def has_scope(scopes: Column, scope: str) -> Column:
    """Whether the scope is granted; ``admin`` implies every other."""
    return F.coalesce(F.array_contains(scopes, scope) | F.array_contains(scopes, "admin"), F.lit(False))
