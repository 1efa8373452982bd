"""A corpus whose answers are known by construction, the strategies that answer it, and their scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import evaluation, field, ingestion, retrieval
from loomfield.sources.tables import staged

# The invented words, the sentences and the sizes of the constructed corpus.
TAG, DOMAIN, TOPICS, CROWD, K = "EVALSET", "nlp", 20, 12, 10
WORDS = {
    "anchor": ["zeta", "corvid", "analysis"], "mid": ["quill", "lattice", "harmonic"], "target": ["morrow", "fenwick", "sable"],
    "decoy": ["thicket", "plume", "varnish"], "hub": ["vellum", "cistern"], "spoke": ["tallow", "ridgeway"],
}
TYPES = {"decoy": "concept", "hub": "concept"}
LINKS = [("anchor", "extends", "mid"), ("mid", "improves", "target"), ("anchor", "uses", "hub"), ("hub", "improves", "spoke")]
#: (kind, sentence, nodes it names)
SENTENCES = [
    ("single", "{tag} {anchor} is evaluated directly and reports strong results.", ["anchor"]),
    ("multi", "{tag} {target} supersedes {mid} under every configuration tested.", ["target", "mid"]),
    ("decoy0", "{tag} {anchor} is mentioned in passing by an unrelated {decoy} survey.", ["decoy"]),
    ("decoy1", "{tag} {anchor} appears in a {decoy} table of contents.", ["decoy"]),
    ("decoy2", "{tag} {decoy} discusses {anchor} without evaluating it.", ["decoy"]),
    ("hub", "{tag} {spoke} is the component that {hub} depends on for correctness.", ["spoke"]),
]
CROWD_SENTENCE = "{tag} {hub} is also referenced by unrelated component {n}."
#: (family, question, kind of the sentence that answers it)
QUESTIONS = [("single-hop", "{anchor}", "single"), ("multi-hop", "what supersedes what {anchor} extends", "multi"), ("hub", "what does {hub} depend on", "hub")]
SWEEPS = {"restart": [0.15, 0.3, 0.5, 0.7, 0.85], "weights": [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (3, 1, 2), (2, 1, 2)]}
# End of fixed values.


def _said(sentence: str) -> Column:
    """The sentence with each topic's own words: ``{anchor}`` becomes ``zeta7 corvid7 analysis7``."""
    parts = {k: F.concat_ws(" ", *[F.concat(F.lit(w), F.col("topic").cast("string")) for w in ws]) for k, ws in WORDS.items()} | {"tag": F.lit(TAG), "n": F.col("n").cast("string")}
    pieces, rest = [], sentence
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(text), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def _id(kind: str) -> Column:
    return F.format_string(f"%05d-{kind}", F.col("topic"))


def vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vector): the hashed embedding of each text as a whole array."""
    cells = ingestion.hashed_embedding(df, key, text)
    held = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("cells"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(ingestion.WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0))).alias("vector"))


def corpus(spark: SparkSession, topics: int = TOPICS) -> tuple[field.Store, DataFrame, DataFrame]:
    """(store, questions(query_id, family, text, vector), gold(query_id, id)): for every topic a chain of three, a decoy with
    three sentences, and a hub between the answer and a crowd."""
    topic = spark.range(topics).select(F.col("id").cast("int").alias("topic"), F.lit(0).alias("n"))
    crowd = topic.drop("n").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(CROWD - 1))))
    crowd_id = F.format_string("%05d-crowd%02d", "topic", "n")
    node = lambda id_, kind, said: [id_.alias("id"), F.lit(kind).alias("type"), F.concat(F.lit(f"{TAG} "), said).alias("name"), said.alias("text"), F.lit(DOMAIN).alias("domain")]
    nodes = topic.select(F.inline(F.array(*[F.struct(*node(_id(k), TYPES.get(k, "method"), _said(f"{{{k}}}"))) for k in WORDS])))
    nodes = staged(nodes.unionByName(crowd.select(*node(crowd_id, "concept", _said("{hub} neighbour {n}")))), "evalset-nodes")
    edge = lambda a, kind, b: [F.concat_ws("|", a, F.lit(kind), b).alias("id"), a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type"), F.lit(0.9).alias("confidence"), F.lit(DOMAIN).alias("domain")]
    edges = topic.select(F.inline(F.array(*[F.struct(*edge(_id(a), kind, _id(b))) for a, kind, b in LINKS])))
    edges = edges.unionByName(crowd.select(*edge(_id("hub"), "uses", crowd_id)))
    prop = lambda id_, said, ids: [id_.alias("id"), said.alias("text"), F.array(*ids).alias("node_ids"), F.lit(DOMAIN).alias("domain")]
    props = topic.select(F.inline(F.array(*[F.struct(*prop(F.concat(F.lit("p-"), _id(k)), _said(s), [_id(x) for x in named])) for k, s, named in SENTENCES])))
    props = staged(props.unionByName(crowd.select(*prop(F.concat(F.lit("p-"), crowd_id), _said(CROWD_SENTENCE), [crowd_id]))), "evalset-propositions")
    ask = [F.struct(F.concat(F.lit(f"{f}-"), F.col("topic").cast("string")).alias("query_id"), F.lit(f).alias("family"), _said(q).alias("text"), F.concat(F.lit("p-"), _id(k)).alias("gold")) for f, q, k in QUESTIONS]
    asked = staged(topic.select(F.inline(F.array(*ask))), "evalset-questions")
    store = field.Store(
        nodes.drop("text"), edges, staged(vectors(nodes, "id", "text"), "evalset-node-vectors"),
        props.join(staged(vectors(props, "id", "text"), "evalset-vectors"), "id"),
    )
    questions = asked.drop("gold").join(vectors(asked, "query_id", "text"), "query_id")
    return store, staged(questions, "evalset-asked"), asked.select("query_id", F.col("gold").alias("id"))


def by_vector(store: field.Store, questions: DataFrame, domain: str, k: int) -> DataFrame:
    """(query_id, id, rank, chars): the nearest evidence."""
    props = store.scoped(domain).propositions
    return _with_chars(retrieval.nearest(questions, props.select("id", "vector"), k), props)


def by_keyword(store: field.Store, questions: DataFrame, domain: str, k: int) -> DataFrame:
    """(query_id, id, rank, chars): the evidence with all words of the question."""
    props = store.scoped(domain).propositions
    found = retrieval.lexical(props, "id", "text", {r["query_id"]: r["text"] for r in questions.select("query_id", "text").toLocalIterator()})
    return _with_chars(retrieval.ranked(found.withColumn("score", F.round("score", 12)), "lexical", 1.0).where(F.col("rank") <= k), props)


def by_field(**changes):
    """A strategy: the whole retrieval with some options changed, judged by its ranking and not by its budget."""

    def run(store: field.Store, questions: DataFrame, domain: str, k: int) -> DataFrame:
        options = field.Options(evidence=k, chars=float("inf"), **changes)
        found = field.retrieve(store, questions, domain, options).evidence
        return found.select("query_id", "id", F.col("place").alias("rank"), F.length("text").alias("chars"))

    return run


def _with_chars(found: DataFrame, props: DataFrame) -> DataFrame:
    return found.join(props.select("id", F.length("text").alias("chars")), "id").select("query_id", "id", "rank", "chars")


STRATEGIES = {"vector": by_vector, "keyword": by_keyword, "graph only": by_field(weights={"graph": 1.0, "vector": 1.0}), "hybrid": by_field()}


def run(spark: SparkSession, strategies: dict | None = None, topics: int = TOPICS, k: int = K) -> DataFrame:
    """(strategy, family, questions, recall, ndcg, mrr, chars, found) of every strategy over all questions; family ``all`` too."""
    store, questions, gold = corpus(spark, topics)
    families = questions.select("query_id", "family")
    scored = None
    for name, strategy in (STRATEGIES if strategies is None else strategies).items():
        found = staged(strategy(store, questions, DOMAIN, k), "evalset-found")
        sums = found.groupBy("query_id").agg(F.sum("chars").alias("chars"))
        scores = evaluation.ranking_metrics(found, gold, k).join(sums, "query_id", "left").fillna(0, ["chars"]).join(families, "query_id").withColumn("strategy", F.lit(name))
        scored = scores if scored is None else scored.unionByName(scores)
    scored = staged(scored, "evalset-scores")
    whole = evaluation.scorecard(scored.withColumn("family", F.lit("all")), "strategy", "family")
    return evaluation.scorecard(scored, "strategy", "family").unionByName(whole)


def sweep(spark: SparkSession, over: str, topics: int = TOPICS, k: int = K) -> DataFrame:
    """The scorecard of the whole retrieval over a grid: ``restart`` or ``weights``."""
    grid = {f"restart={x}": by_field(restart=x) for x in SWEEPS["restart"]} if over == "restart" else {
        f"g{g}/v{v}/l{w}": by_field(weights={"graph": float(g), "vector": float(v), "lexical": float(w)}) for g, v, w in SWEEPS["weights"]
    }
    return run(spark, grid, topics, k)
