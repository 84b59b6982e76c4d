"""Graphs, knowledge hierarchies and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import STOP_WORDS
from tesserae.operators import graph, knowledge
from tesserae.operators.search import nearest_nodes
from tesserae.queries.common import EDGES, FACTS, Registry, r6
from tesserae.sources import tables as t
from tesserae.sources import text
from tesserae.sources.store import written

QUERIES = Registry()
add = QUERIES.add
NAMES = ["click", "purchase"]


@add("g01_connect", f"WITH {EDGES}, p AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'view') SELECT src, dst FROM edges UNION SELECT a, b FROM p UNION SELECT b, a FROM p")
def g01(spark, d):
    n = t.nodes(spark, d)
    e = t.edges(n)
    return graph.connect(e, e.where("type = 'view'").select(F.col("src").alias("a"), F.col("dst").alias("b")), n)


@add("g03_edges_of_type", f"WITH {EDGES} SELECT src, dst, strength FROM edges WHERE type = 'purchase'")
def g03(spark, d):
    return graph.of_type(t.edges(t.nodes(spark, d)), "purchase").select("src", "dst", "strength")


@add("g05_delete_cascade", f"WITH {EDGES}, x AS (SELECT node_id FROM nodes WHERE node_type = 'error') SELECT src, dst FROM edges WHERE src NOT IN (SELECT node_id FROM x) AND dst NOT IN (SELECT node_id FROM x)")
def g05(spark, d):
    n = t.nodes(spark, d)
    return graph.delete_nodes(n, t.edges(n), n.where("node_type = 'error'"))[1].select("src", "dst")


_STATE = ", ".join(f"last_value(CASE WHEN node_type = '{n}' THEN value END IGNORE NULLS) OVER w AS {n}" for n in NAMES)


@add(
    "g07_knowledge_traversal",
    f"""WITH {EDGES}, s AS (SELECT node_id, user_id, {_STATE} FROM nodes WINDOW w AS (PARTITION BY user_id ORDER BY t, node_id ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT node_id AS near_id, round(sqrt(greatest(0.0::DOUBLE, distance * distance + 0.25 - distance * cos(radians(angle - 90))) + (time - 360) * (time - 360)), 6) AS d FROM nodes ORDER BY d, node_id LIMIT 25),
    l AS (SELECT user_id, max_by(node_id, (t, node_id)) AS last_id FROM nodes GROUP BY 1)
    SELECT near_id, d, dst AS node_id, s.user_id, last_id, {', '.join(NAMES)} FROM q JOIN edges ON src = near_id JOIN s ON s.node_id = dst JOIN l ON l.user_id = s.user_id""",
)
def g07(spark, d):
    n = t.nodes(spark, d)
    at = (360.0, 0.5, 90.0)
    near = written(nearest_nodes(n, *at, k=25).select("node_id", "user_id", "d"), "near")
    # edges here join nodes of one user
    own = n.join(near.select("user_id").distinct(), "user_id", "left_semi")
    return graph.knowledge_traversal(n, t.edges(own), at, 25, NAMES, near)


@add("g08_listed_connections", f"WITH {EDGES} SELECT src, dst, round(b.time - a.time, 6) AS dt, round(sqrt(greatest(0.0::DOUBLE, a.distance * a.distance + b.distance * b.distance - 2.0 * a.distance * b.distance * cos(radians(a.angle - b.angle))) + (a.time - b.time) * (a.time - b.time)), 6) AS d FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst")
def g08(spark, d):
    n = t.nodes(spark, d)
    return graph.listed_connections(t.edges(n), n)


@add(
    "g09_traverse",
    f"""WITH RECURSIVE {EDGES}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (
    SELECT node_id AS start, node_id, 0 AS depth FROM nodes WHERE value < 1 UNION SELECT start, dst, depth + 1 FROM r JOIN both_ ON src = r.node_id WHERE depth < 2)
    SELECT start, node_id, min(depth) AS depth FROM r GROUP BY 1, 2""",
)
def g09(spark, d):
    n = t.nodes(spark, d)
    return graph.traverse(t.edges(n), n.where("distance < 0.01D"), 2)


@add("g12_contains", "SELECT 'domain:' || n_regionkey AS src, 'topic:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation UNION ALL SELECT 'topic:' || c_nationkey, 'fact:' || c_custkey, 'CONTAINS' FROM customer")
def g12(spark, d):
    return graph.contains_edges(t.topics(spark, d), t.facts(spark, d))


@add("g13_fact_network", "SELECT 'topic:' || c_nationkey AS src, 'fact:' || c_custkey AS dst, 'solid' AS style FROM customer UNION ALL SELECT 'fact:' || o_custkey, 'order:' || o_orderkey, 'dashed' FROM orders")
def g13(spark, d):
    c = graph.contains_edges(t.topics(spark, d), t.facts(spark, d)).where(F.col("src").startswith("topic:"))
    related = t.table(spark, d, "orders").select(F.concat(F.lit("fact:"), "o_custkey").alias("src"), F.concat(F.lit("order:"), "o_orderkey").alias("dst"))
    return graph.fact_network(c, related)


@add("g14_degrees", f"WITH {EDGES}, e AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) SELECT node_id, count(*) AS degree FROM e GROUP BY 1")
def g14(spark, d):
    return graph.degrees(t.edges(t.nodes(spark, d)))


@add(
    "g15_branch_candidates",
    """WITH n AS (SELECT c_custkey AS node_id, c_nationkey AS branch_id, (c_acctbal + 1000) / 11000 AS distance FROM customer),
    e AS (SELECT l_suppkey AS src, l_partkey % 1500 AS dst, l_discount * 10 AS strength FROM lineitem)
    SELECT a.node_id, a.branch_id, count(DISTINCT b.node_id) AS satellites FROM e JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst
    WHERE strength >= 0.5 AND a.distance > 0.2 AND a.branch_id = b.branch_id GROUP BY 1, 2 HAVING count(DISTINCT b.node_id) >= 5""",
)
def g15(spark, d):
    n = t.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("branch_id"), ((F.col("c_acctbal") + 1000) / 11000).alias("distance"))
    e = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1500).alias("dst"), (F.col("l_discount") * 10).alias("strength"))
    return graph.branch_candidates(n, e, 0.2)


@add("g16_related_filter", f"WITH {EDGES} SELECT node_id, node_type FROM nodes WHERE node_id IN (SELECT src FROM edges WHERE type = 'signup' UNION SELECT dst FROM edges WHERE type = 'signup')")
def g16(spark, d):
    n = t.nodes(spark, d)
    return graph.related_filter(n, t.edges(n), "signup").select("node_id", "node_type")


@add("j14_topics_by_domain", "SELECT r_regionkey AS domain_id, r_name AS domain, n_nationkey AS topic_id FROM region JOIN nation ON n_regionkey = r_regionkey")
def j14(spark, d):
    return knowledge.topics_by_domain(t.domains(spark, d), t.topics(spark, d)).select("domain_id", "domain", "topic_id")


@add("j15_facts_by_topic", f"WITH {FACTS} SELECT topic_id, fact_id, round(confidence, 6) AS confidence FROM facts JOIN nation ON n_nationkey = topic_id")
def j15(spark, d):
    return knowledge.facts_by_topic(t.topics(spark, d), t.facts(spark, d)).select("topic_id", "fact_id", r6("confidence").alias("confidence"))


@add("g10_related_facts", "SELECT DISTINCT * FROM (SELECT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT l_suppkey, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE src <> dst")
def g10(spark, d):
    pairs = t.table(spark, d, "orders").join(t.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"))
    return knowledge.related_facts(pairs)


@add("f49_search_messages", "SELECT conv_id, turn, role, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM conversations WHERE contains(lower(text), 'the ')")
def f49(spark, d):
    return knowledge.search_messages(t.messages(spark, d), "The ")


_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)
_KEYS = f"""m AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS text FROM conversations GROUP BY 1),
    w AS (SELECT conv_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM conversations),
    c AS (SELECT conv_id, term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY 1, 2),
    k AS (SELECT conv_id, term, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) <= 5)"""


def _keywords(spark, d):
    """Five terms a conversation, equals in order of the alphabet."""
    from pyspark.sql import Window

    from tesserae.operators.aggregates import term_counts

    c = term_counts(t.messages(spark, d), "conv_id", "text", 3, STOP_WORDS)
    return c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "term"))).where("r <= 5").select("conv_id", "term", "n")


@add("j12_related_conversations", f"WITH {_KEYS} SELECT a.conv_id, b.conv_id AS other, count(*) AS shared FROM k a JOIN k b ON a.term = b.term AND a.conv_id <> b.conv_id GROUP BY 1, 2")
def j12(spark, d):
    return knowledge.related_conversations(_keywords(spark, d))


@add("j13_by_keyword", f"WITH {_KEYS} SELECT DISTINCT conv_id FROM k WHERE term = 'les'")
def j13(spark, d):
    return knowledge.by_keyword(_keywords(spark, d), "les")


@add("a23_all_keywords", f"WITH {_KEYS} SELECT DISTINCT term FROM k ORDER BY term")
def a23(spark, d):
    return knowledge.all_keywords(_keywords(spark, d))


@add("h22_conversation_summary", "WITH m AS (SELECT conv_id, count(*) AS n_messages, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS said FROM conversations GROUP BY 1) SELECT conv_id, n_messages, CASE WHEN length(said) > 200 THEN substr(said, 1, 197) || '...' ELSE said END AS summary FROM m")
def h22(spark, d):
    return knowledge.summaries(t.messages(spark, d))


@add("sc18_paragraphs", r"WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n')) AS content FROM documents) SELECT doc_id, count(*) AS n FROM p WHERE trim(content) <> '' GROUP BY 1")
def sc18(spark, d):
    return text.paragraphs(t.table(spark, d, "documents"), "doc_id", blank="\n").groupBy("doc_id").agg(F.count("*").alias("n"))


_SPACE = r"[\t\n\x0B\f\r ]+"
_SENTENCES = f"WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_SPACE}', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS content, CAST(unnest(range(len(l))) AS INTEGER) AS sentence FROM p), s AS (SELECT doc_id, sentence, trim(content, ' ') AS content FROM e WHERE trim(content, ' ') <> '')"


@add("sc19_sentences", f"{_SENTENCES} SELECT doc_id, sentence, content FROM s")
def sc19(spark, d):
    return text.sentences(t.table(spark, d, "documents"), "doc_id")


@add("h28_themes", f"{_SENTENCES}, w AS (SELECT doc_id, sentence, regexp_split_to_array(trim(content, ' '), '{_SPACE}') AS w FROM s) SELECT doc_id, sentence, w[1] || ' ' || w[2] || ' ' || w[3] AS theme FROM w WHERE len(w) > 3")
def h28(spark, d):
    from tesserae.functions.scalars import theme

    return text.sentences(t.table(spark, d, "documents"), "doc_id").select("doc_id", "sentence", theme(F.col("content")).alias("theme")).where("theme is not null")


