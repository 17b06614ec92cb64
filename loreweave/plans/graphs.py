"""Graph queries over the graph of the documents' keywords."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import graph as G
from loreweave.sources.checkpoints import shared_folder, written_once
from loreweave.sources.tables import documents

from .registry import query

_STOPS = ", ".join(f"'{w}'" for w in G.STOP_WORDS)
GRAPH_SQL = rf"""
toks AS (SELECT doc_id, unnest(f) AS t, unnest(range(len(f))) AS i FROM (SELECT doc_id, regexp_extract_all('doc_' || doc_id || ' ' || substr(text, 1, 800), '[一-鿿]{{2,}}|[A-Za-z][A-Za-z0-9]{{2,}}') AS f FROM documents)),
firsts AS (SELECT doc_id, t, i FROM toks WHERE lower(t) NOT IN ({_STOPS}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY i) = 1),
words AS (SELECT doc_id, t FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 8),
nodes AS (
    SELECT lang AS kb_id, 'doc_' || doc_id AS id, 'doc_' || doc_id AS name, '文档' AS type, '文档: doc_' || doc_id AS description, 'document' AS category, doc_id FROM documents
    UNION ALL SELECT NULL, 'ent_' || substr(md5(t), 1, 8), t, '概念', d, 'entity', NULL FROM (SELECT t, '{G.EXTRACTED}' || t AS d FROM words UNION SELECT '{G.ROOT}', '')
),
edges AS (SELECT DISTINCT 'doc_' || doc_id AS source, 'ent_' || substr(md5(t), 1, 8) AS target, '提及' AS type FROM words UNION ALL SELECT 'doc_' || doc_id, 'ent_' || substr(md5('{G.ROOT}'), 1, 8), '属于' FROM documents)"""
_BASE = GRAPH_SQL


def KHOP_SQL(words: list[str]) -> str:
    """The CTE khop (id, distance): two steps from the nodes whose name or description holds a word."""
    seeds = " OR ".join(f"contains(lower(name || ' ' || description), '{w.lower()}')" for w in words)
    return f"""
both_ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
k0 AS (SELECT id FROM nodes WHERE {seeds}),
k1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM k0) AND b NOT IN (SELECT id FROM k0)),
k2 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM k1) AND b NOT IN (SELECT id FROM k0 UNION SELECT id FROM k1)),
khop AS (SELECT id, 0 AS distance FROM k0 UNION ALL SELECT id, 1 FROM k1 UNION ALL SELECT id, 2 FROM k2)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(G.extracted(documents(spark, sf_dir)))


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words are extracted once; the queries read nodes and edges several times."""
    nodes, edges = G.build(_words(spark, sf_dir))
    return written_once(nodes), written_once(edges)


_graph = graph_of


def provenance_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and doc_id of the entities that documents mention."""
    return G.extracted(documents(spark, sf_dir)).select(F.explode("names").alias("_n"), "doc_id").select(G.entity_id(F.col("_n")).alias("id"), "doc_id")


@query(f"WITH {_BASE} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build(G.extracted(documents(spark, sf_dir)))[0]


@query(f"WITH {_BASE} SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build(_words(spark, sf_dir))[1]


@query(f"WITH {_BASE} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"))))


@query(f"""
WITH {_BASE}, live AS (SELECT * FROM edges WHERE type = '提及'),
b AS (SELECT source AS a, target AS b FROM live UNION ALL SELECT target, source FROM live),
d0 AS (SELECT id FROM nodes WHERE contains(lower(name || ' ' || description), 'worth')),
d1 AS (SELECT DISTINCT b AS id FROM b WHERE a IN (SELECT id FROM d0) AND b NOT IN (SELECT id FROM d0)),
d2 AS (SELECT DISTINCT b AS id FROM b WHERE a IN (SELECT id FROM d1) AND b NOT IN (SELECT id FROM d0 UNION SELECT id FROM d1))
SELECT id, 0 AS distance FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2""")
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return G.expand(nodes, edges.filter(F.col("type") == G.RELATIONS["mentions"]), G.seeds_for(nodes, ["worth"]), 2)[0]


@query(f"WITH {_BASE} SELECT 'out' AS direction, e.type, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'doc_7' UNION ALL SELECT 'in', e.type, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'doc_7'")
def graph_node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(*_graph(spark, sf_dir), "doc_7")


_LIVE = "SELECT doc_id FROM labels WHERE toxic = 0"


@query(f"WITH {_BASE}, gone AS (SELECT id FROM nodes WHERE category = 'document' AND doc_id NOT IN ({_LIVE})) SELECT source, target, type FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)")
def graph_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    live = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").select("doc_id")
    return G.without(nodes, edges, G.ghosts(nodes, live))[1]


_LOST = "(SELECT 'doc_' || doc_id FROM labels WHERE quality = 0)"


def _stripped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph in which documents of low quality have lost their edges, and all words."""
    words = _words(spark, sf_dir)
    nodes, edges = G.build(words)
    low = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select(G.document_node(F.col("doc_id")).alias("source"))
    return written_once(nodes), written_once(edges.join(low, "source", "left_anti")), words


@query(f"WITH {_BASE} SELECT id FROM nodes WHERE category = 'document' AND id IN {_LOST}")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _stripped(spark, sf_dir)
    return G.unlinked_documents(nodes, edges)


@query(f"WITH {_BASE} SELECT source, target, type FROM edges")
def graph_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without edges get theirs back."""
    return G.rebuild_unlinked(*_stripped(spark, sf_dir))[1].select("source", "target", "type")


_MERGE = (("The", "And"), ("Der", "Die"))


@query(f"""
WITH {_BASE}, p(variant, pri) AS (VALUES ('The', 'And'), ('Der', 'Die')),
m AS (SELECT v.id AS o, n.id AS w FROM nodes v JOIN p ON v.name = variant JOIN nodes n ON n.name = pri)
SELECT DISTINCT coalesce(s.w, source) AS source, coalesce(t.w, target) AS target, type FROM edges LEFT JOIN m s ON s.o = source LEFT JOIN m t ON t.o = target""")
def graph_merge_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_synonyms(*_graph(spark, sf_dir), _MERGE)[1].select("source", "target", "type")


@query(f"WITH {_BASE} SELECT target AS id, count(DISTINCT source) AS n_docs FROM edges WHERE type = '提及' GROUP BY target HAVING count(DISTINCT source) >= 2")
def graph_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_entities(_graph(spark, sf_dir)[1])


@query(f"""
WITH {_BASE}, p AS (SELECT target AS id, CAST(substr(source, 5) AS BIGINT) AS doc_id FROM edges WHERE type = '提及'),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS k FROM p QUALIFY k <= 4),
sides AS (SELECT placed.id, placed.doc_id, k, p.id AS e, row_number() OVER (PARTITION BY placed.id, placed.doc_id ORDER BY p.id) AS r FROM placed JOIN p USING (doc_id) WHERE placed.id <> p.id QUALIFY r <= 5),
pairs AS (SELECT a.id AS shared, a.doc_id AS doc_a, b.doc_id AS doc_b, a.e AS a, b.e AS b, row_number() OVER (ORDER BY b.k, a.id, a.k, a.r, b.r) AS o FROM sides a JOIN sides b ON a.id = b.id AND a.k < b.k)
SELECT shared, doc_a, doc_b, a, b FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY o) = 1) ORDER BY o LIMIT 20""")
def graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities whose relation is to be judged."""
    return G.candidate_pairs(written_once(provenance_of(spark, sf_dir)))


@query(f"WITH {_BASE} SELECT DISTINCT target AS id FROM edges WHERE type = '提及' AND source IN (SELECT 'doc_' || doc_id FROM labels WHERE toxic = 0)")
def graph_founded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a live document is known for."""
    return G.founded(provenance_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0"))


_TOLD = "VALUES (0, '提示词'), (1, ' The '), (2, 'a'), (3, 'Alice'), (4, 'zzqx nowhere')"


@query(f"""
WITH e AS (SELECT doc_id, k, CASE WHEN k = 1 THEN substr(text, 20, 5) ELSE name END AS name FROM documents, ({_TOLD}) t(k, name)),
g AS (SELECT doc_id, k, regexp_replace(e.name, '^\\s+|\\s+$', '', 'g') AS name, 'doc_' || doc_id || ' ' || substr(text, 1, 1500) AS t FROM e JOIN documents USING (doc_id))
SELECT doc_id, k, name FROM g WHERE length(name) >= 2 AND name NOT IN ('Alice') AND contains(t, name)""")
def graph_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names told of each document: one cut from its text, and some that aren't there, too short or examples."""
    docs = documents(spark, sf_dir)
    told = spark.createDataFrame([(0, "提示词"), (1, None), (2, "a"), (3, "Alice"), (4, "zzqx nowhere")], "k int, name string")
    entities = docs.select("doc_id", F.substring("content", 20, 5).alias("_cut")).crossJoin(F.broadcast(told)).select("doc_id", "k", F.coalesce("name", "_cut").alias("name"))  # five rows
    return G.guarded(entities, docs)


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as documents, their nations as extracted entities, and a relation from each to the region's least."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").cast("string").alias("ref"), F.col("n_name").alias("name"))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lit("kb").alias("kb_id"), F.col("r_regionkey").cast("long").alias("doc_id"), F.col("r_name").alias("title"))
    shared = nations.filter("ref = '0'").withColumn("doc_id", F.lit(1).cast("long"))
    entities = nations.unionByName(shared).select("doc_id", "ref", "name", F.lit("地区").alias("type"), F.concat(F.lit("in "), F.col("doc_id").cast("string")).alias("description"))
    least = nations.groupBy("doc_id").agg(F.min("ref").alias("target"))
    relations = nations.join(least, "doc_id").select("doc_id", F.col("ref").alias("source"), "target", F.lit("邻接").alias("type"))
    return regions, entities, relations.unionByName(spark.createDataFrame([(0, "0", "none", "x")], "doc_id long, source string, target string, type string"))


_ENT = "'ent_' || substr(md5({0}), 1, 8)"


@query(f"""
WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(n_nationkey AS VARCHAR) AS ref, n_name AS name FROM nation),
m AS (SELECT doc_id, arg_min(name, ref) AS name FROM n GROUP BY doc_id)
SELECT 'doc_' || doc_id AS source, {_ENT.format('name')} AS target, '包含' AS type FROM n
UNION ALL SELECT 'doc_1', {_ENT.format('name')}, '包含' FROM n WHERE ref = '0'
UNION ALL SELECT {_ENT.format('n.name')}, {_ENT.format('m.name')}, '邻接' FROM n JOIN m USING (doc_id)""")
def graph_from_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of entities and relations that something else has extracted."""
    return G.from_entities(*_nations(spark, sf_dir))[1]


@query(f"WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey, n_name FROM nation) SELECT {_ENT.format('n_name')} AS id, n_name AS name, 'in ' || doc_id AS description, CAST(CASE WHEN n_nationkey = 0 AND doc_id <> 1 THEN 2 ELSE 1 END AS BIGINT) AS n_docs FROM n")
def graph_entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the description of their first document and the number of documents that they come from."""
    nodes, _, provenance = G.from_entities(*_nations(spark, sf_dir))
    counts = provenance.groupBy("id").agg(F.count(F.lit(1)).alias("n_docs"))
    return nodes.filter("category = 'entity'").join(counts, "id").select("id", "name", "description", "n_docs")


def _with_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf_dir)
    docs = nodes.filter("category = 'document'")
    return nodes, edges.unionByName(docs.select(F.col("id").alias("source"), F.concat(F.lit("doc_"), (F.col("doc_id") + 1).cast("string")).alias("target"), F.lit("相关").alias("type")))


@query(f"WITH {_BASE} SELECT source, target, type FROM edges UNION ALL SELECT 'doc_' || max(doc_id), 'doc_' || (max(doc_id) + 1), '相关' FROM documents")
def graph_doc_doc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.no_document_pairs(*_with_pairs(spark, sf_dir))


@query(f"WITH {_BASE}, s AS (SELECT count(*) AS n, count(DISTINCT type) AS t FROM nodes) SELECT id, type FROM (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM nodes), s WHERE n <= 400 OR r <= 400 // t")
def graph_sample_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sample_by_type(_graph(spark, sf_dir)[0]).select("id", "type")


@query(f"WITH {_BASE}, l AS (SELECT * FROM edges WHERE source <> 'doc_7' AND target <> 'doc_7') SELECT id FROM nodes WHERE id <> 'doc_7' AND (category <> 'entity' OR id IN (SELECT source FROM l UNION SELECT target FROM l))")
def graph_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.remove_document(*_graph(spark, sf_dir), 7)[0].select("id")


@query(f"WITH {_BASE} SELECT id, name FROM nodes")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = written_once(G.extracted(docs))
    return G.union([G.build(words.filter("kb_id = 'en'")), G.build(words.filter("kb_id <> 'en'"))])[0].select("id", "name")


@query(f"WITH {_BASE} SELECT target, type, count(*) AS n FROM (SELECT source, target, type FROM edges UNION ALL SELECT source, target, type FROM edges WHERE type = '属于') GROUP BY ALL")
def graph_union_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two graphs that share some stay as often as they occur."""
    nodes, edges = graph_of(spark, sf_dir)
    both = G.union([(nodes, edges), (nodes, edges.filter(F.col("type") == G.RELATIONS["belongs"]))])[1]
    return both.groupBy("target", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BASE} SELECT name, count(*) AS n FROM (SELECT name FROM nodes WHERE contains(lower(name || ' ' || description), 'worth') UNION ALL SELECT name FROM nodes WHERE contains(lower(name || ' ' || description), 'worth') AND category = 'entity') GROUP BY name")
def graph_search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question asked of two graphs: nodes stay as often as they are found."""
    nodes, _ = graph_of(spark, sf_dir)
    graphs = [nodes, nodes.filter("category = 'entity'")]
    found = [g.join(G.seeds_for(g, ["worth"]), "id", "left_semi").select("name") for g in graphs]
    return found[0].unionAll(found[1]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN source = lang THEN source || ',x' ELSE source || ',x,' || lang END AS vocabulary FROM documents")
def graph_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of types joined in their order, each once."""
    joined = G.joined_vocabulary(F.array("category", F.lit("x")), F.array("kb_id", "category"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(joined, ",").alias("vocabulary"))


@query(f"WITH {_BASE}, f AS (SELECT id FROM nodes WHERE name IN ('The', 'Die')) SELECT source, target, type FROM edges WHERE target NOT IN (SELECT id FROM f)")
def graph_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.remove_fragments(*_graph(spark, sf_dir), ("The", "Die"))[1]


#: Planted nodes (id, name, type, description, kb_id) and edges (source, target, type), and what maintenance leaves of them.
PLANTED_NODES = (
    ("ent_syn", "大模型", "概念", "", None), ("ent_pri", "LLM（大语言模型）", "概念", "", None), ("ent_alone", "感知（Perception）", "概念", "", None), ("ent_frag", "测试", "概念", "", None),
    ("ent_made", "X", "产品", "", None), ("ent_long", "Y", "事件", "a description of some length", None), ("ent_short", "Z", "概念", "short", "en"), ("ent_other", "W", "人物", "", "en"), ("ent_known", "V", "技术", "", None),
)
PLANTED_EDGES = (("doc_0", "ent_syn", "提及"), ("doc_0", "ent_pri", "提及"), ("doc_1", "ent_syn", "提及"), ("doc_1", "ent_alone", "提及"), ("doc_1", "ent_frag", "提及"), ("doc_0", "doc_1", "相关"))
KNOWN = ("ent_known", 0)


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = graph_of(spark, sf_dir)
    more = spark.createDataFrame([(*n, None) for n in PLANTED_NODES], "id string, name string, type string, description string, kb_id string, category string")
    provenance = spark.createDataFrame([KNOWN], "id string, doc_id long")
    return G.with_categories(nodes.unionByName(more, True)), edges.unionByName(spark.createDataFrame(list(PLANTED_EDGES), "source string, target string, type string")), provenance


@query(f"WITH {_BASE} SELECT id, category FROM nodes UNION ALL SELECT * FROM (VALUES ('ent_syn', 'entity'), ('ent_pri', 'entity'), ('ent_alone', 'entity'), ('ent_frag', 'entity'), ('ent_short', 'entity'), ('ent_other', 'entity'), ('ent_known', 'entity')) p")
def graph_unfounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the planted entities, an invented product and an invented event go."""
    nodes, edges, provenance = _planted(spark, sf_dir)
    return G.without(nodes, edges, G.unfounded(nodes, edges, provenance))[0].select("id", "category")


@query(f"WITH {_BASE}, first AS (SELECT min(doc_id) AS d FROM documents WHERE lang = 'en') SELECT source, target, type FROM edges UNION ALL SELECT 'doc_' || d, t, '提及' FROM first, (VALUES ('ent_short'), ('ent_other')) v(t)")
def graph_link_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted entities of a base with documents are linked to its first one."""
    nodes, edges, _ = _planted(spark, sf_dir)
    planted = spark.createDataFrame([(s, t, k) for s, t, k in PLANTED_EDGES], "source string, target string, type string")
    return G.link_orphans(nodes, edges).join(planted, ["source", "target", "type"], "left_anti")


@query(f"""
WITH {_BASE}, live AS ({_LIVE}), gone AS (SELECT id FROM nodes WHERE category = 'document' AND doc_id NOT IN (SELECT doc_id FROM live)),
first AS (SELECT min(doc_id) AS d FROM documents WHERE lang = 'en'),
planted AS (SELECT * FROM (VALUES ('doc_0', 'ent_pri', '提及'), ('doc_1', 'ent_pri', '提及'), ('doc_1', 'ent_alone', '提及')) p(source, target, type) UNION ALL SELECT 'doc_' || d, t, '提及' FROM first, (VALUES ('ent_short'), ('ent_other')) v(t))
SELECT source, target, type FROM (SELECT * FROM edges UNION ALL SELECT * FROM planted) WHERE source NOT IN (SELECT id FROM gone)""")
def graph_maintain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step has planted nodes or edges to mend."""
    nodes, edges, provenance = _planted(spark, sf_dir)
    live = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").select("doc_id")
    return G.maintain(nodes, edges, live, provenance)[1].select("source", "target", "type")


@query(f"WITH {_BASE} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from a copy that is named by its time."""
    path = G.backup(*G.build(_words(spark, sf_dir)), f"{shared_folder(spark)}/backup-{uuid.uuid4().hex}", "20240102T030405")
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"))))  # one row each
