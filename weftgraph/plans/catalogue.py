"""The catalogue: every query with its equivalent in DuckDB's SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import graphlet as G
from ..operators import kernels as K
from ..operators import objectives as O
from ..operators import relational as R
from ..operators import shortest_path as S
from ..operators import walks as W
from ..operators import wl as L
from ..operators.patterns import with_probabilities
from ..session import settle
from ..sources.derive import G1_SQL, G2_SQL, customer_suppliers, user_events
from ..sources.docs import sentences
from . import pipelines as P
from . import sweeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DEPTH, DIM, WINDOW, SEED, SAMPLES, STEPS, WALKS = 2, 4, 3, 7, 5, 4, 3


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip().rstrip(",") for p in parts)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# ---- relational building blocks ----

MEMBERS_SQL = "members AS (SELECT event_id AS node, cast(user_id AS bigint) AS graph_id FROM events)"


def _raw_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _table(spark, sf_dir, "events")
    members = events.select(F.col("event_id").alias("node"), F.col("user_id").cast("bigint").alias("graph_id"))
    raw = events.select(F.col("event_id").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"))
    return raw.select("x", (F.col("x") + F.col("k")).alias("y")), members


@query(_with(MEMBERS_SQL, "raw AS (SELECT event_id AS x, event_id + k AS y FROM events, (SELECT unnest(range(1, 41)) AS k))") + " SELECT a.graph_id, x, y FROM raw JOIN members a ON a.node = x JOIN members b ON b.node = y WHERE a.graph_id = b.graph_id")
def valid_edges(spark, sf_dir):
    return R.valid_edges(*_raw_edges(spark, sf_dir))


@query(_with(G2_SQL) + " SELECT DISTINCT graph_id, least(x.node_id, y.node_id) AS src, greatest(x.node_id, y.node_id) AS dst FROM g2_moves m JOIN g2_ids x USING (graph_id, name) JOIN (SELECT graph_id, name AS next, node_id FROM g2_ids) y USING (graph_id, next)")
def edge_dedup(spark, sf_dir):
    e = user_events(spark, sf_dir).edges
    return R.simple_edges(R.both_ways(e.select("graph_id", "src", "dst")))


@query(_with(G1_SQL, "d AS (SELECT graph_id, node_id, count(*) AS n FROM (SELECT graph_id, src AS node_id FROM g1_edges UNION ALL SELECT graph_id, dst FROM g1_edges) GROUP BY ALL)") + " SELECT n.graph_id, n.node_id, cast(coalesce(d.n, 0) AS varchar) AS label FROM g1_nodes n LEFT JOIN d USING (graph_id, node_id)")
def node_degree_label(spark, sf_dir):
    g = customer_suppliers(spark, sf_dir)
    return R.label_or_degree(g.nodes.withColumn("label", F.lit(None).cast("string")), g.edges)


RENUMBER_SQL = "ends AS (SELECT o_custkey AS graph_id, l_orderkey * 10 + l_linenumber AS row_no, 0 AS side, l_suppkey AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT o_custkey, l_orderkey * 10 + l_linenumber, 1, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f AS (SELECT graph_id, node, min(row_no * 2 + side) AS k FROM ends GROUP BY ALL)"


@query(_with(RENUMBER_SQL) + " SELECT cast(graph_id AS bigint) AS graph_id, cast(node AS bigint) AS node, cast(row_number() OVER (PARTITION BY graph_id ORDER BY k, node) AS integer) AS node_id FROM f")
def node_renumber(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = lines.select(F.col("o_custkey").cast("bigint").alias("graph_id"), F.col("l_suppkey").cast("bigint").alias("src"), F.col("l_partkey").cast("bigint").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))
    return R.renumber(edges)


@query(_with(G1_SQL) + " SELECT graph_id, node_id, label FROM g1_nodes n WHERE EXISTS (SELECT 1 FROM g1_edges e WHERE e.graph_id = n.graph_id AND (e.src = n.node_id OR e.dst = n.node_id))")
def connected_nodes(spark, sf_dir):
    g = customer_suppliers(spark, sf_dir)
    return R.connected_nodes(g.nodes, g.edges)


@query(_with(G1_SQL) + " SELECT graph_id, class_label FROM g1_graphs WHERE class_label IS NOT NULL")
def graphs_with_class(spark, sf_dir):
    g = customer_suppliers(spark, sf_dir).graphs
    return R.with_class(g, g.where("class_label is not null"))


@query(_with(G1_SQL) + " SELECT graph_id, row_number() OVER (ORDER BY graph_name) - 1 AS row_id, class_label FROM g1_graphs WHERE class_label IS NOT NULL")
def kernel_row_index(spark, sf_dir):
    return R.kernel_rows(customer_suppliers(spark, sf_dir).graphs)


# ---- Weisfeiler-Lehman ----

WL_SQL = _with(G1_SQL, L.wl_sql("g1", DEPTH))
WL_TOKENS = "t AS (SELECT graph_id, node_id, it, unnest(list_concat([it || '+' || label], list_transform(list_sort(list_distinct(neighbours)), lambda x: it || '+' || x))) AS pattern FROM wl)"


def _wl(spark, sf_dir, depth: int = DEPTH):
    g = customer_suppliers(spark, sf_dir)
    return L.wl_states(g.nodes, g.edges, depth)


def _wl_counts(spark, sf_dir, mode: str = "doc"):
    g = customer_suppliers(spark, sf_dir)
    return L.wl_graph_counts(g.nodes, g.edges, DEPTH, mode)


@query(WL_SQL + " SELECT graph_id, node_id, it, label FROM wl")
def wl_labels(spark, sf_dir):
    return _wl(spark, sf_dir).select("graph_id", "node_id", "it", "label")


@query(WL_SQL + f", {WL_TOKENS} SELECT graph_id, pattern, count(*) AS cnt FROM t GROUP BY ALL")
def wl_counts_doc(spark, sf_dir):
    return _wl_counts(spark, sf_dir)


@query(WL_SQL + " SELECT graph_id, it || '+' || label AS pattern, count(*) AS cnt FROM wl GROUP BY ALL")
def wl_counts_centre(spark, sf_dir):
    return _wl_counts(spark, sf_dir, "centre")


@query(WL_SQL + f", {WL_TOKENS}, c AS (SELECT graph_id, pattern, count(*) AS cnt FROM t GROUP BY ALL) SELECT graph_id, pattern, cnt, cnt / sum(cnt) OVER (PARTITION BY graph_id) AS prob FROM c")
def wl_prob(spark, sf_dir):
    return with_probabilities(_wl_counts(spark, sf_dir))


@query(WL_SQL + f" SELECT graph_id, 'wl' AS doc_kind, node_id * {L.LINES} + it AS line_no, array_to_string(list_concat([it || '+' || label], list_transform(list_sort(list_distinct(neighbours)), lambda x: it || '+' || x)), ' ') AS tokens FROM wl")
def wl_docs(spark, sf_dir):
    return L.wl_docs(_wl(spark, sf_dir)).withColumn("tokens", F.array_join("tokens", " "))


@query(WL_SQL + " SELECT it, label, it || '+' || (dense_rank() OVER (PARTITION BY it ORDER BY label) - 1) AS pattern FROM (SELECT DISTINCT it, label FROM wl)")
def wl_dense_labels(spark, sf_dir):
    return L.wl_dense_labels(_wl(spark, sf_dir))


@query(WL_SQL + f", {WL_TOKENS} SELECT DISTINCT pattern FROM t")
def wl_vocabulary(spark, sf_dir):
    return _wl_counts(spark, sf_dir).select("pattern").distinct()


# ---- shortest paths ----

#: More than the longest distance of a graph of G2 (it has at most 5 * 24 nodes).
LONGEST = 40
SP_SQL = _with(G2_SQL, S.sp_sql("g2", LONGEST), recursive=True)
SP_COMPAT_SQL = _with(G2_SQL, S.sp_sql("g2", LONGEST, True), recursive=True)


def _sp(spark, sf_dir, compat: bool = False):
    g = user_events(spark, sf_dir)
    return S.sp_corpus(g.nodes, g.edges, compat)


@query(SP_SQL + " SELECT graph_id, pattern, count(*) AS cnt FROM sp GROUP BY ALL")
def sp_counts(spark, sf_dir):
    return _sp(spark, sf_dir).counts


@query(SP_SQL + ", c AS (SELECT graph_id, pattern, count(*) AS cnt FROM sp GROUP BY ALL) SELECT graph_id, pattern, cnt, round(cnt / sum(cnt) OVER (PARTITION BY graph_id), 6) AS prob FROM c")
def sp_prob(spark, sf_dir):
    return _sp(spark, sf_dir).prob.withColumn("prob", _r(F.col("prob")))


@query(SP_SQL + " SELECT graph_id, 'sp' AS doc_kind, src AS line_no, string_agg(pattern, ' ' ORDER BY dst) AS tokens FROM sp GROUP BY ALL")
def sp_docs(spark, sf_dir):
    return _sp(spark, sf_dir).docs.withColumn("tokens", F.array_join("tokens", " "))


@query(SP_COMPAT_SQL + " SELECT graph_id, pattern, count(*) AS cnt FROM sp GROUP BY ALL")
def sp_counts_compat(spark, sf_dir):
    return _sp(spark, sf_dir, True).counts


# ---- graphlets ----


def _graphlets(n: int, name: str, star: bool = False):
    @query(_with(G1_SQL, G.graphlet_sql("g1", n, SAMPLES, SEED, star)) + " SELECT graph_id, pattern, cnt FROM gl", name)
    def run(spark, sf_dir):
        g = customer_suppliers(spark, sf_dir)
        return G.graphlet_corpus(g.nodes, g.edges, n, SAMPLES, SEED, star).counts


for _n in (3, 4, 5):
    _graphlets(_n, f"graphlet{_n}_counts")
_graphlets(4, "graphlet_star_compat", True)


@query(name="graphlet6_counts")
def graphlet6_counts(spark, sf_dir):
    g = user_events(spark, sf_dir)
    return G.graphlet_corpus(g.nodes, g.edges, 6, SAMPLES, SEED).counts


@query(name="graphlet7_counts")
def graphlet7_counts(spark, sf_dir):
    g = user_events(spark, sf_dir)
    return G.graphlet_corpus(g.nodes, g.edges, 7, 2, SEED).counts


@query(_with(G1_SQL) + " SELECT graph_id, '1253' AS pattern, cast(5 AS bigint) AS cnt FROM g1_nodes GROUP BY graph_id HAVING count(*) < 8")
def graphlet_fallback(spark, sf_dir):
    return G.small_graph_counts(customer_suppliers(spark, sf_dir).nodes, 8, SAMPLES)


@query(
    _with(G1_SQL, G.graphlet_sql("g1", 4, SAMPLES, SEED)) + " SELECT graph_id, 'graphlet' AS doc_kind, cast(sample AS integer) AS line_no, string_agg(idx, ' ' ORDER BY w) AS tokens FROM gl_idx GROUP BY ALL"
)
def graphlet_docs(spark, sf_dir):
    g = customer_suppliers(spark, sf_dir)
    return G.graphlet_corpus(g.nodes, g.edges, 4, SAMPLES, SEED).docs.withColumn("tokens", F.array_join("tokens", " "))


# ---- walks ----


@query(_with(G1_SQL, W.transitions_sql("g1")) + " SELECT graph_id, src, dst, round(p, 6) AS p, round(cum_lo, 6) AS cum_lo, round(cum_hi, 6) AS cum_hi FROM rw")
def transition_graph(spark, sf_dir):
    return W.transitions(customer_suppliers(spark, sf_dir).edges).select("graph_id", "src", "dst", *[_r(F.col(c)).alias(c) for c in ("p", "cum_lo", "cum_hi")])


def _walk_sql(setting: str | None) -> str:
    return _with(G1_SQL, W.walk_sql("g1", STEPS, WALKS, SEED), W.anonymous_sql(setting), recursive=True)


@query(_walk_sql("nodes") + " SELECT graph_id, pattern, count(*) AS cnt FROM rw_pattern GROUP BY ALL")
def random_walk_counts(spark, sf_dir):
    g = customer_suppliers(spark, sf_dir)
    return W.rw_corpus(g.nodes, g.edges, STEPS, WALKS, SEED).counts


@query(_walk_sql("nodes") + " SELECT graph_id, 'rw' AS doc_kind, start AS line_no, string_agg(pattern, ' ' ORDER BY walk) AS tokens FROM rw_pattern GROUP BY ALL")
def random_walk_docs(spark, sf_dir):
    g = customer_suppliers(spark, sf_dir)
    return W.rw_corpus(g.nodes, g.edges, STEPS, WALKS, SEED).docs.withColumn("tokens", F.array_join("tokens", " "))


def _anonymous(setting: str | None):
    label = setting or "none"

    @query(_walk_sql(setting) + " SELECT graph_id, pattern, count(*) AS cnt FROM rw_pattern GROUP BY ALL", f"anon_walk_counts_{label}")
    def counts(spark, sf_dir):
        g = customer_suppliers(spark, sf_dir)
        return W.awe_corpus(g.nodes, g.edges, STEPS, setting, WALKS, SEED).counts

    def grown(first: str, last: int, limit: str) -> str:
        return f"w(p, m, n) AS (SELECT {first} UNION ALL SELECT list_append(p, j), greatest(m, j), n + 1 FROM w, (SELECT unnest(range({last + 2})) AS j) WHERE n < {last} AND j <= m + 1{limit})"

    ordered = "row_number() OVER (ORDER BY list_reverse(p)) - 1"
    if setting == "edges_nodes":
        edge, node = grown("[0], 0, 1", STEPS, "").replace("w(p", "e(p").replace("FROM w,", "FROM e,"), grown("[0], 0, 1", STEPS + 1, "")
        pairs = f"list_concat([y.p[1]], flatten([[x.p[i], y.p[i + 1]] for i in range(1, {STEPS + 1})]))"
        sql = _with(edge, node, recursive=True) + f" SELECT cast(row_number() OVER (ORDER BY list_reverse(x.p), list_reverse(y.p)) - 1 AS integer) AS walk_id, array_to_string({pairs}, '_') AS pattern FROM e x, w y WHERE x.n = {STEPS} AND y.n = {STEPS + 1}"
    else:
        length = STEPS + (setting != "edges")
        sql = _with(grown("[0], 0, 1", length, " AND j <> p[n]" if setting is None else ""), recursive=True) + f" SELECT cast({ordered} AS integer) AS walk_id, array_to_string(p, '_') AS pattern FROM w WHERE n = {length}"

    @query(sql, f"anon_walk_enum_{label}")
    def enum(spark, sf_dir):
        return W.enumerate_walks(spark, STEPS, setting)


for _setting in (None, "nodes", "edges", "edges_nodes"):
    _anonymous(_setting)


# ---- corpora ----

DOCS_SQL = _with(G2_SQL, L.wl_sql("g2", 1), f"docs AS (SELECT graph_id, node_id * {L.LINES} + it AS line_no, list_concat([it || '+' || label], list_transform(list_sort(list_distinct(neighbours)), lambda x: it || '+' || x)) AS tokens FROM wl)")


def _docs(spark, sf_dir) -> DataFrame:
    g = user_events(spark, sf_dir)
    return L.wl_docs(L.wl_states(g.nodes, g.edges, 1))


def _vocab_sql(window: int | None, min_count: int = 0) -> str:
    last = 1 if window is None else window + 1
    unknown = " UNION ALL SELECT 'UNK', 1, {'g': '~', 'l': 0, 'p': 0}" if window is None else ""
    return f""",
tok AS (SELECT cast(graph_id AS varchar) AS g, line_no, unnest(tokens[1:{last}]) AS pattern, unnest(range(len(tokens[1:{last}]))) AS place FROM docs),
freq AS (SELECT pattern, count(*) AS freq, min({{'g': g, 'l': line_no, 'p': place}}) AS first FROM tok GROUP BY ALL{unknown}),
ids AS (SELECT pattern, row_number() OVER (ORDER BY first) - 1 AS pattern_id, freq FROM freq WHERE freq >= {min_count}),
sized AS (SELECT *, {C.SUBSAMPLE}::double / (freq / sum(freq) OVER ()) AS share, cast(round_even(sqrt(freq) / sum(sqrt(freq)) OVER () * {C.SLOTS}, 0) AS bigint) AS slots FROM ids),
vocab AS (SELECT pattern, pattern_id, freq, sqrt(share) + share AS discard, cast(sum(slots) OVER (ORDER BY pattern_id) - slots AS bigint) AS neg_lo, cast(sum(slots) OVER (ORDER BY pattern_id) AS bigint) AS neg_hi FROM sized)"""


GRAPH_ROWS_SQL = ", grows AS (SELECT graph_id, row_number() OVER (ORDER BY cast(graph_id AS varchar)) - 1 AS graph_row FROM (SELECT DISTINCT graph_id FROM docs))"


@query(DOCS_SQL + _vocab_sql(None) + " SELECT pattern, pattern_id, freq FROM vocab")
def vocab_centre(spark, sf_dir):
    return C.vocabulary(C.token_frequencies(_docs(spark, sf_dir))).select("pattern", "pattern_id", "freq")


@query(DOCS_SQL + _vocab_sql(WINDOW) + " SELECT pattern, pattern_id, freq FROM vocab")
def vocab_window(spark, sf_dir):
    return C.vocabulary(C.token_frequencies(_docs(spark, sf_dir), WINDOW)).select("pattern", "pattern_id", "freq")


@query(DOCS_SQL + _vocab_sql(WINDOW, 5) + " SELECT pattern, pattern_id, freq FROM vocab")
def vocab_min_count(spark, sf_dir):
    return C.vocabulary(C.token_frequencies(_docs(spark, sf_dir), WINDOW), 5).select("pattern", "pattern_id", "freq")


@query(DOCS_SQL + _vocab_sql(WINDOW) + " SELECT pattern, round(discard, 9) AS discard FROM vocab")
def subsample_discard(spark, sf_dir):
    return C.vocabulary(C.token_frequencies(_docs(spark, sf_dir), WINDOW)).select("pattern", _r(F.col("discard"), 9).alias("discard"))


@query(DOCS_SQL + _vocab_sql(WINDOW) + " SELECT pattern_id, neg_lo, neg_hi FROM vocab")
def negative_slots(spark, sf_dir):
    return C.vocabulary(C.token_frequencies(_docs(spark, sf_dir), WINDOW)).select("pattern_id", "neg_lo", "neg_hi")


@query(
    """WITH lines AS (SELECT doc_id AS graph_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
docs AS (SELECT graph_id, line_no, regexp_split_to_array(trim(line, ' '), '[ \t]+') AS tokens FROM lines WHERE trim(line, ' ') <> '')
SELECT graph_id, count(*) AS n_lines, cast(sum(len(tokens)) AS bigint) AS n_tokens FROM docs GROUP BY ALL"""
)
def text_documents(spark, sf_dir):
    return C.word_order_counts(sentences(_table(spark, sf_dir, "documents")))


def _negatives_sql(source: str, keys: list[str], avoid: str) -> str:
    u = uniform_sql(SEED, *keys, "k")
    cols = ", ".join(keys)
    return f""",
own AS (SELECT pattern_id AS avoid, neg_lo AS own_lo, neg_hi - neg_lo AS own FROM vocab),
asked AS (SELECT s.*, own_lo, coalesce(own, 0) AS own, (SELECT max(neg_hi) FROM vocab) - coalesce(own, 0) AS rest FROM {source} s LEFT JOIN own ON own.avoid = s.{avoid}),
draws AS (SELECT *, cast(floor({u} * rest) AS bigint) AS place FROM asked, (SELECT unnest(range({C.NEGATIVES})) AS k) WHERE rest > 0),
drawn AS (SELECT {cols}, k, place + CASE WHEN place >= own_lo THEN own ELSE 0 END AS slot FROM draws),
hit AS (SELECT {cols}, k, pattern_id FROM drawn ASOF JOIN (SELECT * FROM vocab WHERE neg_hi > neg_lo) v ON drawn.slot >= v.neg_lo),
negs AS (SELECT {cols}, list(pattern_id ORDER BY k) AS negatives FROM hit GROUP BY ALL)"""


PVDBOW_SQL = ", pairs AS (SELECT d.graph_id, line_no, graph_row AS target, pattern_id AS context FROM docs d JOIN vocab ON pattern = tokens[1] JOIN grows USING (graph_id))"


def _pvdbow(spark, sf_dir):
    docs = settle(_docs(spark, sf_dir))
    vocab = settle(C.vocabulary(C.token_frequencies(docs)))
    return docs, vocab, settle(C.pvdbow_pairs(docs, vocab, C.graph_rows(docs)))


@query(DOCS_SQL + _vocab_sql(None) + GRAPH_ROWS_SQL + PVDBOW_SQL + " SELECT graph_id, line_no, target, context FROM pairs")
def pvdbow_pairs(spark, sf_dir):
    return _pvdbow(spark, sf_dir)[2]


@query(DOCS_SQL + _vocab_sql(None) + GRAPH_ROWS_SQL + PVDBOW_SQL + _negatives_sql("pairs", ["graph_id", "line_no"], "context") + " SELECT graph_id, line_no, array_to_string(negatives, ' ') AS negatives FROM negs")
def negative_draws(spark, sf_dir):
    _, vocab, pairs = _pvdbow(spark, sf_dir)
    return C.negatives(pairs, vocab, ["graph_id", "line_no"], "context", seed=SEED).withColumn("negatives", F.array_join(F.transform("negatives", lambda x: x.cast("string")), " "))


LINE_SQL = f""",
lt AS (SELECT graph_id, line_no, unnest(tokens[1:{WINDOW + 1}]) AS pattern, unnest(range(len(tokens[1:{WINDOW + 1}]))) AS place FROM docs),
ln AS (SELECT graph_id, line_no, list(pattern_id ORDER BY place) AS ids FROM lt JOIN vocab USING (pattern) GROUP BY ALL),
pl AS (SELECT graph_id, line_no, ids, unnest(range(len(ids))) AS i FROM ln)"""
PAIR_SQL = ", pairs AS (SELECT a.graph_id, a.line_no, cast(a.i AS integer) AS i, cast(b.i AS integer) AS j, a.ids[a.i + 1] AS target, a.ids[b.i + 1] AS context FROM pl a JOIN pl b ON a.graph_id = b.graph_id AND a.line_no = b.line_no AND a.i <> b.i)"


def _window_vocab(spark, sf_dir):
    docs = settle(_docs(spark, sf_dir))
    return docs, settle(C.vocabulary(C.token_frequencies(docs, WINDOW)))


@query(DOCS_SQL + _vocab_sql(WINDOW) + LINE_SQL + PAIR_SQL + " SELECT * FROM pairs")
def skipgram_pairs(spark, sf_dir):
    return C.skipgram_pairs(*_window_vocab(spark, sf_dir), WINDOW)


@query(
    DOCS_SQL + _vocab_sql(WINDOW) + LINE_SQL + PAIR_SQL + f", r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, line_no ORDER BY {uniform_sql(SEED, 'graph_id', 'line_no', 'i', 'j')}, i, j) AS n FROM pairs) SELECT graph_id, line_no, i, j, target, context FROM r WHERE n = 1"
)
def skipgram_pick(spark, sf_dir):
    return C.skipgram_pairs(*_window_vocab(spark, sf_dir), WINDOW, seed=SEED)


CBOW_SQL = f""",
others AS (SELECT graph_id, line_no, cast(i AS integer) AS i, ids[i + 1] AS target, list_concat(ids[1:i], ids[i + 2:]) AS o FROM pl WHERE len(ids) > 1),
cbow AS (SELECT graph_id, line_no, i, target, [o[k % len(o) + 1] for k in range({WINDOW})] AS contexts FROM others)"""


@query(DOCS_SQL + _vocab_sql(WINDOW) + LINE_SQL + CBOW_SQL + " SELECT graph_id, line_no, i, target, array_to_string(contexts, ' ') AS contexts FROM cbow")
def cbow_examples(spark, sf_dir):
    return C.cbow_examples(*_window_vocab(spark, sf_dir), WINDOW).withColumn("contexts", F.array_join(F.transform("contexts", lambda x: x.cast("string")), " "))


@query(DOCS_SQL + _vocab_sql(WINDOW) + LINE_SQL + CBOW_SQL + GRAPH_ROWS_SQL + " SELECT graph_id, line_no, i, graph_row AS graph, target, array_to_string(contexts, ' ') AS contexts FROM cbow JOIN grows USING (graph_id)")
def pvdm_examples(spark, sf_dir):
    docs, vocab = _window_vocab(spark, sf_dir)
    return C.pvdm_examples(docs, vocab, C.graph_rows(docs), WINDOW).withColumn("contexts", F.array_join(F.transform("contexts", lambda x: x.cast("string")), " "))


@query(DOCS_SQL + f", tok AS (SELECT unnest(tokens[1:{WINDOW + 1}]) AS pattern FROM docs) SELECT pattern, count(*) AS freq FROM tok GROUP BY ALL")
def vocab_incremental(spark, sf_dir):
    docs = settle(_docs(spark, sf_dir))
    first, more = docs.where("graph_id % 3 <> 0"), docs.where("graph_id % 3 <> 1")
    return C.add_documents(C.token_frequencies(first, WINDOW), more, first, WINDOW).select("pattern", "freq")


# ---- objectives ----


def _vector_sql(name: str, ids: str, dim: int, seed: int) -> str:
    parts = ", ".join(f"({uniform_sql(seed, 'id', str(j))} * 2 - 1) * {1.0 / DIM!r}::double" for j in range(dim))
    return f", {name} AS (SELECT id, [{parts}] AS v FROM ({ids}))"


CLAMPED = "greatest(least({x}, 10.0::double), -10.0::double)"


def _loss_sql(source: str, hidden: str, keys: list[str]) -> str:
    """losses (keys, loss) from ``source`` (keys, hidden vector, positive vector, negatives)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(keys)
    s = CLAMPED.format(x="list_dot_product(hidden, pos)")
    n = CLAMPED.format(x="-list_dot_product(hidden, v)")
    return f""",
ex AS (SELECT {cols}, {hidden} AS hidden, pos, negatives FROM {source}),
un AS (SELECT {cols}, hidden, unnest(negatives) AS id FROM ex),
nl AS (SELECT {cols}, sum(ln(1 + exp(-({n})))) AS l FROM un JOIN ctx USING (id) GROUP BY ALL),
losses AS (SELECT {', '.join('a.' + k for k in keys)}, round(ln(1 + exp(-({s}))) + l, 6) AS loss FROM ex a JOIN nl b ON {on})"""


PVDBOW_LOSS = (
    DOCS_SQL + _vocab_sql(None) + GRAPH_ROWS_SQL + PVDBOW_SQL + _negatives_sql("pairs", ["graph_id", "line_no"], "context") + _vector_sql("tgt", "SELECT graph_row AS id FROM grows", DIM, 1) + _vector_sql("ctx", "SELECT pattern_id AS id FROM vocab", DIM, 2)
    + ", src AS (SELECT p.graph_id, p.line_no, t.v AS hidden, c.v AS pos, negatives FROM pairs p JOIN negs n ON n.graph_id = p.graph_id AND n.line_no = p.line_no JOIN tgt t ON t.id = target JOIN ctx c ON c.id = context)"
    + _loss_sql("src", "hidden", ["graph_id", "line_no"])
)


@query(PVDBOW_LOSS + " SELECT * FROM losses")
def sgns_loss(spark, sf_dir):
    docs, vocab, pairs = _pvdbow(spark, sf_dir)
    keys = ["graph_id", "line_no"]
    full = C.with_negatives(pairs, vocab, keys, "context", seed=SEED)
    targets = O.hash_vectors(pairs.select(F.col("target").alias("id")).distinct(), DIM, 1)
    contexts = O.hash_vectors(vocab.select(F.col("pattern_id").alias("id")), DIM, 2)
    return O.skipgram_losses(full, targets, contexts, keys).withColumn("loss", _r(F.col("loss")))


def _cbow_loss_sql(pvdm: bool) -> str:
    keys = ["graph_id", "line_no", "i"]
    hidden = f"[{', '.join(f'h[{j + 1}]' for j in range(DIM))}]"
    sums = ", ".join(f"sum(v[{j + 1}])" for j in range(DIM))
    graph = _vector_sql("gv", "SELECT graph_row AS id FROM grows", DIM, 3) if pvdm else ""
    first = "list_concat(g.v, h)" if pvdm else hidden
    join = " JOIN grows r ON r.graph_id = c.graph_id JOIN gv g ON g.id = r.graph_row" if pvdm else ""
    return (
        DOCS_SQL + _vocab_sql(WINDOW) + LINE_SQL + CBOW_SQL + (GRAPH_ROWS_SQL if pvdm else "") + _negatives_sql("cbow", keys, "target") + _vector_sql("inp", "SELECT pattern_id AS id FROM vocab", DIM, 1) + _vector_sql("ctx", "SELECT pattern_id AS id FROM vocab", DIM * (2 if pvdm else 1), 2) + graph
        + f", hs AS (SELECT graph_id, line_no, i, [{sums}] AS h FROM (SELECT graph_id, line_no, i, unnest(contexts) AS id FROM cbow) JOIN inp USING (id) GROUP BY ALL)"
        + f", src AS (SELECT c.graph_id, c.line_no, c.i, {first} AS hv, o.v AS pos, negatives FROM cbow c JOIN hs ON hs.graph_id = c.graph_id AND hs.line_no = c.line_no AND hs.i = c.i JOIN negs n ON n.graph_id = c.graph_id AND n.line_no = c.line_no AND n.i = c.i JOIN ctx o ON o.id = c.target{join})"
        + _loss_sql("src", "hv", keys) + " SELECT * FROM losses"
    )


def _cbow_inputs(spark, sf_dir, pvdm: bool):
    docs, vocab = _window_vocab(spark, sf_dir)
    keys = ["graph_id", "line_no", "i"]
    graphs = C.graph_rows(docs)
    examples = C.pvdm_examples(docs, vocab, graphs, WINDOW) if pvdm else C.cbow_examples(docs, vocab, WINDOW)
    full = C.with_negatives(examples, vocab, keys, "target", seed=SEED)
    ids = vocab.select(F.col("pattern_id").alias("id"))
    return full, O.hash_vectors(ids, DIM, 1), O.hash_vectors(ids, DIM * 2 if pvdm else DIM, 2, 2.0 if pvdm else 1.0), O.hash_vectors(graphs.select(F.col("graph_row").alias("id")), DIM, 3), keys


@query(_cbow_loss_sql(False))
def cbow_loss(spark, sf_dir):
    full, contexts, output, _, keys = _cbow_inputs(spark, sf_dir, False)
    return O.cbow_losses(full, contexts, output, keys, DIM).withColumn("loss", _r(F.col("loss")))


@query(_cbow_loss_sql(True))
def pvdm_loss(spark, sf_dir):
    full, contexts, output, graphs, keys = _cbow_inputs(spark, sf_dir, True)
    return O.pvdm_losses(full, graphs, contexts, output, keys, DIM).withColumn("loss", _r(F.col("loss")))


# ---- kernels ----

PROB_SQL = _with(G2_SQL, L.wl_sql("g2", 1)) + f", {WL_TOKENS}, c AS (SELECT graph_id, pattern, count(*) AS cnt FROM t GROUP BY ALL), prob AS (SELECT graph_id, pattern, cnt / sum(cnt) OVER (PARTITION BY graph_id) AS prob FROM c)"
PATTERN_VECTOR_SQL = ", pv AS (SELECT pattern, [" + ", ".join(f"({uniform_sql(5, 'pattern', str(j))} * 2 - 1)" for j in range(DIM)) + "] AS v FROM (SELECT DISTINCT pattern FROM prob))"
GRAPH_VECTOR_SQL = ", gv AS (SELECT graph_id, [" + ", ".join(f"sum(prob * v[{j + 1}])" for j in range(DIM)) + "] AS v FROM prob JOIN pv USING (pattern) GROUP BY ALL)"


def _prob(spark, sf_dir) -> DataFrame:
    g = user_events(spark, sf_dir)
    return settle(with_probabilities(L.wl_graph_counts(g.nodes, g.edges, 1)))


def _pattern_vectors(prob: DataFrame) -> DataFrame:
    from ..functions.rng import uniform

    return prob.select("pattern").distinct().select("pattern", F.array(*[uniform(5, F.col("pattern"), F.lit(j)) * 2 - 1 for j in range(DIM)]).alias("vector"))


@query(
    PROB_SQL + """, n AS (SELECT graph_id, sum(cnt) AS n FROM c GROUP BY 1),
pairs AS (SELECT a.graph_id AS g1, b.graph_id AS g2, sum(a.cnt * b.cnt) AS x FROM c a JOIN c b ON a.pattern = b.pattern AND a.graph_id <= b.graph_id GROUP BY ALL)
SELECT g1, g2, x / (a.n * b.n) AS k FROM pairs JOIN n a ON a.graph_id = g1 JOIN n b ON b.graph_id = g2"""
)
def mle_kernel(spark, sf_dir):
    return K.mle_kernel_of_counts(_prob(spark, sf_dir))


@query(PROB_SQL + PATTERN_VECTOR_SQL + GRAPH_VECTOR_SQL + " SELECT a.graph_id AS g1, b.graph_id AS g2, round(list_dot_product(a.v, b.v), 6) AS k FROM gv a JOIN gv b ON a.graph_id <= b.graph_id")
def deep_kernel(spark, sf_dir):
    prob = _prob(spark, sf_dir)
    return K.deep_kernel(prob, _pattern_vectors(prob)).withColumn("k", _r(F.col("k")))


@query(PROB_SQL + PATTERN_VECTOR_SQL + GRAPH_VECTOR_SQL + " SELECT graph_id, pattern, round(list_dot_product(gv.v, pv.v), 6) AS s FROM gv, pv")
def deep_features(spark, sf_dir):
    prob = _prob(spark, sf_dir)
    return K.deep_features(prob, _pattern_vectors(prob)).withColumn("s", _r(F.col("s")))


@query(PROB_SQL + PATTERN_VECTOR_SQL + " SELECT graph_id, pattern, round(prob * sqrt(list_dot_product(v, v)), 6) AS s FROM prob JOIN pv USING (pattern)")
def l2_features(spark, sf_dir):
    prob = _prob(spark, sf_dir)
    return K.norm_weighted(prob, _pattern_vectors(prob)).withColumn("s", _r(F.col("s")))


@query(PROB_SQL + PATTERN_VECTOR_SQL + " SELECT a.graph_id AS g1, b.graph_id AS g2, round(sum(a.prob * b.prob * sqrt(list_dot_product(v, v))), 6) AS k FROM prob a JOIN prob b ON a.pattern = b.pattern AND a.graph_id <= b.graph_id JOIN pv ON pv.pattern = a.pattern GROUP BY ALL")
def l2_kernel(spark, sf_dir):
    prob = _prob(spark, sf_dir)
    return K.norm_kernel(prob, _pattern_vectors(prob)).withColumn("k", _r(F.col("k")))


@query("SELECT a.vec_id AS g1, b.vec_id AS g2, round(list_dot_product(cast(a.embedding AS double[]), cast(b.embedding AS double[])), 4) + 0.0::double AS k FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id")
def embedding_gram(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return K.gram(rows, "vec_id").withColumn("k", _r(F.col("k"), 4) + F.lit(0.0))


# ---- evaluation ----

PREDICTED_SQL = "p AS (SELECT cast(label AS integer) AS label, cast(CASE WHEN vec_id % 4 = 0 THEN (label + vec_id) % 10 ELSE label END AS integer) AS prediction FROM embeddings)"


def _predictions(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("int").alias("label"), F.when(F.col("vec_id") % 4 == 0, (F.col("label") + F.col("vec_id")) % 10).otherwise(F.col("label")).cast("int").alias("prediction"))


@query(f"WITH {PREDICTED_SQL} SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, sf_dir):
    return E.confusion(_predictions(spark, sf_dir))


@query(f"WITH {PREDICTED_SQL} SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM p")
def accuracy(spark, sf_dir):
    return E.accuracy(_predictions(spark, sf_dir))


@query(
    f"""WITH {PREDICTED_SQL}, c AS (SELECT label AS k, count(*) AS support, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS tp FROM p GROUP BY 1),
q AS (SELECT prediction AS k, count(*) AS predicted FROM p GROUP BY 1),
m AS (SELECT k, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS a, tp / support AS b FROM c LEFT JOIN q USING (k))
SELECT k AS label, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0.0 END, 6) AS f1, support FROM m"""
)
def precision_recall_f1(spark, sf_dir):
    return E.class_metrics(_predictions(spark, sf_dir)).select("label", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_with(G1_SQL) + f", r AS (SELECT graph_id, row_number() OVER (ORDER BY {uniform_sql(SEED, 'graph_id')}, graph_id) - 1 AS n, count(*) OVER () AS t FROM g1_graphs) SELECT graph_id, n < ceil(t * 0.1::double) AS is_test FROM r")
def train_test_split(spark, sf_dir):
    return E.train_test_split(customer_suppliers(spark, sf_dir).graphs.select("graph_id"), seed=SEED)


@query("SELECT o_orderpriority AS setting, round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS std, count(*) AS runs FROM orders GROUP BY 1")
def results_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("setting"), F.col("o_totalprice").alias("accuracy"))
    return E.mean_std(rows, ["setting"]).select("setting", _r(F.col("mean"), 2).alias("mean"), _r(F.col("std"), 2).alias("std"), "runs")


@query("SELECT l AS length, d AS dim, b AS batch, w AS window, r AS run FROM (SELECT 10 AS l), (SELECT 128 AS d), (SELECT unnest([100, 500, 1000, 5000, 10000]) AS b), (SELECT unnest([4, 8, 16]) AS w), (SELECT unnest(range(10)) AS r)")
def sweep_grid(spark, sf_dir):
    return sweeps.work(spark, "awe_dd")


# ---- training and classification (no SQL) ----


@query()
def graph2vec_train(spark, sf_dir):
    return P.graph2vec(_docs(spark, sf_dir), dim=16, epochs=5, seed=SEED).embeddings


@query()
def graph2vec_train_distributed(spark, sf_dir):
    from ..operators.trainer import Optimizer

    return P.graph2vec(_docs(spark, sf_dir), dim=8, epochs=2, seed=SEED, distributed=True, optimizer=Optimizer("adam", rate=0.1)).embeddings


@query()
def dgk_train(spark, sf_dir):
    return P.pattern_vectors(_docs(spark, sf_dir), window=WINDOW, dim=8, epochs=3, seed=SEED).embeddings


@query()
def cbow_train(spark, sf_dir):
    return P.pattern_vectors(_docs(spark, sf_dir), "cbow", window=WINDOW, dim=8, epochs=3, seed=SEED).embeddings


@query()
def awe_dd_train(spark, sf_dir):
    return P.awe_dd(user_events(spark, sf_dir), 4, "nodes", 5, window=WINDOW, dim=8, epochs=3, seed=SEED).embeddings


@query()
def svm_rbf_cv(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"), F.col("embedding").alias("vector"))
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"), F.col("label").alias("class_label"))
    x, y = E.feature_matrix(rows, labels)
    return E.cross_validate(spark, x, y, "rbf", cv=4, folds=3, grid=[1.0, 10.0])


@query()
def svm_linear_cv(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("class_label"))
    parted = settle(E.train_test_split(rows, "vec_id", seed=SEED))
    return E.accuracy(E.linear_svm_mllib(parted.where("not is_test"), parted.where("is_test")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of customers' supplier graphs with the highest kernel, with their classes (a report of 100 rows)."""
    g = customer_suppliers(spark, sf_dir)
    kernel = P.mle_graph_kernel(g, "wl", max_h=DEPTH).where("g1 < g2")
    best = kernel.orderBy(F.col("k").desc(), "g1", "g2").limit(100)
    c1 = g.graphs.select(F.col("graph_id").alias("g1"), F.col("class_label").alias("class1"))
    c2 = g.graphs.select(F.col("graph_id").alias("g2"), F.col("class_label").alias("class2"))
    return best.join(c1, "g1", "left").join(c2, "g2", "left").select("g1", "g2", "class1", "class2", _r(F.col("k")).alias("k"))
