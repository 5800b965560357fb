"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LONG, INT, DOUBLE, STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

GRAPHS = _schema(graph_id=LONG, graph_name=STRING, class_label=INT)
NODES = _schema(graph_id=LONG, node_id=INT, label=STRING)
#: Undirected edges, src < dst; self-loops have src = dst.
EDGES = _schema(graph_id=LONG, src=INT, dst=INT, weight=DOUBLE)
#: One sentence of a graph document: its centre token first.
GRAPH_DOCS = _schema(graph_id=LONG, doc_kind=STRING, line_no=INT, tokens=T.ArrayType(STRING))
PATTERN_COUNTS = _schema(graph_id=LONG, pattern=STRING, cnt=LONG, prob=DOUBLE)
VOCAB = _schema(pattern=STRING, pattern_id=LONG, freq=LONG, discard=DOUBLE, neg_lo=LONG, neg_hi=LONG)
EMBEDDINGS = _schema(entity_id=LONG, name=STRING, vector=T.ArrayType(T.FloatType()))
CLASS_LABELS = _schema(graph_id=LONG, class_label=INT)
KERNEL = _schema(g1=LONG, g2=LONG, k=DOUBLE)
