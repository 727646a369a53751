"""Sums over neighbourhoods of many small graphs kept in one node and one edge table.

``nodes(graph_id, node_id, feat)`` and ``edges(graph_id, edge_id, src, dst, rev_id, feat)``; every edge has a reverse
edge with its own id. Features are one number per column; the operators take the column names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

GRAPH_NORM = 100.0


def _incoming(messages: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Sum of the messages arriving at each node; partial sums are formed before the shuffle."""
    return messages.groupBy("graph_id", F.col("dst").alias("node_id")).agg(*[F.sum(f"m_{f}").alias(f"a_{f}") for f in feats])


def by_graph(rows: DataFrame, graph_id: str = "graph_id") -> DataFrame:
    """Rows dealt by graph."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), graph_id)


def propagate(
    nodes: DataFrame, edges: DataFrame, feats: Sequence[str], depth: int = 3, mode: str = "edge", undirected: bool = False,
    largest_in_task: int = 1_000_000, dealt: bool = False, largest: int | None = None,
) -> DataFrame:
    """Node features after ``depth - 1`` rounds of message sums plus the final sum: ``(graph_id, node_id, feats)``.

    mode ``edge``: a message is its edge's start value plus all messages into its source except its own reverse.
    mode ``node``: a node's message is its start value plus its neighbours' messages and the connecting edges' features.
    If no graph has more than ``largest_in_task`` edges, a graph's edges stay together; the rows are the same either way.
    ``dealt``: nodes and edges were dealt by graph before, so that mode ``node`` need not move them again. ``largest``: no graph has more edges, if the caller
    knows; else they are counted.
    """
    if mode == "node":
        if depth < 1:
            raise ValueError("depth must be at least 1")
        if (_largest_graph(edges) if largest is None else largest) <= largest_in_task:
            return _nodes_by_graph(nodes, edges, feats, depth, dealt)
        return _propagate_nodes(nodes, edges, feats, depth)
    if mode != "edge":
        raise ValueError(f"unknown mode {mode!r}")
    sources = nodes.select("graph_id", F.col("node_id").alias("src"), *[F.col(f).alias(f"n_{f}") for f in feats])
    start = edges.join(sources, ["graph_id", "src"]).select(
        "graph_id", "edge_id", "src", "dst", "rev_id", *[(F.col(f"n_{f}") + F.col(f)).alias(f"s_{f}") for f in feats]
    )
    if (_largest_graph(edges) if largest is None else largest) <= largest_in_task:
        messages = _rounds_by_graph(start, feats, depth, undirected)
    else:
        messages = _rounds_by_node(start, feats, depth, undirected)
    return _with_incoming(nodes, _incoming(messages, feats), feats)


def _largest_graph(edges: DataFrame) -> int:
    return edges.groupBy("graph_id").count().agg(F.max("count").alias("n")).first()["n"] or 0


def _rounds_by_graph(start: DataFrame, feats: Sequence[str], depth: int, undirected: bool) -> DataFrame:
    """Rounds for graphs of bounded size: rows are dealt by graph once, and every later step is a window inside a graph.

    A row holds a message and that of its reverse edge, so the sum into its source is the sum of the reverse messages of all rows
    with that source, and no message is ever looked up.
    """
    pair = W.partitionBy("graph_id", F.least("edge_id", "rev_id")).orderBy("edge_id")
    other = {f: F.coalesce(F.lead(f"s_{f}").over(pair), F.lag(f"s_{f}").over(pair)) for f in feats}
    rows = by_graph(start).withColumns({f"t_{f}": other[f] for f in feats})
    rows = rows.withColumns({f"m_{f}": F.col(f"s_{f}") for f in feats} | {f"r_{f}": F.col(f"t_{f}") for f in feats})
    into_source, into_target = W.partitionBy("graph_id", "src"), W.partitionBy("graph_id", "dst")
    for _ in range(depth - 1):
        if undirected:
            half = {f: (F.col(f"m_{f}") + F.col(f"r_{f}")) / 2 for f in feats}
            rows = rows.withColumns({f"m_{f}": half[f] for f in feats}).withColumns({f"r_{f}": F.col(f"m_{f}") for f in feats})
        rows = rows.withColumns(
            {f"a_{f}": F.sum(f"r_{f}").over(into_source) for f in feats} | {f"b_{f}": F.sum(f"m_{f}").over(into_target) for f in feats}
        )
        rows = rows.withColumns(
            {f"m_{f}": F.col(f"s_{f}") + F.col(f"a_{f}") - F.col(f"r_{f}") for f in feats}
            | {f"r_{f}": F.col(f"t_{f}") + F.col(f"b_{f}") - F.col(f"m_{f}") for f in feats}
        )
    return rows


def _rounds_by_node(start: DataFrame, feats: Sequence[str], depth: int, undirected: bool) -> DataFrame:
    """Rounds for graphs of any size: sums by node that combine before their shuffle, joined back to the edges."""
    # Read three times per round: as message, as reverse and in the sums.
    messages = cut(start.withColumns({f"m_{f}": F.col(f"s_{f}") for f in feats}))
    for _ in range(depth - 1):
        reverse = messages.select("graph_id", F.col("rev_id").alias("edge_id"), *[F.col(f"m_{f}").alias(f"r_{f}") for f in feats])
        paired = messages.join(reverse, ["graph_id", "edge_id"])
        if undirected:
            half = {f: (F.col(f"m_{f}") + F.col(f"r_{f}")) / 2 for f in feats}
            paired = paired.withColumns({f"m_{f}": half[f] for f in feats}).withColumns(
                {f"r_{f}": F.col(f"m_{f}") for f in feats}
            )
        sums = _incoming(paired if undirected else messages, feats).withColumnRenamed("node_id", "src")
        messages = cut(
            paired.join(sums, ["graph_id", "src"], "left").select(
                "graph_id", "edge_id", "src", "dst", "rev_id", *[f"s_{f}" for f in feats],
                *[
                    (F.col(f"s_{f}") + F.coalesce(F.col(f"a_{f}"), F.lit(0.0)) - F.col(f"r_{f}")).alias(f"m_{f}")
                    for f in feats
                ],
            )
        )
    return messages


#: Rows of ``_nodes_by_graph``: a node, an edge at its source, a message at its target.
NODE, EDGE, MESSAGE = 0, 1, 2


def _nodes_by_graph(nodes: DataFrame, edges: DataFrame, feats: Sequence[str], depth: int, dealt: bool) -> DataFrame:
    """Rounds of mode ``node`` for graphs of bounded size: nodes, edges and messages are rows of one table dealt by graph, and a round is a window over the rows
    that meet at a node. A node that is there several times sends once for each, as a join does; a null key meets nothing."""
    found = nodes.select("graph_id", F.col("node_id").alias("at"), F.lit(NODE).alias("kind"), *[F.col(f).alias(f"n_{f}") for f in feats])
    leaving = edges.select("graph_id", F.col("src").alias("at"), F.lit(EDGE).alias("kind"), "dst", *[F.col(f).alias(f"e_{f}") for f in feats])
    rows = found.unionByName(leaving, allowMissingColumns=True)
    rows = rows if dealt else by_graph(rows)
    here = W.partitionBy("graph_id", "at")
    keys = F.col("graph_id").isNotNull() & F.col("at").isNotNull() & F.col("dst").isNotNull()
    arrived = None
    for last in [False] * (depth - 1) + [True]:
        sent = {}
        for f in feats:
            copies, value = F.count(f"n_{f}").over(here), F.sum(f"n_{f}").over(here)
            if arrived:
                value = value + copies * arrived[f]
            sent[f"s_{f}"] = F.when(keys, value if last else value + copies * F.col(f"e_{f}"))
        rows = rows.withColumns(sent).filter(F.col("kind") != MESSAGE)
        if last:
            rows = rows.withColumn("as", F.when(F.col("kind") == EDGE, MESSAGE).otherwise(NODE))
        else:
            ways = F.when(F.col("kind") == EDGE, F.array(F.lit(EDGE), F.lit(MESSAGE))).otherwise(F.array(F.lit(NODE)))
            rows = rows.withColumn("as", F.explode(ways))
        message = F.col("as") == MESSAGE
        rows = rows.select(
            "graph_id", F.when(message, F.col("dst")).otherwise(F.col("at")).alias("at"), F.col("as").alias("kind"), "dst",
            *[F.col(f"{kind}_{f}") for kind in "ne" for f in feats], *[F.when(message, F.col(f"s_{f}")).alias(f"a_{f}") for f in feats],
        )
        arrived = {f: F.coalesce(F.sum(f"a_{f}").over(here), F.lit(0.0)) for f in feats}
    final = rows.withColumns({f"t_{f}": arrived[f] for f in feats}).filter(F.col("kind") == NODE)
    return final.select("graph_id", F.col("at").alias("node_id"), *[(F.col(f"n_{f}") + F.col(f"t_{f}")).alias(f) for f in feats])


def _propagate_nodes(nodes: DataFrame, edges: DataFrame, feats: Sequence[str], depth: int) -> DataFrame:
    state = nodes.select("graph_id", "node_id", *[F.col(f).alias(f"m_{f}") for f in feats])
    for last in [False] * (depth - 1) + [True]:
        sent = state.withColumnRenamed("node_id", "src")
        along = edges.join(sent, ["graph_id", "src"]).select(
            "graph_id", "dst", *[(F.col(f"m_{f}") if last else F.col(f"m_{f}") + F.col(f)).alias(f"m_{f}") for f in feats]
        )
        result = _with_incoming(nodes, _incoming(along, feats), feats)
        if last:
            return result
        state = cut(result.select("graph_id", "node_id", *[F.col(f).alias(f"m_{f}") for f in feats]))
    raise ValueError("depth must be at least 1")


def _with_incoming(nodes: DataFrame, sums: DataFrame, feats: Sequence[str]) -> DataFrame:
    return nodes.join(sums, ["graph_id", "node_id"], "left").select(
        "graph_id", "node_id", *[(F.col(f) + F.coalesce(F.col(f"a_{f}"), F.lit(0.0))).alias(f) for f in feats]
    )


def read_out(graphs: DataFrame, nodes: DataFrame, feats: Sequence[str], how: str | Sequence[str] = "mean") -> DataFrame:
    """One row per graph: mean, sum or sum over a fixed norm of its nodes; zeros for a graph without nodes. With several ways the nodes
    are read once, and a column is named ``feat_way``."""
    value = {
        "mean": lambda f: F.avg(f),
        "sum": lambda f: F.sum(f),
        "norm": lambda f: F.sum(f) / F.lit(GRAPH_NORM),
    }
    ways = {f: value[how](f) for f in feats} if isinstance(how, str) else {f"{f}_{h}": value[h](f) for h in how for f in feats}
    per_graph = nodes.groupBy("graph_id").agg(*[v.alias(name) for name, v in ways.items()])
    return graphs.select("graph_id").join(per_graph, "graph_id", "left").na.fill(0.0, list(ways))
