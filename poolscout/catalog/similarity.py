"""Fingerprints, leaders and graph sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..operators import graph, similarity
from ..operators.density import density_clusters
from ..operators.neighbours import distinct_sets, neighbour_pairs as pairs_within
from ..session import spread_few_splits
from .registry import query, r6

LENGTH = 2048
P = fp.HASH_MODULUS
M = fp.HASH_FACTOR

TOKENS_SQL = """
docs AS (SELECT doc_id AS id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS toks FROM documents),
tokens AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM docs),
hashes AS (SELECT id, pos, CAST(concat('0x', substr(md5(tok), 1, 7)) AS BIGINT) AS h,
           CAST(coalesce(lag(CAST(concat('0x', substr(md5(tok), 1, 7)) AS BIGINT), 1) OVER w, -1) AS BIGINT) AS l1,
           CAST(coalesce(lag(CAST(concat('0x', substr(md5(tok), 1, 7)) AS BIGINT), 2) OVER w, -1) AS BIGINT) AS l2,
           CAST(coalesce(lead(CAST(concat('0x', substr(md5(tok), 1, 7)) AS BIGINT), 1) OVER w, -1) AS BIGINT) AS n1,
           CAST(coalesce(lead(CAST(concat('0x', substr(md5(tok), 1, 7)) AS BIGINT), 2) OVER w, -1) AS BIGINT) AS n2,
           CAST(coalesce(lead(CAST(concat('0x', substr(md5(tok), 1, 7)) AS BIGINT), 3) OVER w, -1) AS BIGINT) AS n3
           FROM tokens WINDOW w AS (PARTITION BY id ORDER BY pos))
"""


def _mix_sql(a: str, b: str) -> str:
    return f"(({a}) * {M} + ({b})) % {P}"


def _z(x: str) -> str:
    return f"greatest({x}, 0)"


_R1 = _mix_sql(_mix_sql("h", _z("l1")), _z("n1"))
SHINGLES_SQL = {
    "morgan": f"SELECT id, h AS s FROM hashes UNION ALL SELECT id, {_R1} FROM hashes "
    f"UNION ALL SELECT id, {_mix_sql(_mix_sql(_R1, _z('l2')), _z('n2'))} FROM hashes",
    "pair": " UNION ALL ".join(
        f"SELECT id, {_mix_sql(_mix_sql('h', f'n{d}'), str(d))} AS s FROM hashes WHERE n{d} >= 0" for d in (1, 2, 3)
    ),
    "rdkit": f"SELECT id, h AS s FROM hashes UNION ALL SELECT id, {_mix_sql('h', 'n1')} FROM hashes WHERE n1 >= 0 "
    f"UNION ALL SELECT id, {_mix_sql(_mix_sql('h', 'n1'), 'n2')} FROM hashes WHERE n2 >= 0",
}


def _fingerprint_sql(kind: str) -> str:
    return (
        f"WITH {TOKENS_SQL}, bits AS (SELECT DISTINCT id, s % {LENGTH} AS bit FROM ({SHINGLES_SQL[kind]})) "
        "SELECT id, count(bit) AS n_bits, CAST(coalesce(sum(bit * bit), 0) AS BIGINT) AS checksum "
        "FROM (SELECT DISTINCT id FROM hashes) LEFT JOIN bits USING (id) GROUP BY id"
    )


def _texts(t):
    return spread_few_splits(t.documents.select(F.col("doc_id").alias("id"), "text")).filter(fp.has_tokens(F.col("text")))


def _bit_summary(t, kind: str):
    bits = _texts(t).select("id", fp.fingerprint(F.col("text"), kind, 2, LENGTH).alias("bits"))
    square = F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b.cast("long") * b)
    return bits.select("id", F.size("bits").cast("long").alias("n_bits"), square.alias("checksum"))


@query("X1 X6", _fingerprint_sql("morgan"))
def fingerprint_morgan(t):
    """Context windows of radius 0 to 2 around every token of the whole text."""
    return _bit_summary(t, "morgan")


@query("X2 X6", _fingerprint_sql("pair"))
def fingerprint_pair(t):
    """Token pairs 1 to 3 apart."""
    return _bit_summary(t, "pair")


@query("X3 X6", _fingerprint_sql("rdkit"))
def fingerprint_path(t):
    """Runs of 1 to 3 tokens."""
    return _bit_summary(t, "rdkit")


# Patterns of the key fingerprint over words.
KEYS = ("the", "and", "[0-9]", "@", "http", "[A-Z]{2}", "er ", " th", "ing", "[.] [A-Z]", "\\n", "license")


@query(
    "X4",
    "SELECT doc_id AS id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{k}') THEN '{i}' END" for i, k in enumerate(KEYS)) + ") AS bits FROM documents",
)
def fingerprint_keys(t):
    bits = fp.fingerprint(F.col("text"), "maccs", keys=KEYS)
    return t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(",", bits.cast("array<string>")).alias("bits"))


HASHES = 16


@query(
    "X5",
    f"WITH {TOKENS_SQL}, s AS (SELECT DISTINCT id, s FROM ({SHINGLES_SQL['morgan']})), "
    f"m AS (SELECT id, i, min((s * ((i * 48271) % {P}) + (i * 69621) % {P}) % {P}) AS v FROM s, range(1, {HASHES + 1}) r(i) GROUP BY 1, 2) "
    "SELECT id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS signature FROM m GROUP BY id",
)
def minhash_signatures(t):
    signature = fp.minhash_signature(F.col("text"), "morgan", 2, HASHES)
    rows = _texts(t).select("id", signature.alias("s"))
    return rows.select("id", F.concat_ws(",", F.col("s").cast("array<string>")).alias("signature"))


@query("X5")
def fingerprint_minhash(t):
    bits = fp.fingerprint(F.col("text"), "map4", 2, 64)
    rows = _texts(t).select("id", bits.alias("bits"))
    return rows.select("id", F.size("bits").alias("n_bits"), F.concat_ws(",", F.col("bits").cast("array<string>")).alias("bits"))


WORDS_SQL = (
    "items AS (SELECT p_partkey AS id, list_sort(list_distinct(list_transform(regexp_extract_all(concat(p_name, ' ', p_type, ' ', p_brand), '[^ ]+'), "
    f"lambda x: CAST(concat('0x', substr(md5(x), 1, 7)) AS BIGINT) % {LENGTH}))) AS bits FROM part)"
)
JACCARD_SQL = "(len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE))"


def _parts(t):
    words = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return t.part.select(F.col("p_partkey").alias("id"), fp.fingerprint(words, "rdkit", 0, LENGTH).alias("bits"))


@query(
    "X7",
    f"WITH {WORDS_SQL}, first AS (SELECT bits AS b FROM items ORDER BY id LIMIT 1) "
    f"SELECT id, round({JACCARD_SQL.format(a='bits', b='b')}, 6) AS similarity FROM items, first",
)
def similarity_to_first(t):
    first = _parts(t).agg(F.min_by("bits", "id").alias("b")).scalar()
    return _parts(t).withColumn("b", first).select("id", r6(fp.tanimoto(F.col("bits"), F.col("b"))).alias("similarity"))


FLOOR = 1.0 - 0.65
LEADERS_SQL = f"""
WITH RECURSIVE {WORDS_SQL},
reps AS (SELECT min(id) AS id, bits FROM items GROUP BY bits),
ordered AS (SELECT id, bits, row_number() OVER (ORDER BY id) AS rn FROM reps),
walk(rn, picks) AS (
    SELECT 1 :: BIGINT, [{{'id': id, 'bits': bits}}] FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.rn, CASE WHEN len(list_filter(picks, lambda p: {JACCARD_SQL.format(a='p.bits', b='o.bits')} >= {FLOOR!r} :: DOUBLE)) > 0
                      THEN picks ELSE list_append(picks, {{'id': o.id, 'bits': o.bits}}) END
    FROM walk w JOIN ordered o ON o.rn = w.rn + 1),
leaders AS (SELECT p.id AS id, p.bits AS bits FROM (SELECT unnest(picks) AS p FROM walk WHERE rn = (SELECT max(rn) FROM ordered)))
"""


def _leaders(t):
    return similarity.pick_leaders(_parts(t), LENGTH, 0.65)


@query("C3 J9", f"{LEADERS_SQL} SELECT id, len(bits) AS n_bits FROM leaders")
def leaders(t):
    return _leaders(t).select("id", F.size("bits").cast("long").alias("n_bits"))


ASSIGNED_SQL = f"""
assigned AS (SELECT i.id, CASE WHEN i.id IN (SELECT id FROM leaders) THEN i.id ELSE
             arg_max(l.id, struct_pack(s := {JACCARD_SQL.format(a='i.bits', b='l.bits')}, k := -l.id)) END AS leader,
             CASE WHEN i.id IN (SELECT id FROM leaders) THEN 1.0 ELSE max({JACCARD_SQL.format(a='i.bits', b='l.bits')}) END AS similarity
             FROM items i, leaders l GROUP BY i.id)
"""


@query("C4 J8", f"{LEADERS_SQL}, {ASSIGNED_SQL} SELECT id, leader, round(similarity, 6) AS similarity FROM assigned")
def leader_assignment(t):
    rows = similarity.assign_to_leaders(_parts(t), _leaders(t), LENGTH)
    return rows.select("id", "leader", r6("similarity").alias("similarity"))


@query(
    "J9",
    f"{LEADERS_SQL} SELECT l.id AS leader, i.id AS id, round({JACCARD_SQL.format(a='i.bits', b='l.bits')}, 6) AS similarity "
    f"FROM items i, leaders l WHERE {JACCARD_SQL.format(a='i.bits', b='l.bits')} >= {FLOOR!r} :: DOUBLE",
)
def leader_neighbours(t):
    """All (leader, item) pairs within the distance; two items that are no leaders are never paired."""
    rows = similarity.within_distance(_parts(t), _leaders(t), LENGTH, 0.65)
    return rows.select("leader", "id", r6("similarity").alias("similarity"))


@query(
    "C5 F19 A4",
    f"{LEADERS_SQL}, {ASSIGNED_SQL}, sizes AS (SELECT leader, count(*) AS n FROM assigned GROUP BY 1) "
    "SELECT id, CASE WHEN n = 1 THEN 'singleton' WHEN n = (SELECT max(n) FROM sizes) THEN 'large' ELSE 'mid' END AS class FROM assigned JOIN sizes USING (leader)",
)
def leader_cluster_classes(t):
    return similarity.cluster_classes(similarity.assign_to_leaders(_parts(t), _leaders(t), LENGTH))


# --- neighbours among all items ---------------------------------------------------------------------------------------

NEAR, NEAR_ITEMS = 0.5, 6
#: Shared bits of all pairs of distinct sets, counted by a join on the bit.
PAIRS_SQL = """
sets AS (SELECT min(id) AS id, bits, count(*) AS members FROM items GROUP BY bits),
posted AS (SELECT id, len(bits) AS n, unnest(bits) AS bit FROM sets),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS similarity
          FROM posted x JOIN posted y ON x.bit = y.bit AND x.id < y.id GROUP BY x.id, y.id HAVING similarity >= {floor!r} :: DOUBLE)
"""
DOCUMENT_SETS_SQL = (
    "items AS (SELECT doc_id AS id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[^ \\t\\n\\r]+'), "
    f"lambda x: CAST(concat('0x', substr(md5(x), 1, 7)) AS BIGINT) % {LENGTH}))) AS bits FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]'))"
)


def _document_sets(t):
    return _texts(t).select("id", fp.fingerprint(F.col("text"), "rdkit", 0, LENGTH).alias("bits"))


@query("J9", f"WITH {WORDS_SQL}, {PAIRS_SQL.format(floor=1 - NEAR)} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def neighbour_pairs(t):
    """All pairs of different word sets of parts within the distance."""
    found = pairs_within(distinct_sets(_parts(t)), LENGTH, NEAR)
    return found.select("a", "b", r6("similarity").alias("similarity"))


@query("J9", f"WITH {DOCUMENT_SETS_SQL}, {PAIRS_SQL.format(floor=1 - 0.4)} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def document_neighbour_pairs(t):
    """All pairs of different word sets of whole documents; common words are in a third of them and more."""
    found = pairs_within(distinct_sets(_document_sets(t)), LENGTH, 0.4)
    return found.select("a", "b", r6("similarity").alias("similarity"))


def _density_sql(items: str, floor: float, least: int) -> str:
    return f"""
    WITH RECURSIVE {items}, {PAIRS_SQL.format(floor=floor)},
    around AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    near AS (SELECT a, sum(members) AS n FROM around JOIN sets ON sets.id = b GROUP BY a),
    counted AS (SELECT id, len(bits) > 0 AND members + coalesce(n, 0) >= {least} AS core FROM sets LEFT JOIN near ON a = id),
    links AS (SELECT a, b FROM around JOIN counted x ON x.id = a AND x.core JOIN counted y ON y.id = b AND y.core),
    reach(id, other) AS (SELECT id, id FROM counted WHERE core UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
    named AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id),
    border AS (SELECT a AS id, arg_min(cluster_id, b) AS cluster_id FROM around JOIN named ON named.id = b GROUP BY a)
    SELECT items.id, coalesce(named.cluster_id, border.cluster_id) AS cluster_id, core FROM items JOIN sets USING (bits) JOIN counted ON counted.id = sets.id
    LEFT JOIN named ON named.id = sets.id LEFT JOIN border ON border.id = sets.id
    """


@query("C2", _density_sql(WORDS_SQL, 1 - NEAR, NEAR_ITEMS))
def density_clusters_of_parts(t):
    return density_clusters(_parts(t), LENGTH, NEAR, NEAR_ITEMS)


@query("C2", _density_sql(DOCUMENT_SETS_SQL, 1 - 0.4, 3))
def density_clusters_of_documents(t):
    """Near copies gather in clusters; most documents are noise."""
    return density_clusters(_document_sets(t), LENGTH, 0.4, 3)


@query("C3", f"{LEADERS_SQL} SELECT id, len(bits) AS n_bits FROM leaders")
def leaders_by_rounds(t):
    """The same leaders as in id order, decided in rounds on the graph of neighbours."""
    found = similarity.pick_leaders(_parts(t), LENGTH, 0.65, method="rounds")
    return found.select("id", F.size("bits").cast("long").alias("n_bits"))


# --- graphs: one per order, a node for the order and one per part it lists ---------------------------------------------


def _graph(t):
    lines = graph.by_graph(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    order = lines.select("l_orderkey").distinct()
    node = F.concat(F.lit("p"), "l_partkey")
    nodes = lines.select(F.col("l_orderkey").alias("graph_id"), node.alias("node_id"), F.col("q").alias("feat")).unionByName(
        order.select(F.col("l_orderkey").alias("graph_id"), F.lit("order").alias("node_id"), F.lit(1.0).alias("feat"))
    )
    out, back = F.concat(F.lit("o"), "l_partkey"), F.concat(F.lit("b"), "l_partkey")
    to, fro = ((out, F.lit("order"), node, back), (back, node, F.lit("order"), out))
    names = ("edge_id", "src", "dst", "rev_id")
    both = F.explode(F.array(*[F.struct(*[c.alias(k) for c, k in zip(way, names)]) for way in (to, fro)]))
    # both ways from one row, so that lines are added up once
    edges = lines.select(F.col("l_orderkey").alias("graph_id"), both.alias("e"), (F.col("q") / 10).alias("feat"))
    edges = edges.select("graph_id", *[f"e.{k}" for k in names], "feat")
    return nodes, edges


GRAPH_SQL = """
lines AS (SELECT l_orderkey AS g, l_partkey AS p, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
nodes AS (SELECT g, concat('p', p) AS v, q AS f FROM lines UNION ALL SELECT DISTINCT g, 'order', 1.0 FROM lines),
edges AS (SELECT g, concat('o', p) AS e, 'order' AS src, concat('p', p) AS dst, concat('b', p) AS r, q / 10 AS f FROM lines
          UNION ALL SELECT g, concat('b', p), concat('p', p), 'order', concat('o', p), q / 10 FROM lines)
"""


def _edge_mode_sql(undirected: bool) -> str:
    text = f"WITH {GRAPH_SQL}, m0 AS (SELECT e.g, e.e, src, dst, r, n.f + e.f AS s, n.f + e.f AS m FROM edges e JOIN nodes n ON n.g = e.g AND n.v = e.src)"
    last = "m0"
    for i in (1, 2):
        m, back = ("(a.m + b.m) / 2", "(a.m + b.m) / 2") if undirected else ("a.m", "b.m")
        text += (
            f", p{i} AS (SELECT a.*, {m} AS x, {back} AS y FROM {last} a JOIN {last} b ON a.g = b.g AND a.r = b.e)"
            f", i{i} AS (SELECT g, dst AS v, sum(x) AS t FROM p{i} GROUP BY 1, 2)"
            f", m{i} AS (SELECT p.g, p.e, p.src, p.dst, p.r, p.s, p.s + coalesce(t, 0) - y AS m FROM p{i} p LEFT JOIN i{i} ON i{i}.g = p.g AND i{i}.v = p.src)"
        )
        last = f"m{i}"
    return text + f", final AS (SELECT n.g, n.v, n.f + coalesce(sum(m), 0) AS f FROM nodes n LEFT JOIN {last} ON {last}.g = n.g AND dst = v GROUP BY n.g, n.v, n.f)"


@query(
    "X8",
    _edge_mode_sql(False) + " SELECT g AS graph_id, v AS node_id, round(f, 4) AS feat FROM final",
)
def graph_edge_messages(t):
    nodes, edges = _graph(t)
    return graph.propagate(nodes, edges, ["feat"]).select("graph_id", "node_id", F.round("feat", 4).alias("feat"))


@query(
    "X8",
    _edge_mode_sql(True) + " SELECT g AS graph_id, round(avg(f), 4) AS mean, round(sum(f), 4) AS sum, round(sum(f) / 100, 4) AS norm FROM final GROUP BY 1",
)
def graph_read_out(t):
    nodes, edges = _graph(t)
    final = graph.propagate(nodes, edges, ["feat"], undirected=True)
    graphs, ways = nodes.select("graph_id").where("graph_id IS NOT NULL").distinct(), ("mean", "sum", "norm")
    result = graph.read_out(graphs, final, ["feat"], ways)
    return result.select("graph_id", *[F.round(f"feat_{how}", 4).alias(how) for how in ways])


@query(
    "X8",
    f"WITH {GRAPH_SQL}, "
    "i1 AS (SELECT e.g, e.dst AS v, sum(k.f + e.f) AS t FROM edges e JOIN nodes k ON k.g = e.g AND k.v = e.src GROUP BY 1, 2), "
    "s1 AS (SELECT n.g, n.v, n.f, n.f + coalesce(t, 0) AS m FROM nodes n LEFT JOIN i1 ON i1.g = n.g AND i1.v = n.v), "
    "i2 AS (SELECT e.g, e.dst AS v, sum(k.m) AS t FROM edges e JOIN s1 k ON k.g = e.g AND k.v = e.src GROUP BY 1, 2), "
    "s2 AS (SELECT n.g, n.v, n.f + coalesce(t, 0) AS m FROM nodes n LEFT JOIN i2 ON i2.g = n.g AND i2.v = n.v) "
    "SELECT g AS graph_id, v AS node_id, round(m, 4) AS feat FROM s2",
)
def graph_node_messages(t):
    nodes, edges = _graph(t)
    # two edges for each part of an order, so at most two for each of its lines
    lines = t.lineitem.groupBy("l_orderkey").count().agg(F.max("count").alias("n")).first()["n"] or 0
    rows = graph.propagate(nodes, edges, ["feat"], depth=2, mode="node", dealt=True, largest=2 * lines)
    return rows.select("graph_id", "node_id", F.round("feat", 4).alias("feat"))
