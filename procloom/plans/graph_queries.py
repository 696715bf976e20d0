"""Queries on process graphs, hierarchies and the rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procloom.operators import graph, render, rules
from procloom.plans import derived as D
from procloom.plans import models as M
from procloom.plans.registry import Registry, table
from procloom.sources import diagrams

R = Registry()

_EDGES = """steps AS (SELECT user_id::VARCHAR AS g, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
    edges AS (SELECT DISTINCT g, src, dst FROM steps WHERE dst IS NOT NULL), nodes AS (SELECT DISTINCT user_id::VARCHAR AS g, event_type AS node FROM events)"""


def event_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each user: event types, and which follows which."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("g"), "event_type", "ts", "event_id")
    nxt = F.lead("event_type").over(Window.partitionBy("g").orderBy("ts", "event_id"))
    edges = events.select("g", F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").distinct()
    return events.select("g", F.col("event_type").alias("node")).distinct(), edges


@R.add(f"WITH {_EDGES} SELECT g, node FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.g = nodes.g AND (e.src = node OR e.dst = node))")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return graph.isolated(*event_graphs(spark, sf_dir))


@R.add(f"""
    WITH {_EDGES}, d AS (SELECT g, node, (SELECT count(*) FROM edges e WHERE e.g = n.g AND e.dst = n.node) AS n_in, (SELECT count(*) FROM edges e WHERE e.g = n.g AND e.src = n.node) AS n_out FROM nodes n)
    SELECT *, CASE WHEN n_in > 1 AND n_out > 1 THEN 'BOTH' WHEN n_out > 1 THEN 'SPLIT' WHEN n_in > 1 THEN 'JOIN' ELSE 'PLAIN' END AS role FROM d""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return graph.degrees(*event_graphs(spark, sf_dir))


@R.add("SELECT 'tpch' AS g, o_orderkey AS edge, 'source' AS side, o_custkey::VARCHAR AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'tpch', o_orderkey, 'target', o_orderpriority FROM orders UNION ALL SELECT * FROM (VALUES ('tpch', -1, 'source', 'ghost'), ('tpch', -1, 'target', 'nowhere'), ('tpch', -2, 'target', 'nowhere'))")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges from customers, which are nodes, to priorities, which aren't; two more lead from an unknown and from a known customer."""
    orders = table(spark, sf_dir, "orders").select(F.lit("tpch").alias("g"), F.col("o_orderkey").alias("edge"), F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"))
    more = spark.createDataFrame([("tpch", -1, "ghost", "nowhere"), ("tpch", -2, "1", "nowhere")], "g string, edge long, src string, dst string")
    nodes = table(spark, sf_dir, "customer").select(F.lit("tpch").alias("g"), F.col("c_custkey").cast("string").alias("node"))
    return graph.dangling(orders.unionByName(more), nodes)


@R.add()
def back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 over the graphs of all users. A depth-first search has no SQL; the tests hold it against a recursive one."""
    nodes, edges = event_graphs(spark, sf_dir)
    return graph.back_edges(nodes.withColumn("pos", F.dense_rank().over(_by("node"))), edges.withColumn("pos", F.dense_rank().over(_by("src", "dst"))))


def _by(*columns: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("g").orderBy(*columns)


_FORWARD = "fwd AS (SELECT * FROM edges WHERE src < dst)"


@R.add(f"""
    WITH RECURSIVE {_EDGES}, {_FORWARD}, r(g, node, rank) AS (
        SELECT g, node, 0 FROM nodes WHERE NOT EXISTS (SELECT 1 FROM fwd WHERE fwd.g = nodes.g AND fwd.dst = nodes.node)
        UNION ALL SELECT f.g, f.dst, r.rank + 1 FROM r JOIN fwd f ON f.g = r.g AND f.src = r.node)
    SELECT g, node, max(rank) AS rank FROM r GROUP BY g, node""")
def topological_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest paths in each user's graph, over edges in the order of names."""
    nodes, edges = event_graphs(spark, sf_dir)
    return graph.ranks(nodes, edges.where("src < dst"))


@R.add(f"""
    WITH RECURSIVE {_EDGES}, walk(g, start, node, path) AS (
        SELECT g, src, dst, [src] FROM edges UNION ALL
        SELECT e.g, w.start, e.dst, list_append(w.path, e.src) FROM walk w JOIN edges e ON e.g = w.g AND e.src = w.node WHERE NOT list_contains(w.path, w.node))
    SELECT DISTINCT g, node FROM walk WHERE node = start""")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types on a cycle of their user's graph."""
    return graph.on_cycle(event_graphs(spark, sf_dir)[1])


_TREE = """tree AS (SELECT 'r' || r_regionkey AS node, 'REGION' AS type, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'NATION', 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'CUSTOMER', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'CUSTOMER', 'r' || (s_nationkey % 5) FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'ORDER', 'c' || o_custkey FROM orders
    UNION ALL SELECT * FROM (VALUES ('x1', 'ORDER', 'c-1'), ('x2', 'CUSTOMER', 'n-7'), ('x3', 'NATION', NULL), ('x4', 'ORDER', 'x2')))"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as a hierarchy; suppliers skip a level, and a few more nodes lack their parents."""
    part = lambda name, key, kind, parent: table(spark, sf_dir, name).select(F.concat(F.lit(name[0]), F.col(key).cast("string")).alias("node"), F.lit(kind).alias("type"), parent.alias("parent_id"))
    to = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    customers = part("customer", "c_custkey", "CUSTOMER", to("n", "c_nationkey"))
    lost = spark.createDataFrame([("x1", "ORDER", "c-1"), ("x2", "CUSTOMER", "n-7"), ("x3", "NATION", None), ("x4", "ORDER", "x2")], "node string, type string, parent_id string")
    suppliers = part("supplier", "s_suppkey", "CUSTOMER", F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")))
    return part("region", "r_regionkey", "REGION", F.lit(None).cast("string")).unionByName(part("nation", "n_nationkey", "NATION", to("r", "n_regionkey"))).unionByName(customers).unionByName(suppliers).unionByName(part("orders", "o_orderkey", "ORDER", to("c", "o_custkey"))).unionByName(lost)


@R.add(f"WITH {_TREE} SELECT node, type, parent_id FROM tree t WHERE type <> 'REGION' AND (parent_id IS NULL OR parent_id NOT IN (SELECT node FROM tree))")
def hierarchy_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return graph.orphans(tree(spark, sf_dir), "REGION")


@R.add(f"WITH {_TREE} SELECT parent_id, count(*) AS children, CASE WHEN count(*) > 20 THEN 'BLOCKER' WHEN count(*) > 10 THEN 'MAJOR' ELSE 'OK' END AS severity FROM tree WHERE parent_id IS NOT NULL GROUP BY parent_id")
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return graph.fanout(tree(spark, sf_dir))


@R.add(f"WITH {_TREE}, l AS (SELECT *, list_position(['REGION', 'NATION', 'CUSTOMER', 'ORDER'], type) AS k FROM tree) SELECT a.node, a.type, b.type AS parent_type FROM l a JOIN l b ON b.node = a.parent_id WHERE a.k <> b.k + 1")
def level_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return graph.level_jumps(tree(spark, sf_dir), ["REGION", "NATION", "CUSTOMER", "ORDER"])


@R.add(f"WITH {_TREE} SELECT node, type FROM tree WHERE node NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)")
def hierarchy_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return graph.leaves(tree(spark, sf_dir))


def ranked_nodes(spark: SparkSession) -> DataFrame:
    return M.NODES.df(spark).where("g = 'd1'").select("g", "node", "node_type", "lane", (F.col("pos") % 5).alias("rank"), "pos")


_LAYOUT = f"""n AS (SELECT g, node, node_type, lane, pos % 5 AS rank, pos, CASE WHEN contains(node_type, 'GATEWAY') THEN 50 WHEN regexp_matches(node_type, 'EVENT|CATCH|THROW') THEN 36 ELSE 120 END AS width,
        CASE WHEN contains(node_type, 'GATEWAY') THEN 50 WHEN regexp_matches(node_type, 'EVENT|CATCH|THROW') THEN 36 ELSE 80 END AS height FROM {M.NODES.sql} WHERE g = 'd1'),
    s AS (SELECT *, sum(height) OVER k + (count(*) OVER k - 1) * 10 AS total, coalesce(sum(height + 10) OVER (PARTITION BY g, lane, rank ORDER BY pos, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM n WINDOW k AS (PARTITION BY g, lane, rank)),
    h AS (SELECT l.g, l.lane, l.pos, greatest(coalesce((SELECT max(total) FROM s WHERE s.g = l.g AND s.lane = l.lane), 0) + 60, 150) AS lane_height FROM {M.LANES.sql} l WHERE l.g = 'd1'),
    t AS (SELECT *, coalesce(sum(lane_height) OVER (PARTITION BY g ORDER BY pos, lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lane_y FROM h),
    places AS (SELECT s.g, s.node, (260 + s.rank * 200 + (120 - width) / 2)::DOUBLE AS x, (lane_y + (lane_height - total) / 2 + above)::DOUBLE AS y, width, height FROM s JOIN t ON t.g = s.g AND t.lane = s.lane)"""


@R.add(f"WITH {_LAYOUT} SELECT * FROM places")
def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, W5, W6, C23."""
    return graph.layout(ranked_nodes(spark), M.LANES.df(spark).where("g = 'd1'")).withColumns({c: F.col(c).cast("double") for c in "xy"})


@R.add(f"""
    WITH {_LAYOUT}, low AS (SELECT g, max(y + height) + 40 AS low FROM places GROUP BY g),
    e AS (SELECT f.g, f.edge, f.edge = 'e9' AS back, a.x + a.width AS sx, a.y + a.height / 2 AS sy, b.x AS dx, b.y + b.height / 2 AS dy, low FROM {M.FLOWS.sql} f JOIN places a ON a.g = f.g AND a.node = f.src JOIN places b ON b.g = f.g AND b.node = f.dst JOIN low ON low.g = f.g)
    SELECT g, edge, CASE WHEN back THEN 6 ELSE 4 END AS n_points, CASE WHEN back THEN [{{'x': sx, 'y': sy}}, {{'x': sx + 20, 'y': sy}}, {{'x': sx + 20, 'y': low}}, {{'x': dx - 20, 'y': low}}, {{'x': dx - 20, 'y': dy}}, {{'x': dx, 'y': dy}}]
        ELSE [{{'x': sx, 'y': sy}}, {{'x': (sx + dx) / 2, 'y': sy}}, {{'x': (sx + dx) / 2, 'y': dy}}, {{'x': dx, 'y': dy}}] END AS points FROM e""")
def edge_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    places = graph.layout(ranked_nodes(spark), M.LANES.df(spark).where("g = 'd1'"))
    return graph.routes(places, M.FLOWS.df(spark).withColumn("back", F.col("edge") == "e9"))


@R.add(f"""
    WITH s AS (SELECT g, flow, src, dst, len(points) AS n, unnest(range(1, len(points))) AS k, points FROM {M.WAYPOINTS.sql}),
    t AS (SELECT *, points[k].x AS ax, points[k].y AS ay, points[k + 1].x AS bx, points[k + 1].y AS by FROM s),
    p AS (SELECT a.g, a.flow AS fa, b.flow AS fb, a.n AS na, b.n AS nb, a.bx - a.ax AS rx, a.by - a.ay AS ry, b.bx - b.ax AS sx, b.by - b.ay AS sy, b.ax - a.ax AS ox, b.ay - a.ay AS oy FROM t a JOIN t b ON a.g = b.g AND a.flow < b.flow AND a.src <> b.src AND a.src <> b.dst AND a.dst <> b.src AND a.dst <> b.dst),
    h AS (SELECT *, (ox * sy - oy * sx) / nullif(rx * sy - ry * sx, 0) AS t, (ox * ry - oy * rx) / nullif(rx * sy - ry * sx, 0) AS u FROM p),
    f AS (SELECT DISTINCT g, CASE WHEN nb > na THEN fb ELSE fa END AS flow, CASE WHEN nb > na THEN fa ELSE fb END AS other FROM h WHERE t > 1e-9 AND t < 1 - 1e-9 AND u > 1e-9 AND u < 1 - 1e-9)
    SELECT g, flow, count(*) AS n_crossings, min(other) AS first_other FROM f GROUP BY g, flow""")
def flow_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, C19, FA-VIS-001."""
    return graph.crossings(M.WAYPOINTS.df(spark))


@R.add(f"""
    WITH t AS (SELECT * FROM {M.TREE.sql})
    SELECT 'FA-L4-001' AS rule_id, g, node AS target FROM t WHERE type = 'L4' AND greatest(len(departments), len(systems), len(timeframes), len(locations)) > 1
    UNION ALL SELECT 'FA-HIER-001', g, node FROM t WHERE type <> 'L3' AND NOT EXISTS (SELECT 1 FROM t p WHERE p.g = t.g AND p.node = t.parent_id)
    UNION ALL SELECT 'FA-L6-004', g, node FROM t WHERE type = 'L6' AND regexp_matches(name, '(?i)(_|\\b(SAP|API|SQL|DB|HTTP|JSON|XML)\\b)')
    UNION ALL SELECT 'FA-SOP-004', g, node FROM t WHERE type = 'SOP' AND len(l6_references) = 0""")
def arch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FA-L4-001, FA-HIER-001, FA-L6-004, FA-SOP-004."""
    return rules.architecture_rules(M.TREE.df(spark))


_MODEL = f"n AS (SELECT * FROM {D.model_sql('NODES')}), f AS (SELECT * FROM {D.model_sql('FLOWS')}), l AS (SELECT * FROM {D.model_sql('LANES')}), b AS (SELECT * FROM {D.model_sql('BINDINGS')}), a AS (SELECT * FROM {D.model_sql('ACTIVITIES')}), c AS (SELECT * FROM {D.model_sql('CARDS')})"
_DEGREE = "deg AS (SELECT n.*, (SELECT count(*) FROM f WHERE f.g = n.g AND f.dst = n.node) AS n_in, (SELECT count(*) FROM f WHERE f.g = n.g AND f.src = n.node) AS n_out FROM n)"
_OPEN = "open_x AS (SELECT n.g, n.node FROM n JOIN f ON f.g = n.g AND f.src = n.node WHERE node_type IN ('XOR_GATEWAY', 'OR_GATEWAY') GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (coalesce(trim(label), '') = '') > 0)"
_CHECKED = ", ".join(f"'{t}'" for t in rules.CHECKED_TYPES)


@R.add(f"""
    WITH {_MODEL}, {_DEGREE}, {_OPEN}, g AS (SELECT * FROM deg WHERE node_type = 'AND_GATEWAY')
    SELECT 'FA-BPMN-007' AS rule_id, g, node AS target FROM deg WHERE n_in + n_out = 0 AND node_type IN ({_CHECKED})
    UNION ALL SELECT 'FA-BPMN-004', g, node FROM g WHERE (n_out > 1 AND NOT EXISTS (SELECT 1 FROM g o WHERE o.g = g.g AND o.node <> g.node AND o.n_in > 1)) OR (n_in > 1 AND NOT EXISTS (SELECT 1 FROM g o WHERE o.g = g.g AND o.node <> g.node AND o.n_out > 1))
    UNION ALL SELECT 'FA-BPMN-005', g, node FROM open_x""")
def bpmn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FA-BPMN-004, 005, 007."""
    return rules.bpmn_rules(D.model("NODES", spark, sf_dir), D.model("FLOWS", spark, sf_dir))


_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_MATCH = """{a} <> '' AND {b} <> '' AND ({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR (len(string_split({a}, ' ')) >= 2 AND len(string_split({b}, ' ')) >= 2 AND string_split({a}, ' ')[-2:] = string_split({b}, ' ')[-2:]))"""
_NAMED = f"t AS (SELECT *, {_NORM.format(c='name')} AS nn FROM {M.TREE.sql}), e AS (SELECT *, {_NORM.format(c='name')} AS nn FROM {M.ELEMENTS.sql})"


@R.add(f"""
    WITH {_NAMED}, want AS (SELECT * FROM t WHERE (type = 'L4' AND EXISTS (SELECT 1 FROM e WHERE e.g = t.g AND e.type IN ('SUB_PROCESS', 'POOL'))) OR (type = 'L5' AND EXISTS (SELECT 1 FROM t p WHERE p.g = t.g AND p.node = t.parent_id))),
    m AS (SELECT w.g, w.node, arg_min(e.element, e.pos) AS element FROM want w JOIN e ON e.g = w.g AND e.type IN ('TASK', 'SUB_PROCESS', 'POOL') AND {_MATCH.format(a='w.nn', b='e.nn')} GROUP BY 1, 2)
    SELECT CASE type WHEN 'L4' THEN 'FA-CONS-001' ELSE 'FA-CONS-002' END AS rule_id, g, node AS target FROM want WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.g = want.g AND m.node = want.node)
    UNION ALL SELECT 'FA-CONS-008', g, element FROM e WHERE type = 'TASK' AND NOT EXISTS (SELECT 1 FROM m WHERE m.g = e.g AND m.element = e.element)""")
def name_match_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, J11, C8, FA-CONS-001, 002, 008."""
    return rules.consistency_rules(M.TREE.df(spark), M.ELEMENTS.df(spark))


@R.add(f"""
    WITH {_NAMED}, m AS (SELECT t.g, t.node, arg_min(e.element, e.pos) AS element FROM t JOIN e ON e.g = t.g AND {_MATCH.format(a='t.nn', b='e.nn')} GROUP BY 1, 2),
    r AS (SELECT m.g, e.lane, {_NORM.format(c='l.name')} AS lane_name, t.roles FROM m JOIN e ON e.g = m.g AND e.element = m.element JOIN t ON t.g = m.g AND t.node = m.node JOIN {M.DIAGRAM_LANES.sql} l ON l.g = m.g AND l.lane = e.lane WHERE len(t.roles) > 0)
    SELECT DISTINCT 'FA-CONS-003' AS rule_id, g, lane AS target FROM r WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(r.roles) AS x) q WHERE {_MATCH.format(a=_NORM.format(c='q.x'), b='r.lane_name')})""")
def lane_role_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, FA-CONS-003."""
    return rules.lane_role_conflicts(M.TREE.df(spark), M.ELEMENTS.df(spark), M.DIAGRAM_LANES.df(spark))


_BOUND = """bound AS (SELECT g, activity, arg_min(main_task, pos) AS bound_task, arg_min({'c': confirmation_task}, pos).c AS confirmation_task, count(*) AS n_bindings, count(DISTINCT main_task) AS n_main FROM b GROUP BY 1, 2),
    rl AS (SELECT g, role, arg_min(lane, pos) AS lane FROM l GROUP BY 1, 2),
    acc AS (SELECT *, CASE WHEN len(list_filter(roles, lambda r: r.code = CASE model WHEN 'RASCI' THEN 'R' ELSE 'O' END)) > 0 THEN list_filter(roles, lambda r: r.code = CASE model WHEN 'RASCI' THEN 'R' ELSE 'O' END)[1].role END AS role, len(list_filter(roles, lambda r: r.code = CASE model WHEN 'RASCI' THEN 'R' ELSE 'O' END)) AS n_acc, activity_type IN ('REVIEW_MEETING', 'DECISION_ACTIVITY') AS formal FROM a),
    told AS (SELECT acc.*, bound_task, confirmation_task, n_bindings, n_main, nt.node_type AS task_type, nt.lane AS task_lane, nt.name AS task_name, nc.node_type AS confirm_type, nc.lane AS confirm_at, r1.lane AS role_lane, r2.lane AS confirm_lane,
        EXISTS (SELECT 1 FROM f WHERE f.g = acc.g AND f.src = bound_task AND f.dst = confirmation_task) AS direct
        FROM acc LEFT JOIN bound ON bound.g = acc.g AND bound.activity = acc.activity LEFT JOIN n nt ON nt.g = acc.g AND nt.node = bound_task LEFT JOIN n nc ON nc.g = acc.g AND nc.node = confirmation_task
        LEFT JOIN rl r1 ON r1.g = acc.g AND r1.role = acc.role LEFT JOIN rl r2 ON r2.g = acc.g AND r2.role = confirm_role)"""


@R.add(f"""
    WITH {_MODEL}, {_OPEN}, {_BOUND}
    SELECT 'FA-ACT-BPMN-001' AS rule_id, g, activity AS target FROM told WHERE len(list_filter(roles, lambda r: regexp_matches(r.role, '(?i)^(person_|employee_|emp_|user_)'))) > 0
    UNION ALL SELECT 'FA-ACT-BPMN-002', g, activity FROM told WHERE coalesce(n_bindings, 0) <> 1 OR task_type IS NULL OR task_type <> 'MAIN_TASK' OR bound_task <> main_task OR coalesce(task_name, '') <> name
    UNION ALL SELECT 'FA-ACT-BPMN-003', g, activity FROM told WHERE task_type IS NOT NULL AND role IS NOT NULL AND task_lane IS DISTINCT FROM role_lane
    UNION ALL SELECT 'FA-ACT-BPMN-004', g, activity FROM told WHERE confirm_role IS NOT NULL AND NOT formal AND (NOT coalesce(co_completes, false) OR NOT coalesce(bears, false) OR NOT coalesce(no_meeting, false) OR confirm_lane IS NULL OR confirm_role = coalesce(role, '') OR confirmation_task IS NULL OR coalesce(confirm_type <> 'CONFIRMATION_TASK', true) OR confirm_at IS DISTINCT FROM confirm_lane OR confirm_at IS NOT DISTINCT FROM task_lane OR NOT direct)
    UNION ALL SELECT 'FA-ACT-BPMN-005', g, activity FROM told WHERE formal AND (confirm_role IS NOT NULL OR confirmation_task IS NOT NULL)
    UNION ALL SELECT 'FA-ACT-BPMN-006', g, node FROM open_x
    UNION ALL SELECT 'FA-ACT-BPMN-009', g, activity FROM told WHERE n_main > 1""")
def activity_bpmn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, FA-ACT-BPMN-001 to 006, 009."""
    return rules.activity_findings(D.model("ACTIVITIES", spark, sf_dir), D.model("BINDINGS", spark, sf_dir), D.model("NODES", spark, sf_dir), D.model("FLOWS", spark, sf_dir), D.model("LANES", spark, sf_dir))


@R.add(f"""
    WITH {_MODEL}, e AS (SELECT g, node AS target, coalesce(name, '') AS name FROM n WHERE node_type = 'END_EVENT'), d AS (SELECT g, x.event_id AS target, x.name AS declared FROM (SELECT g, unnest(end_results) AS x FROM c)),
    j AS (SELECT coalesce(e.g, d.g) AS g, coalesce(e.target, d.target) AS target, name, declared FROM e FULL JOIN d ON d.g = e.g AND d.target = e.target),
    p AS (SELECT g, target, CASE WHEN name IS NULL THEN 'MISSING' WHEN trim(name) = '' THEN 'EMPTY_NAME' WHEN declared IS NULL THEN 'UNDECLARED' WHEN name <> declared THEN 'MISMATCH' END AS problem FROM j)
    SELECT * FROM p WHERE problem IS NOT NULL""")
def end_event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, FA-ACT-BPMN-007."""
    return rules.end_events(D.model("CARDS", spark, sf_dir), D.model("NODES", spark, sf_dir))


@R.add(f"""
    WITH {_MODEL}, {_DEGREE}, k AS (SELECT *, node_type LIKE '%THROW' AS throws FROM deg WHERE node_type LIKE 'INTERMEDIATE_LINK_%'),
    s AS (SELECT g, coalesce(trim(name), '') AS name, count(*) FILTER (throws) AS n_throw, count(*) FILTER (NOT throws) AS n_catch, bool_or(CASE WHEN throws THEN n_out > 0 OR n_in = 0 ELSE n_in > 0 OR n_out = 0 END) AS turned FROM k GROUP BY 1, 2),
    p AS (SELECT g, name, CASE WHEN n_throw = 0 THEN 'NO_THROW' WHEN n_catch = 0 THEN 'NO_CATCH' WHEN n_catch > 1 THEN 'MANY_CATCHES' WHEN turned THEN 'DIRECTION' END AS problem FROM s)
    SELECT * FROM p WHERE problem IS NOT NULL""")
def link_event_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, FA-ACT-BPMN-008."""
    return rules.link_pairs(D.model("NODES", spark, sf_dir), D.model("FLOWS", spark, sf_dir))


@R.add(f"""
    WITH {_MODEL}, {_BOUND}, leaf AS (SELECT *, is_leaf AND level IN ('L4', 'L5') AS leaf FROM c), drawn AS (SELECT g FROM n UNION SELECT g FROM f UNION SELECT g FROM b),
    bk AS (SELECT b.*, nt.node_type AS task_type FROM b LEFT JOIN n nt ON nt.g = b.g AND nt.node = b.main_task), mains AS (SELECT n.g, n.node, (SELECT count(*) FROM b WHERE b.g = n.g AND b.main_task = n.node) AS k FROM n WHERE node_type = 'MAIN_TASK'),
    st AS (SELECT leaf.g, leaf.start, (SELECT count(*) FROM n WHERE n.g = leaf.g AND node_type = 'START_EVENT') AS k, (SELECT min({{'a': node, 'b': name}}) FROM n WHERE n.g = leaf.g AND node_type = 'START_EVENT') AS s,
        list_sort(end_results) AS declared, (SELECT list({{'event_id': node, 'name': name}} ORDER BY node, name) FROM n WHERE n.g = leaf.g AND node_type = 'END_EVENT') AS ends FROM leaf WHERE leaf),
    cf AS (SELECT * FROM told WHERE confirm_role IS NOT NULL AND confirmation_task IS NOT NULL AND confirm_type IS NOT NULL),
    gates AS (
        SELECT 'CARD-001' AS code, g, g AS target FROM c WHERE NOT parent_declared
        UNION ALL SELECT 'LEAF-001', g, g FROM leaf WHERE NOT leaf AND g IN (SELECT g FROM a) UNION ALL SELECT 'LEAF-001', g, g FROM leaf WHERE NOT leaf AND g IN (SELECT g FROM drawn)
        UNION ALL SELECT 'LANE-003', g, lane FROM l GROUP BY g, lane HAVING count(*) > 1 UNION ALL SELECT 'LANE-003', g, role FROM l GROUP BY g, role HAVING count(*) > 1
        UNION ALL SELECT 'MODEL-001', g, activity FROM a WHERE model <> CASE WHEN activity_type = 'STANDARD' THEN 'RASCI' WHEN activity_type IN ('REVIEW_MEETING', 'DECISION_ACTIVITY') THEN 'OARP' END
        UNION ALL SELECT 'ROLE-001', g, activity FROM acc WHERE n_acc <> 1
        UNION ALL SELECT 'ROLE-002', g, activity FROM (SELECT g, activity, r.role AS role, count(DISTINCT r.code) AS k FROM (SELECT g, activity, unnest(roles) AS r FROM a) GROUP BY 1, 2, 3) WHERE k > 1
        UNION ALL SELECT 'BIND-001', g, activity FROM told WHERE coalesce(n_bindings, 0) <> 1 UNION ALL SELECT 'BIND-002', g, activity FROM told WHERE bound_task <> main_task UNION ALL SELECT 'BIND-002', g, bound_task FROM told WHERE task_type <> 'MAIN_TASK'
        UNION ALL SELECT 'BIND-002', g, activity FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.g = b.g AND a.activity = b.activity) UNION ALL SELECT 'BIND-002', g, main_task FROM bk WHERE task_type IS NULL OR task_type <> 'MAIN_TASK'
        UNION ALL SELECT 'CONFIRM-001', g, activity FROM told WHERE confirm_role IS NOT NULL AND NOT coalesce(co_completes AND bears AND no_meeting, false) UNION ALL SELECT 'CONFIRM-002', g, activity FROM told WHERE (confirm_role IS NULL) <> (confirmation_task IS NULL)
        UNION ALL SELECT 'CONFIRM-002', g, confirmation_task FROM told WHERE confirm_role IS NOT NULL AND confirmation_task IS NOT NULL AND coalesce(confirm_type <> 'CONFIRMATION_TASK', true) UNION ALL SELECT 'CONFIRM-003', g, activity FROM told WHERE formal AND (confirm_role IS NOT NULL OR confirmation_task IS NOT NULL)
        UNION ALL SELECT 'LANE-001', g, activity FROM told WHERE role IS NOT NULL AND task_type IS NOT NULL AND task_lane IS DISTINCT FROM role_lane
        UNION ALL SELECT 'LANE-002', g, activity FROM cf WHERE confirm_lane IS NULL OR confirm_at <> confirm_lane UNION ALL SELECT 'LANE-002', g, activity FROM cf WHERE confirm_lane IS NOT NULL AND task_lane = confirm_at
        UNION ALL SELECT 'PARALLEL-001', g, activity FROM bound WHERE n_main > 1 UNION ALL SELECT 'BINDING-001', g, node FROM mains WHERE k = 0 UNION ALL SELECT 'BINDING-002', g, node FROM mains WHERE k > 1
        UNION ALL SELECT 'CARD-002', g, g FROM st WHERE k <> 1 UNION ALL SELECT 'CARD-004', g, g FROM st WHERE k = 1 AND NOT (start.event_id IS NOT DISTINCT FROM s.a AND start.name IS NOT DISTINCT FROM s.b)
        UNION ALL SELECT 'CARD-003', g, g FROM st WHERE ends IS NULL UNION ALL SELECT 'CARD-005', g, g FROM st WHERE ends IS NOT NULL AND declared IS DISTINCT FROM ends)
    SELECT 'FA-DRAFT-' || code AS rule_id, g, target FROM gates""")
def draft_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty gates of drafts."""
    return rules.draft_gates(D.model("CARDS", spark, sf_dir), D.model("ACTIVITIES", spark, sf_dir), D.model("BINDINGS", spark, sf_dir), D.model("NODES", spark, sf_dir), D.model("FLOWS", spark, sf_dir), D.model("LANES", spark, sf_dir))


@R.add()
def mermaid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes."""
    return diagrams.mermaid(M.MERMAID.df(spark))[0]


@R.add("SELECT * FROM (VALUES ('m1', 'flow_1', 'SEQUENCE', 'A', 'B', NULL), ('m1', 'flow_2', 'SEQUENCE', 'B', 'C', 'yes'), ('m1', 'flow_3', 'ASSOCIATION', 'B', 'D', 'no'), ('m1', 'flow_4', 'SEQUENCE', 'D', 'A', NULL), ('m1', 'flow_5', 'SEQUENCE', 'A', 'E', NULL), ('m3', 'flow_1', 'SEQUENCE', 'x', 'y', NULL)) AS v(doc, flow_id, type, source_ref, target_ref, label)")
def mermaid_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows."""
    return diagrams.mermaid(M.MERMAID.df(spark))[1]


@R.add()
def bpmn_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, S17, S18."""
    return diagrams.bpmn(M.BPMN.df(spark)).drop("points", "pos")


@R.add("SELECT * FROM (VALUES ('b1', 4::BIGINT, 3::BIGINT, 1::BIGINT, 0.7::DOUBLE), ('b2', 0, 0, 0, 0.3), ('b3', 0, 0, 0, 0.3), ('b4', 2, 0, 0, 0.95)) AS v(doc, n_elements, n_flows, n_dangling, confidence)")
def bpmn_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is lost and how sure the rest is."""
    return diagrams.extraction_confidence(diagrams.bpmn(M.BPMN.df(spark)))


@R.add()
def svg_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20."""
    return diagrams.svg(M.SVG.df(spark)).select("doc", "id", "type", "name", "sub_type", "points")


@R.add("SELECT * FROM (VALUES ('a1', 5, 'L4', 'CM-1.1', 'Order', 'CM-1', ['Clerk', 'Boss', 'Chief', 'Aide']), ('a1', 6, 'L4', 'CM-1.2', 'Pay', 'CM-1', []), ('a1', 10, 'SOP', 'S-1', 'How', 'CM-1.1', [])) AS v(doc, line_no, type, node_id, name, parent_id, roles)")
def arch_md_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21, C11."""
    return diagrams.architecture(M.ARCHITECTURE_MD.df(spark))


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_TAG = "CASE " + " ".join(f"WHEN node_type = '{k}' THEN '{v}'" for k, v in render.TAGS.items()) + " WHEN node_type LIKE '%THROW' THEN 'intermediateThrowEvent' ELSE 'intermediateCatchEvent' END"


@R.add(f"""
    WITH {_MODEL}, lt AS (SELECT g, string_agg('      <bpmn:lane id="' || lane || '" name="' || {_esc('name')} || '">' || chr(10) || coalesce((SELECT string_agg('        <bpmn:flowNodeRef>' || node || '</bpmn:flowNodeRef>', chr(10) ORDER BY pos, node) FROM n WHERE n.g = l.g AND n.lane = l.lane) || chr(10), '') || '      </bpmn:lane>', chr(10) ORDER BY pos, lane) AS t FROM l GROUP BY g),
    nt AS (SELECT g, string_agg('    <bpmn:' || {_TAG} || ' id="' || node || '" name="' || {_esc('name')} || '" />', chr(10) ORDER BY pos, node) AS t FROM n GROUP BY g),
    ft AS (SELECT g, string_agg('    <bpmn:sequenceFlow id="' || edge || '" sourceRef="' || src || '" targetRef="' || dst || CASE WHEN coalesce(label, '') = '' THEN '" />' ELSE '"><bpmn:conditionExpression>' || {_esc('label')} || '</bpmn:conditionExpression></bpmn:sequenceFlow>' END, chr(10) ORDER BY edge) AS t FROM f GROUP BY g)
    SELECT c.g, concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>', '<bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL">', '  <bpmn:process id="Process_' || c.g || '" name="' || {_esc('c.name')} || '" isExecutable="false">',
        '    <bpmn:laneSet id="LaneSet_1">' || chr(10) || lt.t || chr(10) || '    </bpmn:laneSet>', nt.t, ft.t, '  </bpmn:process>', '</bpmn:definitions>') AS xml
    FROM c LEFT JOIN lt USING (g) LEFT JOIN nt USING (g) LEFT JOIN ft USING (g)""")
def bpmn_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    return render.bpmn_xml(D.model("CARDS", spark, sf_dir), D.model("LANES", spark, sf_dir), D.model("NODES", spark, sf_dir), D.model("FLOWS", spark, sf_dir))
