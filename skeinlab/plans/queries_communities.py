"""Queries over the stages of the file planner, and over modularity communities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skeinlab.operators import communities as C
from skeinlab.plans import roles as R
from skeinlab.plans.registry import query

_CALLS = f"{R.edges_sql('all_edges')}, edges AS (SELECT source_id, target_id FROM all_edges WHERE edge_kind = 'calls')"
_GRAPH = "g AS (SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, count(*) AS weight FROM edges JOIN groups a ON a.id = source_id JOIN groups b ON b.id = target_id WHERE a.file = b.file AND a.rep <> b.rep GROUP BY 1, 2)"

#: The tables' vectors are nearly at right angles to each other, so symbols count as alike from a lower cosine on.
_PLANNER = C.Planner(threshold=0.3)


def _calls(spark, d):
    return R.edges(spark, d).filter("edge_kind = 'calls'")


def _plain(node: str) -> Column:
    """A node's id, without its run."""
    return F.substring_index(node, ":", -1).alias(node)


def _anchored(spark, d):
    e = C.cut(C.entries(R.planner_symbols(spark, d), _PLANNER.runs()[:1]))
    return e, C.cut(C.anchor_groups(e).withColumn("split", F.lit(False)))


@query("planner_anchors", f"WITH {R.PLANNER} SELECT node, rep FROM groups")
def _(spark, d):
    return _anchored(spark, d)[1].select(_plain("node"), _plain("rep"))


@query("planner_splits")
def _(spark, d):
    e, groups = _anchored(spark, d)
    return C.split_groups(e, groups.drop("split")).select(_plain("node"), _plain("rep"), "split")


@query("planner_structure", f"WITH {R.PLANNER}, {_CALLS}, {_GRAPH} SELECT a, b, weight FROM g")
def _(spark, d):
    e, groups = _anchored(spark, d)
    return C.structure(e, groups, _calls(spark, d)).select(_plain("a"), _plain("b"), "weight")


@query("planner_container_rescue", f"""WITH {R.PLANNER}, {_CALLS}, {_GRAPH}, alone AS (SELECT *, rep IN (SELECT a FROM g UNION SELECT b FROM g) AS tied FROM groups WHERE rep IN (SELECT rep FROM groups GROUP BY 1 HAVING count(*) = 1))
SELECT DISTINCT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b FROM alone x JOIN alone y ON x.file = y.file AND x.stem = y.stem AND x.rep <> y.rep WHERE NOT x.tied""")
def _(spark, d):
    e, groups = _anchored(spark, d)
    return C.container_rescue(e, groups, C.structure(e, groups, _calls(spark, d)))[0].select(_plain("a"), _plain("b"))


@query("planner_semantic_rescue")
def _(spark, d):
    e, groups = _anchored(spark, d)
    return C.semantic_rescue(e, groups, C.cut(C.structure(e, groups, _calls(spark, d))))[0].select(_plain("a"), _plain("b"))


@query("file_communities")
def _(spark, d):
    return C.detect(R.planner_symbols(spark, d), _calls(spark, d), _PLANNER)[0]


@query("file_community_report")
def _(spark, d):
    return C.detect(R.planner_symbols(spark, d), _calls(spark, d), _PLANNER)[1]


@query("split_suggestions")
def _(spark, d):
    s = R.planner_symbols(spark, d)
    out, report = C.detect(s, _calls(spark, d), _PLANNER)
    scores = R.read(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.avg("p_size").alias("score"))
    return C.suggest_splits(s.withColumn("name", F.lit(None).cast("string")), out, report, scores)


@query("louvain")
def _(spark, d):
    return C.louvain(R.edges(spark, d))
