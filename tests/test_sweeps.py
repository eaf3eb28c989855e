"""Sweeps against brute force: overlapping spans, hot keys, ties, many buckets; super nodes by broadcast and by salts."""

import random

import pytest
from pyspark.sql import functions as F

from scopelake.operators import deps, flow, sweep


def innermost(points, spans):
    out = []
    for p, k, at in points:
        held = [(s, -e, i) for key, s, e, i in spans if key == k and s <= at <= e]
        if held:
            out.append((p, max(held)[2]))
    return sorted(out)


@pytest.mark.parametrize("few", [1 << 16, 8])
def test_smallest_enclosing(spark, monkeypatch, few):
    monkeypatch.setattr(sweep, "FEW_BLOCKS", few)
    monkeypatch.setattr(sweep, "BUCKET_ROWS", 40)
    rng = random.Random(few)
    spans = [(rng.choice("aab"), s, s + rng.randrange(-1, 120), f"s{i:03}") for i in range(150) for s in [rng.randrange(-50, 200)]]  # some end before they start
    spans += [("a", 10, 20, "same"), ("a", 10, 20, "equal"), (None, 0, 9, "none")]
    points = [(i, rng.choice("aaac"), rng.randrange(-80, 350)) for i in range(400)] + [(900, None, 3), (901, "a", None)]
    p = spark.createDataFrame(points, "p long, k string, at long")
    s = spark.createDataFrame(spans, "k string, start long, end long, span_id string")
    got = sorted((r["p"], r["span_id"]) for r in sweep.smallest_enclosing(p, s, "k", "at").collect())
    assert got == innermost([x for x in points if x[1] and x[2] is not None], spans)
    assert sweep.smallest_enclosing(p, s.where("1 = 0"), "k", "at").count() == 0
    assert sweep.smallest_enclosing(p.where("1 = 0"), s, "k", "at").count() == 0


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, width, strict):
    rng = random.Random(width)
    events = [(rng.choice("ab"), rng.randrange(60), i) for i in range(40)]
    points = [(i, rng.choice("abc"), rng.randrange(-5, 70), "kept") for i in range(120)]
    e = spark.createDataFrame(events, "k string, t long, v long")
    p = spark.createDataFrame(points, "p long, k string, t long, more string")
    got = sorted((r["p"], r["found"]) for r in sweep.asof(p, e, ["k"], "t", "v", width, strict).where("more = 'kept'").collect())
    before = lambda k, t: max(((x, v) for key, x, v in events if key == k and (x < t or not strict and x == t)), default=(0, None))[1]
    assert got == sorted((i, before(k, t)) for i, k, t, _ in points)


def test_a_name_defined_again_and_again(spark):
    """The sweep holds a row for every usage and ancestor, not for every earlier definition."""
    defs = [(0, "x", 2 * i, i) for i in range(500)] + [(1, "x", 700, 1000)]
    usages = [(i, 1 if i % 2 else 0, "x", 2 * i + 1) for i in range(500)]
    closed = [(0, 0, 0), (1, 1, 0), (1, 0, 1)]
    d = spark.createDataFrame(defs, "scope long, name string, preorder long, def_id long")
    u = spark.createDataFrame(usages, "usage_id long, scope long, name string, preorder long")
    c = spark.createDataFrame(closed, "node long, ancestor long, distance long")
    found = flow.resolve_ordered(u, c, d, width=64)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["usage_id"], r["def_id"]) for r in found.collect()) == [(i, 1000 if i % 2 and 2 * i + 1 > 700 else i) for i in range(500)]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_super_nodes_without_a_hot_task(spark, most_bytes):
    rng = random.Random(3)
    edges = [(f"s{rng.randrange(40)}", "hub") for _ in range(600)] + [(f"s{rng.randrange(40)}", f"t{rng.randrange(30)}") for _ in range(300)]
    e = spark.createDataFrame(edges, "source string, target string")
    got = sorted(map(tuple, deps.collapse_super_nodes(e, deps.super_nodes(e, 100), most_bytes).collect()))
    assert got == sorted([(s, "hub", "badge") for s in {s for s, t in edges if t == "hub"}] + [(s, t, "edge") for s, t in edges if t != "hub"])


def test_many_super_nodes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(deps, "LARGEST", 2, raising=False)
    edges = [(f"s{k % (i + 2)}", f"t{i}") for i in range(12) for k in range(30)]
    e = spark.createDataFrame(edges, "source string, target string")
    got = deps.collapse_super_nodes(e, deps.super_nodes(e, 5, distinct_sources=True), 0)
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    few = {f"t{i}" for i in range(4)}
    assert sorted(map(tuple, got.collect())) == sorted([(s, t, "edge") for s, t in edges if t in few] + [(s, t, "badge") for s, t in set(edges) if t not in few])


def test_an_else_behind_other_siblings(spark):
    kinds = ["if_branch", "case", "if_branch", "try", "else_branch", "catch", "else_branch", "if_branch"]
    r = spark.createDataFrame([("p", i, k) for i, k in enumerate(kinds)], "parent string, o long, kind string")
    got = flow.sibling_edges(r, "parent", "o", "kind", {"try": ["catch"]}, {"if_branch": "else_branch"})
    assert sorted((x["source"], x["target"]) for x in got.collect()) == [(0, 4), (2, 4)]


def test_codes_by_proposals_equal_one_after_another(spark):
    rng = random.Random(8)
    labels = [("".join(rng.choice("AB") for _ in range(rng.randrange(0, 3))) + f"x{i}", i, rng.sample(["AA", "AB", "BA", "BB", "B1"], rng.randrange(0, 4))) for i in range(12)] + [("", 99, [])]
    got = {r["label"]: r["code"] for r in deps.assigned_codes(spark.createDataFrame(labels, "label string, ord long, wanted array<string>")).collect()}
    assert got == deps.assign_codes([(label, wanted) for label, _, wanted in labels])


@pytest.mark.parametrize("part", [4785, 44295, 52759, 124525, 126195, 170976])
def test_small_fan_ins_are_never_far_off(spark, tmp_path, part):
    from scopelake.plans.queries import approximate_fan_in

    # ten suppliers that registers of 12 bits count as eight
    spark.range(part * 10, part * 10 + 10).select(F.lit(part).cast("long").alias("l_partkey"), F.col("id").alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in approximate_fan_in(spark, str(tmp_path)).select("target", "exact", "within").collect()] == [(f"p{part}", 10, True)]
