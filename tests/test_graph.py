"""Literal graphs with results worked out by hand."""

import pytest

from tessella.operators import calls, community, feedback, impact, merge, rank, sections, topology, traverse
from tessella.operators.components import connected_components

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "source string, target string, key string, relation string, confidence string, confidence_score double, weight double, context string, source_file string"


def graph(spark, pairs, nodes=None, relation="calls", confidence="EXTRACTED"):
    ids = sorted({x for p in pairs for x in p[:2]} | set(nodes or ()))
    n = spark.createDataFrame([(i, i.upper(), "code", f"src/{i}.py", 0) for i in ids], NODE)
    e = spark.createDataFrame([(p[0], p[1], str(k), p[2] if len(p) > 2 else relation, p[3] if len(p) > 3 else confidence, None, 1.0, None, f"src/{p[0]}.py") for k, p in enumerate(pairs)], EDGE)
    return n, e


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_degrees_of_loops_and_reciprocal_edges(spark):
    n, e = graph(spark, [("a", "a"), ("a", "b"), ("b", "a")], ["c"])
    assert rows(topology.distinct_degree(n, e), "id", "degree") == [("a", 2), ("b", 1), ("c", 0)]
    assert rows(topology.record_degree(n, e), "id", "degree") == [("a", 4), ("b", 2), ("c", 0)]


def test_diamond_expansion_keeps_both_edges_of_a_layer(spark):
    n, e = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    seeds = spark.createDataFrame([("a",)], "id string")
    layers, found = traverse.expand(n, e, seeds, 3)
    assert rows(layers, "id", "level") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(found, "level", "source", "target") == [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "d")]
    assert [r.id for r in traverse.shortest_path(e, "a", "d").orderBy("hop").collect()] == ["a", "b", "d"]
    assert [r.id for r in traverse.expand_depth_first(n, e, seeds, 3).orderBy("order").collect()] == ["a", "b", "d", "c"]


def test_hub_is_met_but_not_passed(spark):
    spokes = [("h", f"s{i:02d}") for i in range(60)]
    n, e = graph(spark, [*spokes, ("a", "h")])
    layers, _ = traverse.expand(n, e, spark.createDataFrame([("a",)], "id string"), 3)
    assert rows(layers, "id") == [("a",), ("h",)]


def test_paths_that_do_not_exist(spark):
    _, e = graph(spark, [("a", "b"), ("c", "d")])
    assert traverse.shortest_path(e, "a", "d").count() == 0
    assert [tuple(r) for r in traverse.shortest_path(e, "a", "a").collect()] == [(0, "a")]


def test_cycles_once_each(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("b", "c")], "source string, target string")
    assert rows(traverse.cycles(pairs), "length", "nodes") == [(1, "d"), (2, "a > b"), (3, "a > b > c")]


def test_affected_goes_against_the_edges(spark):
    _, e = graph(spark, [("a", "b"), ("b", "c"), ("x", "c", "contains"), ("c", "c")])
    assert rows(traverse.affected(e, "c"), "id", "depth", "relation") == [("a", 2, "calls"), ("b", 1, "calls")]


def test_projection_and_envelope_of_parallel_edges(spark):
    _, e = graph(spark, [("a", "b", "calls", "EXTRACTED"), ("b", "a", "uses", "INFERRED"), ("a", "b", "imports", "AMBIGUOUS"), ("a", "b", "uses", "INFERRED"), ("a", "a")])
    for mode, weight in (("confidence", 1.0), ("count", 4.0), ("sum", 2.2)):
        r = topology.project(e, mode).collect()
        assert len(r) == 1 and r[0].weight == pytest.approx(weight) and r[0].relation == "calls"
    env = topology.envelopes(e, 3).where("a = 'a' and b = 'b'").first()
    assert (env["count"], env.truncated, env.relations) == (4, 1, ["calls", "imports", "uses"])
    assert topology.envelopes(e, 0).where("b = 'b'").first().shown == ""
    assert topology.envelopes(e, 3, directed=True).count() == 3


def test_god_nodes_leave_out_files_stubs_and_noise(spark):
    n = spark.createDataFrame([("a", "Core", "code", "x.py", 0), ("f", "x.py", "code", "src/x.py", 0), ("m", ".run()", "code", "x.py", 0), ("s", "str", "code", "x.py", 0), ("k", "Name", "code", "p.json", 0), ("c", "Idea", "concept", "", 0), ("z", None, "code", "x.py", 0)], NODE)
    e = spark.createDataFrame([(a, b, "", "calls", "EXTRACTED", 1.0, 1.0, "", "") for a in "afmskcz" for b in "afmskcz" if a < b], EDGE)
    assert [r.id for r in topology.god_nodes(n, e).collect()] == ["a", "z"]


def test_components_of_strings_and_numbers(spark):
    df = spark.createDataFrame([(9, 4), (4, 7), (1, 2), (5, 5), (None, 3)], "a long, b long")
    assert rows(connected_components(df), "node", "component") == [(1, 1), (2, 1), (4, 4), (5, 5), (7, 4), (9, 4)]
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)], "a string, b string")
    assert {r.component for r in connected_components(chain).collect()} == {"n000"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_seed_ladder_and_lookup(spark):
    n = spark.createDataFrame([("a", "run()", "code", "x.py", 0), ("b", "Run All", "code", "y.py", 0), ("c", "other", "code", "x.py", 0), ("d", "Other", "code", "z.py", 0)], NODE)
    assert rank.resolve_seed(n, "a") == "a" and rank.resolve_seed(n, "run") == "a" and rank.resolve_seed(n, "y.py") == "b"
    assert rank.resolve_seed(n, "other") is None and rank.resolve_seed(n, "nothing") is None
    assert [(r.id, r.tier) for r in rank.find_node(n, "run").collect()] == [("a", 2), ("b", 3)]


def test_full_query_beats_single_words(spark):
    n = spark.createDataFrame([("a", "graph store", "code", "x.py", 0), ("b", "graph", "code", "y.py", 0), ("c", "store graph engine", "code", "z.py", 0)], NODE)
    s = rank.score_nodes(n, ["graph", "store"])
    assert [r.id for r in rank.seeds(s).collect()][0] == "a"
    assert rank.score_nodes(n, []).count() == 0


def test_query_words():
    assert rank.query_terms("How does the Café parse IDs?") == ["cafe", "parse", "ids"]
    assert rank.context_filters(["Calls", "params", "call"]) == ["call", "parameter_type"]
    assert rank.infer_contexts("which modules are imported, and what returns?") == ["import", "return_type"]


def test_answer_keeps_to_its_budget(spark):
    n, e = graph(spark, [("alpha", f"b{i}") for i in range(30)])
    lines = [r.line for r in rank.answer(n, e, "alpha", depth=1, budget=50).orderBy("pos").collect()]
    assert lines[0].startswith("NODE ALPHA") and sum(len(x) + 1 for x in lines) <= 150


def test_surprise_of_suppressed_and_semantic_edges(spark):
    n = spark.createDataFrame([("a", "A", "code", "x/a.py", 0), ("b", "B", "code", "y/b.rs", 1), ("c", "C", "code", "y/c.pdf", 1)], NODE)
    e = spark.createDataFrame([("a", "b", "1", "calls", "INFERRED", 0.5, 1.0, "", ""), ("a", "c", "2", "semantically_similar_to", "AMBIGUOUS", 0.2, 1.0, "", ""), ("a", "b", "3", "imports", "EXTRACTED", 1.0, 1.0, "", "")], EDGE)
    assert rows(rank.surprises(n, e), "key", "score") == [("1", 0), ("2", 12)]


def test_two_cliques_are_two_communities(spark):
    left, right = "abcdef", "uvwxyz"
    pairs = [(a, b) for side in (left, right) for a in side for b in side if a < b]
    n, e = graph(spark, [*pairs, ("a", "u")], ["lone"])
    found = {r.id: r.community for r in community.communities(n, e).collect()}
    assert len({found[x] for x in left}) == len({found[x] for x in right}) == 1 and len(set(found.values())) == 3
    big = {r.id: r.community for r in community.communities(n, e, method="labels").collect()}
    assert set(big) == set(found)
    again = community.remap(community.communities(n, e), spark.createDataFrame([(x, 7) for x in right] + [("a", 0)], "id string, community long"))
    assert {r.community for r in again.collect() if r.id in right} == {7}


def test_matching_takes_the_largest_total():
    assert community.assign({(0, 10): 5, (0, 11): 4, (1, 10): 4}) == {11: 0, 10: 1}
    assert community.assign({}) == {}


def test_betweenness_of_a_path(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    nodes, edges = community.betweenness(n, e)
    assert rows(nodes, "id", "score") == [("a", 0.0), ("b", 2.0), ("c", 2.0), ("d", 0.0)]
    assert rows(edges, "a", "b", "score") == [("a", "b", 3.0), ("b", "c", 4.0), ("c", "d", 3.0)]


def test_cohesion_of_one_node_and_of_parallels(spark):
    n, e = graph(spark, [("a", "b"), ("b", "a"), ("a", "b")])
    assert community.cohesion(n, e).first().cohesion == 1.0
    assert community.cohesion(n.where("id = 'a'"), e).first().cohesion == 1.0


def test_merge_rules(spark):
    n = spark.createDataFrame([("x", "1", "a", 1), ("x", "2", "b", 5), (None, "3", "c", 2)], "id string, label string, source_file string, pos int")
    assert rows(merge.last_nodes(n), "id", "label", "pos") == [("x", "2", 1)]
    old = spark.createDataFrame([("p", "a.py"), ("q", "b.py"), ("r", None)], "id string, source_file string")
    new = spark.createDataFrame([("p2", "a.py")], "id string, source_file string")
    gone = spark.createDataFrame([("b.py",)], "source_file string")
    assert rows(merge.replace_sources(old, new, gone).fillna("-"), "id") == [("p2",), ("r",)]
    assert not merge.shrink_guard(old, new.limit(0)) and not merge.shrink_guard(old, new) and merge.shrink_guard(old, new, force=True)


def test_contested_aliases_are_skipped(spark):
    n = spark.createDataFrame([("a", "Foo"), ("b", "Bar"), ("c", "Bar")], "id string, label string")
    e = spark.createDataFrame([("Foo", "bar"), ("foo", "b")], "source string, target string")
    assert rows(merge.resolve_ends(n, e), "source", "target") == [("a", "b"), ("a", "bar")]


def test_three_way_values(spark):
    cols = "id int, v string"
    base = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, None)], cols)
    cur = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (5, None), (6, "n")], cols)
    oth = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (4, "z"), (5, "q"), (6, "n")], cols)
    merged, clash = merge.three_way(base, cur, oth, ["id"], ["v"])
    assert rows(merged, "id", "v") == [(1, "b"), (2, "c"), (3, "b"), (5, "q"), (6, "n")]
    assert rows(clash, "id", "field") == [(3, "v"), (4, "deleted")]


def test_shared_externals_have_owners(spark):
    cols = "id string, label string, source_file string"
    a = spark.createDataFrame([("m", "M", "m.py"), ("np", "numpy", None)], cols)
    b = spark.createDataFrame([("k", "K", "k.py"), ("np", "numpy", "")], cols)
    e = spark.createDataFrame([("k", "np")], "source string, target string")
    n, edges = merge.compose({"one": (a, e.limit(0)), "two": (b, e)})
    assert rows(n.where("label = 'numpy'"), "id", "owners") == [("one::np", ["one", "two"])]
    assert rows(edges, "source", "target") == [("two::k", "one::np")]
    assert rows(merge.detach(merge.detach(n, "one"), "two"), "id") == []


def test_calls_resolve_only_to_one_candidate(spark):
    n = spark.createDataFrame([("a", "load()", "code", "src/a.py"), ("b", "save()", "code", "src/b.py"), ("c", "save()", "code", "lib/c.py"), ("t", "save()", "code", "tests/test_x.py")], "id string, label string, file_type string, source_file string")
    c = spark.createDataFrame([("a", "Load", False, "src/a.py"), ("c", "load", False, "lib/c.py"), ("a", "save", False, "src/a.py"), ("b", "load", True, "src/b.py")], "caller string, callee string, is_member_call boolean, source_file string")
    e = spark.createDataFrame([], "source string, target string, relation string")
    assert rows(calls.unique_calls(c, n, e), "source", "target") == [("c", "a")]
    assert ("a", "b") in rows(calls.nearest_candidates(c, n), "source", "target")


def test_nearest_candidates_equal_all_pairs(spark):
    """Against every pair of call and candidate."""
    import random

    from tessella.functions.paths import is_test

    pick = random.Random(5)
    files = ["a/b/c.py", "a/b/d.py", "a/e.py", "a/b/f/g.py", "tests/a.py", "a/tests/b.py", "z.py", "", None, "/r/x.py"]
    n = [(f"n{pick.randrange(60)}", f"f{pick.randrange(25)}()", pick.choice(files), "code") for _ in range(90)]
    c = sorted({(f"n{pick.randrange(60)}", f"F{pick.randrange(25)}", pick.choice(files)) for _ in range(500)}, key=repr)
    nodes, sites = spark.createDataFrame(n, "id string, label string, source_file string, file_type string"), spark.createDataFrame(c, "caller string, callee string, source_file string")
    test = {r.f: r.t for r in spark.createDataFrame([(f or "",) for f in files], "f string").select("f", is_test("f").alias("t")).collect()}
    folder = lambda f: f.rsplit("/", 1)[0].split("/") if "/" in f else [""]

    def level(a, b):
        x, y = folder(a), folder(b)
        same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return 1_000_000 if a == b else 500_000 if x == y else same

    best = {}
    for caller, callee, site in c:
        for i, label, file, _ in n:
            if label == callee.lower() + "()" and i != caller and (test[site or ""] or not test[file or ""]):
                best.setdefault((caller, callee), []).append((level(site or "", file or ""), i))
    want = {(k[0], min(i for _, i in v)) for k, v in best.items() for top in [max(v)[0]] if len({i for x, i in v if x == top}) == 1 for v in [[y for y in v if y[0] == top]]}
    assert want and set(rows(calls.nearest_candidates(sites, nodes), "source", "target")) == want


def test_nearest_calls_of_names_with_many_candidates_make_no_pairs(spark):
    many = spark.range(20_000).selectExpr("concat('p', id) id", "concat('f', id % 2, '()') label", "concat('lib/f', id % 40, '.py') source_file", "'code' file_type")
    sites = spark.range(20_000).selectExpr("concat('s', id) caller", "concat('f', id % 2) callee", "concat('lib/f', id % 40, '.py') source_file")
    # 200 million pairs in all
    assert calls.nearest_candidates(sites, many).count() == 0


def test_path_tails_match_both_ways(spark):
    r = spark.createDataFrame([(1, ["repo/src/a.py"]), (2, ["a.py"]), (3, ["ba.py", None])], "number long, files array<string>")
    n = spark.createDataFrame([("x", "src/a.py", 1), ("y", "src/a.py", 2), ("z", "b/c.py", 3)], "id string, source_file string, community int")
    assert rows(impact.impact(r, n), "number", "communities", "nodes") == [(1, [1, 2], 2), (2, [1, 2], 2), (3, [], 0)]
    assert rows(impact.conflicts(r, n), "community", "n") == [(1, 2), (2, 2)]


def test_verdicts(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("2026-01-01", "useful", ["a", "a", "b"]), ("2026-01-01", "useful", ["a"]), ("2025-12-02", "dead_end", ["b", "c"]), (None, "other", ["d"])], "date string, outcome string, source_nodes array<string>").withColumn("date", F.col("date").cast("timestamp"))
    out = feedback.lessons(d, F.lit("2026-01-01").cast("timestamp"))
    assert rows(out, "node", "score", "verdict") == [("a", 2.0, "preferred"), ("b", 0.5, "contested: useful")]


def test_flow_chain_and_root(spark):
    assert sections.flow_chain([("a", "b", 3), ("b", "c", 2), ("a", "c", 1), ("c", "a", 1)]) == ["a", "b", "c"]
    p = spark.createDataFrame([("x/y/a.py",), ("x/y/z/b.py",)], "path string")
    assert sections.common_root(p) == "x/y"
    assert sections.flow_chain([]) == []


def test_labels_of_one_community_merge_at_a_lower_score(spark):
    from tessella.operators.entity import candidates, fuzzy_pairs, resolve_entities

    rows = [("a", "mapping invoice routing gateway", "concept", "a.md", 1), ("b", "mapping invqze routing gateway", "concept", "b.md", 2)]
    nodes = spark.createDataFrame(rows, "id string, label string, file_type string, source_file string, pos int")
    edges = spark.createDataFrame([("a", "c")], "source string, target string")
    assert fuzzy_pairs(candidates(nodes)).count() == 0
    for communities, merged in (("1, 1", 1), ("1, 2", 0), ("null, null", 0)):
        x, y = communities.split(", ")
        own = nodes.selectExpr("*", f"cast(if(id = 'a', {x}, {y}) as int) as community")
        assert fuzzy_pairs(candidates(own)).count() == merged
    kept, _, remap = resolve_entities(nodes.selectExpr("*", "7 as community"), edges.selectExpr("*", "'x' as relation"))
    assert [tuple(r) for r in remap.collect()] == [("b", "a")] and kept.count() == 1


def test_large_graphs_are_detected_by_passes_over_their_links(spark, monkeypatch):
    """Rings of cliques above the driver's bound, ended on the driver and not: the cliques, as the driver finds them."""
    from tessella.operators import spread

    pairs = [(f"{g:02d}-{i}", f"{g:02d}-{j}") for g in range(30) for i in range(8) for j in range(i)] + [(f"{g:02d}-0", f"{(g + 1) % 30:02d}-1") for g in range(30)]
    n, e = graph(spark, pairs, ["lone"])
    want = rows(community.communities(n, e), "id", "community")
    monkeypatch.setattr(community, "LOCAL", 50)
    for small in (spread.SMALL, (0, 0)):
        monkeypatch.setattr(spread, "SMALL", small)
        got = rows(community.communities(n, e), "id", "community")
        assert [x for x, _ in got] == [x for x, _ in want] and len({c for _, c in got}) == 31
        if small[0]:
            assert got == want
    with pytest.raises(ValueError, match="limited"):
        community.communities(n, e, local=50)


def test_a_loose_community_is_split_by_passes_as_on_the_driver(spark, monkeypatch):
    ring = [(f"r{i:03d}", f"r{(i + 1) % 120:03d}") for i in range(120)]
    n, e = graph(spark, [*ring, *((f"k{i}", f"k{j}") for i in range(6) for j in range(i))])
    monkeypatch.setattr(community, "LOCAL", 50)
    got = rows(community.communities(n, e), "id", "community")
    assert len({c for x, c in got if x[0] == "k"}) == 1 and 5 <= len({c for x, c in got if x[0] == "r"}) <= 40


def test_shared_steps_keep_odd_rows(spark):
    """Nulls, loops, repeated ids and blank ends in what diagnostics, validation and comparison gather after one shuffle."""
    n = spark.createDataFrame([("a", "A", "code", "s", 0), ("a", "A", "code", "s", 0), ("b", "B", "code", "s", 0)], NODE)
    e = spark.createDataFrame([(s, t, k, r, "EXTRACTED", None, 1.0, x, "f") for s, t, k, r, x in [("a", "b", "1", "r", None), ("b", "a", "2", "r", "x"), ("a", "b", "3", "q", "x"), ("a", "a", "4", "r", None), (None, "a", "5", "r", None), ("a", None, "6", "r", None), ("z", "b", "7", "r", None), (" ", "b", "8", "r", None), ("z", "z", "9", "r", None)]], EDGE)
    got = topology.collapse_risk(n, e).first().asDict()
    # a node that is there twice doesn't make its edges more
    assert got == {"edges": 9, "dangling": 5, "self_loops": 2, "directed_pairs": 8, "directed_collapse": 1, "parallel_groups": 1, "relation_groups": 1, "confidence_groups": 0, "context_groups": 0, "largest_group": 2, "undirected_pairs": 5, "undirected_collapse": 4}
    bad = rows(merge.violations(n, e), "rule", "subject")
    assert [x for x in bad if x[0].startswith("dangling")] == [("dangling source", "z"), ("dangling source", "z"), ("dangling target", "z")]
    assert merge.same_topology(e, e.repartition(2), ["source", "target", "context"]) and not merge.same_topology(e, e.union(e.limit(1)), ["source", "target", "context"])


def test_diagnostics_and_validation_do_not_shuffle_the_edges_more_than_once(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c")])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(topology.collapse_risk(n, e)).count("Exchange hashpartitioning") == 1
    p = plan(merge.violations(n, e))
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p


def test_files_are_matched_once_a_path(spark):
    r = spark.createDataFrame([(i, ["repo/src/a.py", "repo/src/a.py", None, ""] if i % 2 else ["b.py", "src/a.py"]) for i in range(1, 7)], "number long, files array<string>")
    n = spark.createDataFrame([("x", "src/a.py", 1), ("y", "lib/b.py", 2), ("z", "lib/b.py", None)], "id string, source_file string, community int")
    assert rows(impact.conflicts(r, n), "community", "n", "first", "last") == [(1, 6, 1, 6), (2, 3, 2, 6)]


def test_label_rounds_equal_their_definition(spark):
    import random

    pick = random.Random(2)
    pairs = sorted({tuple(sorted(pick.sample([f"v{i:02d}" for i in range(40)], 2))) for _ in range(70)})
    n, e = graph(spark, pairs)
    turn = {r.id: r.t for r in n.selectExpr("id", "pmod(xxhash64(id), 2) t").collect()}
    label, near = {x: x for x in turn}, {x: [b if a == x else a for a, b in pairs if x in (a, b)] for x in turn}
    for i in range(12):
        votes = {x: {} for x in near}
        for x, ys in near.items():
            for y in ys:
                votes[x][label[y]] = votes[x].get(label[y], 0) + 1
        new = {x: min(v, key=lambda c: (-v[c], c)) if turn[x] == i % 2 else label[x] for x, v in votes.items()}
        if i % 2 and new == label:
            break
        label = new
    groups = {}
    for x in sorted(label):
        groups.setdefault(label[x], []).append(x)
    want = {x: k for k, g in enumerate(sorted(groups.values(), key=lambda g: (-len(g), g))) for x in g}
    assert dict(rows(community.communities(n, e, method="labels"), "id", "community")) == want


def test_trigrams_are_made_without_a_shuffle(spark):
    from tessella.operators import answers

    n, _ = graph(spark, [("alpha", "beta")])
    index = answers.trigrams(n)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    twice = n.union(n)
    assert rows(answers.candidates(twice, answers.trigrams(twice), ["alpha", "bet"], 2.0), "id") == [("alpha",), ("beta",)]
