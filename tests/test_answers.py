"""Path answers, candidate index, library, fragment rules, and bounds that refuse instead of switching."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import answers, community, entity, library, rank, traverse
from tessella.plans import materialize


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("a", "Parser core", "src/p.py"), ("b", "Lexer", "src/l.py"), ("c", "Emitter", "src/e.py"), ("d", "Parser core 2", "src/q.py"), ("e", "lone", "src/z.py"), ("p", "p.py", "src/p.py")]
    edges = [("a", "b", "calls", "EXTRACTED", 1.0, "src/p.py", "", "1"), ("b", "a", "uses", "INFERRED", 0.5, "src/l.py", "", "2"), ("b", "c", "calls", "EXTRACTED", 1.0, "src/l.py", "", "3"), ("d", "c", "calls", "EXTRACTED", 1.0, "src/q.py", "", "4")]
    n = spark.createDataFrame(nodes, "id string, label string, source_file string").withColumn("file_type", F.lit("code")).withColumn("community", F.lit(0))
    return n, spark.createDataFrame(edges, "source string, target string, relation string, confidence string, confidence_score double, source_file string, context string, key string")


def said(df):
    return [r.line for r in df.orderBy("pos").collect()]


def test_path_answers(small):
    n, e = small
    assert said(answers.path_answer(n, e, "parser core 2", "lexer")) == ["Parser core 2 --calls-- Emitter", "Emitter --calls-- Lexer"]
    hop = said(answers.path_answer(n, e, "a", "lexer"))
    assert len(hop) == 1 and "2 total" in hop[0] and "calls" in hop[0] and "uses" in hop[0]
    assert said(answers.path_answer(n, e, "nowhere", "lexer")) == ["No node matches the source 'nowhere'."]
    assert "same" in said(answers.path_answer(n, e, "lexer", "LEXER"))[0] or "more specific" in said(answers.path_answer(n, e, "lexer", "LEXER"))[0]
    assert said(answers.path_answer(n, e, "lone", "lexer"))[-1] == "No path of at most 8 hops."
    assert said(answers.path_answer(n, e, "core", "lexer"))[0].startswith("Warning: the source 'core' is ambiguous")
    assert said(answers.path_answer(n, e, "parser core 2", "lexer", max_hops=1))[-1] == "No path of at most 1 hops."


def test_the_index_gives_what_a_scan_gives(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta"]
    rows = [(f"n{i}", " ".join(rng.sample(words, 2)) + (" rare" if i % 50 == 0 else ""), f"src/{rng.choice(words)}.py") for i in range(150)]
    n = spark.createDataFrame(rows, "id string, label string, source_file string")
    index = answers.trigrams(n)
    for q in (["rare"], ["alpha"], ["rare", "zeta"], ["al"], ["nothing"]):
        want = {(r.id, round(r.score, 9)) for r in rank.score_nodes(n, q).collect()}
        assert {(r.id, round(r.score, 9)) for r in answers.score_by_index(n, index, q).collect()} == want
    assert answers.candidates(n, index, ["al"]) is None and answers.candidates(n, index, ["alpha"]) is None
    found = {r.id for r in answers.candidates(n, index, ["rare"]).collect()}
    assert found == {"n0", "n50", "n100"} and answers.candidates(n, index, ["nothing"]).count() == 0


def test_the_file_itself_is_preferred(small):
    n, _ = small
    assert answers.preferred_file(n, n.where("source_file = 'src/p.py'").select("id"), "src/p.py") == "p"
    assert answers.preferred_file(n, n.where("id in ('a', 'b')").select("id"), "src/x.py") is None


def test_library_skips_and_shares(spark):
    n = spark.createDataFrame([("x", "X", "x.py"), ("lib", "numpy", None)], "id string, label string, source_file string")
    e = spark.createDataFrame([("x", "lib", "imports", "")], "source string, target string, relation string, key string")
    lib, entries, did = library.add_repo(None, {}, "one", n, e)
    assert did == {"repo": "one", "added": 2, "removed": 0, "skipped": False}
    lib, entries, did = library.add_repo(lib, entries, "two", n, e)
    assert did["added"] == 1 and {tuple(r.owners) for r in lib[0].where("label = 'numpy'").collect()} == {("one", "two")}
    assert {(r.source, r.target) for r in lib[1].collect()} == {("one::x", "one::lib"), ("two::x", "one::lib")}
    assert library.add_repo(lib, entries, "two", n, e)[2]["skipped"]
    changed = n.union(spark.createDataFrame([("y", "Y", "y.py")], n.schema))
    lib, entries, did = library.add_repo(lib, entries, "two", changed, e)
    assert did == {"repo": "two", "added": 2, "removed": 1, "skipped": False}
    lib, entries, gone = library.remove_repo(lib, entries, "one")
    assert gone == 1 and {r.id for r in lib[0].collect()} == {"one::lib", "two::x", "two::y"} and list(entries) == ["two"]
    with pytest.raises(KeyError):
        library.remove_repo(lib, entries, "one")


def test_endpoints_and_json():
    names = {"a.example": ["127.0.0.1", "::1"], "b.example": ["10.0.0.1"], "c.example": ["8.8.8.8"], "d.example": ["127.0.0.1", "8.8.8.8"], "e.example": ["10.0.0.1", "8.8.8.8"]}
    found = [library.endpoint_class(f"https://{h}/x", lambda h: names[h]) for h in names]
    assert found == ["loopback", "private", "public", "mixed", "mixed"]
    assert library.endpoint_class("managed://x") == "managed" and library.endpoint_class("no host") == "unresolved" and library.endpoint_class("http://0.0.0.0") == "wildcard"
    assert library.endpoint_class("http://[::1]:80") == "loopback" and library.endpoint_class("http://unknown.example") == "unresolved"
    assert library.canonical_json({"b": [1, None], "a": {"z": "é", "y": 0.5}}) == '{"a":{"y":0.5,"z":"é"},"b":[1,null]}'
    with pytest.raises(ValueError):
        library.canonical_json(float("nan"))
    assert library.clean_metadata({"k\n": ["a\x00b", 3, {"x": "y" * 300}]}) == {"k": ["ab", 3, {"x": "y" * 256}]}


def test_legacy_ids(spark):
    schema = "id string, source_file string"
    assert library.legacy_ids(spark.createDataFrame([("mod_run", "pkg/mod.py")], schema))
    assert not library.legacy_ids(spark.createDataFrame([("pkg_mod_run", "pkg/mod.py")], schema))


def test_communities_refuse_instead_of_switching(spark):
    rows = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i, j in itertools.combinations(range(4 if g != "c" else 3), 2)]
    e = spark.createDataFrame([(*r, 1.0, "EXTRACTED", "r", "", "", "") for r in rows], "source string, target string, confidence_score double, confidence string, relation string, source_file string, context string, key string")
    n = spark.createDataFrame(sorted({(x,) for r in rows for x in r} | {("lone",)}), "id string")
    with pytest.raises(ValueError, match="labels"):
        community.communities(n, e, local=3)
    with pytest.raises(ValueError):
        community.communities(n, e, method="labels", resolution=2.0)
    want = {**{f"a{i}": 0 for i in range(4)}, **{f"b{i}": 1 for i in range(4)}, **{f"c{i}": 2 for i in range(3)}, "lone": 3}
    for method in ("modularity", "labels"):
        assert {r.id: r.community for r in community.communities(n, e, method=method).collect()} == want


def test_numbers_over_all_rows(spark):
    df = spark.range(1000).selectExpr("id % 37 as k", "id").repartition(7)
    got = [(r.k, r.id, r.number) for r in community.numbered(df, F.desc("k"), "id").collect()]
    order = sorted(((r.k, r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(*x, i) for i, x in enumerate(order)]


def test_betweenness_looks_only_at_its_nodes(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "x"), ("x", "a"), ("y", "z")], "source string, target string")
    assert {r.id: r.score for r in community.betweenness(n, e)[0].collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert community.betweenness(n, e, sample=2)[0].agg(F.sum("score")).first()[0] >= 0
    with pytest.raises(ValueError):
        community.betweenness(n, e, most_pairs=1)


def test_cycles_equal_brute_force(spark):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(40)} | {("in", "n1"), ("n2", "out")}
    want = set()
    names = sorted({x for p in pairs for x in p})
    for k in range(1, 6):
        for c in itertools.permutations(names, k):
            if c[0] == min(c) and all((c[i], c[(i + 1) % k]) in pairs for i in range(k)):
                want.add((k, " > ".join(c)))
    found = traverse.cycles(spark.createDataFrame(sorted(pairs), "source string, target string"), 5, None).collect()
    assert {(r.length, r.nodes) for r in found} == want and len(found) == len(want)


def test_fuzzy_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    stems = [" ".join(rng.choice(["quantum", "harbour", "meadow", "lantern", "gravity", "velvet"]) for _ in range(3)) + f" {rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(60)]
    labels = sorted({*stems, *(s[:7] + s[8] + s[7] + s[9:] for s in stems[:30])})
    rows = [(f"n{i}", x, "concept", "a.md", i) for i, x in enumerate(labels)]
    cands = entity.candidates(spark.createDataFrame(rows, "id string, label string, file_type string, source_file string, pos int"))
    own = {r.id: r.norm for r in cands.collect()}
    bands = lambda t: {(i, entity.minhash_of(t)[i * entity.ROWS : (i + 1) * entity.ROWS].tobytes()) for i in range(entity.BANDS)}
    keys = {i: bands(t) for i, t in own.items()}
    want = {tuple(sorted((a, b), key=own.get)) for a, b in itertools.combinations(own, 2) if keys[a] & keys[b] and entity.accepted(*sorted((own[a], own[b])), True, False)}
    assert {(r.a, r.b) for r in entity.fuzzy_pairs(cands).collect()} == want and len(want) > 5


def test_scratch_needs_a_shared_folder_off_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        materialize.scratch(Session(), "x")
