"""Hand-built graphs with known facts."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import shingle_hashes, shingles
from graphloom.operators import analytics as an
from graphloom.operators import filters as fl
from graphloom.operators import reports as rp
from graphloom.operators import retrieval as rt
from graphloom.operators import traverse as tr
from graphloom.operators import dedup as dd
from graphloom.operators.dedup import all_pairs, members, near_pairs, placed
from graphloom.plans import dsl
from graphloom.sources import scanners


def edges(spark, text, kind="calls"):
    return spark.createDataFrame([(*p.split(">"), kind, "ast_resolved") for p in text.split()], "src string, dst string, kind string, origin string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names.split()], "id string")


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_bfs_takes_the_shortest_way_and_breaks_ties(spark):
    rows = tr.bfs(edges(spark, "a>b a>c b>d c>d d>a"), ids(spark, "a"), "out", ["calls"], 3).collect()
    assert {(r.node, r.depth, r.parent) for r in rows} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")}
    assert [r.node for r in tr.bfs(edges(spark, "a>b"), ids(spark, "a"), "out", [], 3).collect()] == ["a"]


def test_paths_of_a_diamond(spark):
    found = tr.paths(edges(spark, "A>B B>D A>C C>D", "value_flow"), ids(spark, "A"), ids(spark, "D"), ["value_flow"], 3)
    assert sorted(r.path for r in found.collect()) == [["A", "B", "D"], ["A", "C", "D"]]


def test_components_of_two_triangles_with_a_bridge_and_a_hub(spark):
    e = edges(spark, "a>b b>c c>a d>e e>f f>d c>d hub>a")
    nodes = ids(spark, "a b c d e f hub")
    assert set(pairs(an.weak_components(nodes, e)).values()) == {"a"}
    strong = pairs(an.strong_components(nodes, e))
    assert strong == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "hub": "hub"}
    assert pairs(an.cycles(nodes, e)) == {"a": 3, "d": 3}


def test_k_core_of_a_clique_with_a_leaf(spark):
    e = edges(spark, "a>b a>c a>d b>c b>d c>d c>leaf c>c a>b")
    assert pairs(an.k_core(ids(spark, "a b c d leaf alone"), e)) == {"a": 3, "b": 3, "c": 3, "d": 3, "leaf": 1, "alone": 0}


def test_long_paths_and_rings(spark):
    n = 300
    names = [f"v{i:03d}" for i in range(n)]
    path = edges(spark, " ".join(f"{a}>{b}" for a, b in zip(names, names[1:])))
    ring = path.unionByName(edges(spark, f"{names[-1]}>{names[0]}"))
    nodes = ids(spark, " ".join(names))
    assert set(pairs(an.k_core(nodes, path)).values()) == {1} and set(pairs(an.k_core(nodes, ring)).values()) == {2}
    assert pairs(an.cycles(nodes, ring)) == {"v000": n} and an.cycles(nodes, path).count() == 0
    assert set(pairs(an.strong_components(nodes, path)).items()) == {(v, v) for v in names}


def test_reach_and_hierarchy_go_to_the_end(spark):
    names = [f"v{i:02d}" for i in range(70)]
    path = edges(spark, " ".join(f"{a}>{b}" for a, b in zip(names, names[1:])))
    assert {r.node for r in tr.reachable(path, ids(spark, "v00")).collect()} == set(names)
    up = tr.hierarchy(edges(spark, " ".join(f"{a}>{b}" for a, b in zip(names[:20], names[1:20])), "extends"), ids(spark, "v00"), ["extends"])
    assert {r.node for r in up.collect()} == set(names[1:20])


def test_distributed_forms_agree_with_those_in_one_task(spark):
    e = edges(spark, "a>b b>c c>a d>e e>f f>d c>d hub>a x>y")
    nodes = ids(spark, "a b c d e f hub x y alone")
    assert pairs(an.strong_components(nodes, e, small_edges=-1)) == pairs(an.strong_components(nodes, e))
    assert pairs(an.k_core(nodes, e, small_edges=-1)) == pairs(an.k_core(nodes, e))
    assert pairs(an.betweenness(nodes, e, small_edges=-1)) == pytest.approx(pairs(an.betweenness(nodes, e)))


def test_graphs_without_edges_to_solve(spark):
    e, nodes = edges(spark, "a>b b>c a>c c>d"), ids(spark, "a b c d")
    none, own = e.where("src = 'z'").withColumn("w", F.lit(1.0)), {v: v for v in "abcd"}
    for least in (-1, 1, 3):
        assert pairs(an.strong_components(nodes, e, small_edges=least)) == own
    assert pairs(an.strong_components(nodes, none)) == own and pairs(an.k_core(nodes, none)) == dict.fromkeys("abcd", 0)
    assert pairs(an.communities(nodes, none)) == own and pairs(an.spectral(nodes, none)) == own and set(pairs(an.betweenness(nodes, none)).values()) == {0.0}
    loops = spark.createDataFrame([(v, k) for k, v in enumerate("abcd")], "id string, loop int")
    assert pairs(rp.deepest_loops(loops, e)) == {"a": 6, "b": 6, "c": 5, "d": 3}


def test_paths_with_and_without_sinks(spark):
    e = edges(spark, "a>b b>c c>d a>c d>a c>e", "value_flow")
    every = {tuple(r.path) for r in tr.paths(e, ids(spark, "a"), None, ["value_flow"], 3).collect()}
    assert {tuple(r.path) for r in tr.paths(e, ids(spark, "a"), ids(spark, "d e"), ["value_flow"], 3).collect()} == {p for p in every if p[-1] in "de"}


def test_pagerank_sums_to_one_and_a_restart_reaches_only_its_own(spark):
    e = an.outgoing(edges(spark, "s>s1 s1>s2 u>u1"))
    nodes = ids(spark, "s s1 s2 u u1")
    assert sum(pairs(an.pagerank(nodes, e, rounds=10)).values()) == pytest.approx(1)
    walk = pairs(an.pagerank(nodes, e, rounds=10, seeds=ids(spark, "s")))
    assert walk["u"] == walk["u1"] == 0 and walk["s"] > walk["s2"] > 0


def test_betweenness_of_a_line(spark):
    assert pairs(an.betweenness(ids(spark, "a b c"), edges(spark, "a>b b>c"))) == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_text_matches_yield_to_better_evidence(spark):
    rows = [("x", "t", "text_matched"), ("y", "t", "ast_resolved"), ("z", "u", "text_matched"), ("w", "t", "")]
    kept = fl.suppress_text(spark.createDataFrame(rows, "src string, dst string, origin string"))
    assert {r.src for r in kept.collect()} == {"y", "z", "w"}


def test_scope_none_is_everything_and_an_empty_one_nothing(spark):
    n = ids(spark, "a b")
    assert n.where(fl.in_scope(F.col("id"), None)).count() == 2
    assert n.where(fl.in_scope(F.col("id"), [])).count() == 0


def test_field_clauses():
    assert fl.parse_fields("lang:go lang:rs foo pkg::T bogus:x kind:") == ({"lang": "rs"}, "foo pkg::T bogus:x kind:")
    with pytest.raises(ValueError):
        fl.parse_kinds("calls,nope", ["calls"])
    assert fl.parse_kinds(" Calls,,calls ", ["calls"]) == ["calls"]


@pytest.mark.parametrize("text", ["", "filter kind:x", "nodes | ", "nodes | traverse", "nodes | traverse bogus", "nodes | traverse calls up", "nodes | nodes", "nodes | filter", "nodes | jump", "nodes" + " | filter kind:a" * 5])
def test_malformed_pipelines(text):
    with pytest.raises(dsl.QueryError):
        dsl.parse(text)


def test_query_classes_and_pack():
    assert [rt.query_class(q) for q in ("", "src/a/b.go", "ValidateToken", "func Foo(x int)", "how are tokens validated")] == ["unknown", "path", "symbol", "signature", "concept"]
    assert rt.pack([("a", 5), ("b", 9), ("c", 4)], 10) == ["a", "c"]


def test_todo_marks(spark):
    files = spark.createDataFrame([("f", "x\n// TODO(alice)[2026-05-01]: mend it #PROJ-42\n")], "id string, text string")
    r = scanners.todos(files).first()
    assert (r.line, r.tag, r.assignee, str(r.due), r.ticket) == (2, "TODO", "alice", "2026-05-01", "PROJ-42")


def test_owners_last_rule_wins_and_coverage_skips_what_is_malformed(spark):
    files = spark.createDataFrame([("1", "src/a.go"), ("2", "docs/x.md")], "id string, path string")
    assert pairs(scanners.owners(files, [("*", "all"), ("/src/**", "core")])) == {"1": "core", "2": "all"}
    lines = spark.createDataFrame([("a.go:3.1,5.2 2 1",), ("junk",)], "value string")
    assert [tuple(r) for r in scanners.coverage(lines).collect()] == [("a.go", 3, 5, 2, 1)]


def test_clone_clusters_hold_every_document(spark):
    import random

    rng = random.Random(6)
    base = [[f"w{rng.randrange(200)}" for _ in range(60)] for _ in range(4)]
    near = [*base[0][:-1], "other"]
    tokens = [base[0], base[0], base[1], base[1], base[1], near, near, base[2], [], []]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in tokens]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id long, tokens array<string>").select("id", shingles(F.col("tokens")).alias("shingles"))
    linked = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    pairs, held = near_pairs(docs), members(docs)
    got = {r.id: (r.cluster, r.links) for r in placed(pairs, held).collect()}
    assert got == {i: (min([i, *linked[i]]), len(linked[i])) for i in range(len(sets))}
    assert {(r.a, r.b) for r in all_pairs(pairs, held).collect()} == {(0, 1), (2, 3), (2, 4), (0, 5), (5, 6)}


def test_sets_move_only_where_their_marks_allow_it(spark):
    import random

    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    tokens = [base, [*base[:-9], "x"], [*base[:-40], *"abcdefgh"], base[:150], base[:120] + [f"v{i}" for i in range(80)], base[:3], base[:3], []]
    docs = spark.createDataFrame(list(enumerate(tokens)), "id long, tokens array<string>")
    sets = [{tuple(t[k : k + 5]) for k in range(max(len(t) - 4, 1))} if t else set() for t in tokens]
    jac = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    true = {(i, j): jac(i, j) for i in range(7) for j in range(i + 1, 7)}
    for column in (shingles(F.col("tokens")), shingle_hashes(F.col("tokens"))):
        d = dd.keyed(docs.select("id", column.alias("shingles"), F.lit(None).cast("long").alias("length")))
        marks = dd.signatures(d)
        a, b = marks.select(*[F.col(c).alias(f"{c}_a") for c in marks.columns]), marks.select(*[F.col(c).alias(f"{c}_b") for c in marks.columns])
        most = {(r[0], r[1]): r[2] for r in a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", dd.most_similar(F.col("n_a"), F.col("n_b"), F.col("parity_a"), F.col("parity_b"))).collect()}
        assert set(most) == set(true) and all(most[p] >= v for p, v in true.items()) and most[0, 4] < 0.8
        want = {(i, j): pytest.approx(v) for (i, j), v in true.items() if v >= 0.8 and (i, j) != (5, 6)}
        assert {(r.a, r.b): r.similarity for r in near_pairs(d).collect()} == want == {(r.a, r.b): r.similarity for r in dd.stratified_pairs(d).collect()}
        index = dd.index_change(dd.band_index(d), removed=docs.where("id = 0").select("id"))
        found = {(r["query"], r.id) for r in dd.index_query(index, d, d).collect()}
        assert found == {p for i, j in want | {(5, 6): 1.0} for p in ((i, j), (j, i)) if p[1] != 0}


def test_frequent_shingles_are_counted_by_themselves(spark):
    docs = spark.createDataFrame([(i, ["all", f"own{i}", f"half{i % 2}", f"tenth{i % 10}"]) for i in range(40)], "id long, shingles array<string>")
    for cells in (1, 7, 1 << 20):
        assert pairs(dd.frequent_shingles(docs, 0.2, cells)) == {"all": 40, "half0": 20, "half1": 20}


def test_sketches_are_settled_where_items_share_every_cell(spark):
    rows = [(f"u{i}" if i else None, k % 3 == 0) for i in range(60) for k in range(i % 7 + 1)]
    items = spark.createDataFrame(rows, "item string, gone boolean")
    gone = items.where("gone")
    asked, table, less = items.select("item").distinct(), dd.sketch(items, "item", 8, 2), dd.sketch(gone, "item", 8, 2)
    true = {f"u{i}" if i else None: i % 7 + 1 for i in range(60)}
    assert pairs(dd.estimate(asked, "item", table, 8, 2)) != true
    assert pairs(dd.settled(dd.estimate(asked, "item", table, 8, 2), items, "item", width=8, depth=2)) == true
    left = dd.settled(dd.estimate(asked, "item", dd.decremented(table, less), 8, 2), items, "item", gone, 8, 2)
    assert pairs(left) == {v: n - -(-n // 3) for v, n in true.items()}


def test_cohesion_takes_in_all_others_of_the_batch(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(k, f"n{k % 4}", f"Brand#{k % 3}", "AB"[k % 7 == 0], k * k % 11, 1.0) for k in range(30)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r.cohesion for r in entry.queries()["signal_cohesion"](spark, str(tmp_path)).collect()}
    near = {a[0]: [1 / (1 + abs(a[4] - b[4])) for b in rows if b[0] != a[0] and b[3] == a[3]] for a in rows}
    assert got == {f"p{k}": pytest.approx(sum(v) / len(v), abs=1e-6) for k, v in near.items()}


def test_communities_by_resolution_and_spectral_halves(spark):
    blocks = [[f"g{g}{c}{i}" for i in range(4)] for g in range(4) for c in range(3)]
    rows = [(a, b, 1.0) for block in blocks for k, a in enumerate(block) for b in block[k + 1 :]]
    rows += [(blocks[k][0], blocks[k + 1][0], 1.0) for k in range(11) if k % 3 < 2] + [(blocks[3 * g][1], blocks[(3 * g + 3) % 12][1], 0.2) for g in range(4)]
    edges_ = spark.createDataFrame(rows, "src string, dst string, w double")
    nodes = ids(spark, " ".join(x for b in blocks for x in b))
    counts = [len(set(pairs(an.communities(nodes, edges_, g)).values())) for g in (0.1, 1.0, 2.0)]
    assert counts[0] < counts[1] <= counts[2] and counts[1] == 12
    two = [[f"{g}{i:02d}" for i in range(12)] for g in "ab"]
    cliques = [(a, b, 1.0) for block in two for k, a in enumerate(block) for b in block[k + 1 :]] + [("a00", "b00", 1.0)]
    halves = pairs(an.spectral(ids(spark, " ".join(two[0] + two[1])), spark.createDataFrame(cliques, "src string, dst string, w double")))
    assert {frozenset(v for v, c in halves.items() if c == k) for k in set(halves.values())} == {frozenset(two[0]), frozenset(two[1])}
