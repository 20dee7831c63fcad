"""Queries that read whole tables, against their SQL freed of id subsets and caps on rows, and against brute force."""

from __future__ import annotations

import duckdb
import pytest

from turnmill.plans import docs, graph, registry

DATA = "/root/testdata/sf0.01"
CUTS = (" WHERE l_orderkey % 20 = 0", " WHERE p_partkey <= 480", " WHERE p_partkey <= 600", " WHERE p_partkey <= 1000")
GRAPH = "u1_distinct_edges j10_edges_within j11_dangling_ends j12_orphans a20_degrees a22_merged_candidates a23_merged_relations j18_one_hop j20_card_edges j21_merged_graphs j22_related_entities f8_visible_graph u3_label_jaccard x27_lane_layout".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def check(spark, duck, name, cuts):
    """Every row of the SQL without its cuts, in the query's columns."""
    sql = registry.ORACLE_SQL[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    df = registry.QUERIES[name](spark, DATA)
    plain = lambda x: f"{x:.8g}" if isinstance(x, float) else str(x)
    got = [[plain(x) for x in r] for r in df.collect()]
    want = [[plain(x) for x in r] for r in duck.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()]
    assert sorted(got) == sorted(want)
    return got


@pytest.mark.parametrize("name", GRAPH)
def test_graph(spark, duck, name):
    check(spark, duck, name, CUTS)


def test_last_ids_count(spark):
    lines = spark.createDataFrame([(1, 7, 1, 1, "A", "O", 0.1), (21, 7, 1, 1, "A", "O", 0.2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double")
    parts = spark.createDataFrame([(7, "a", "T", 1, 1.0), (5000, "b", "T", 1, 1.0)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")
    read = {"lineitem": lines, "part": parts}.__getitem__
    assert sorted(map(tuple, graph.degrees(read).collect())) == [(7, 2), (5000, 0)]


def test_edges_within_all_nodes(spark):
    """Edges of early nodes count; those with an end that is no node don't."""
    lines = spark.createDataFrame([(1, 7, 3, 1, "A", "O", 0.1), (2, 7, 8, 1, "A", "O", 0.1), (3, 6, 3, 1, "A", "O", 0.1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double")
    parts = spark.createDataFrame([(7, "a", "T", 1, 1.0), (4, "b", "T", 10, 1.0)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")
    assert [tuple(r) for r in graph.edges_within({"lineitem": lines, "part": parts}.__getitem__).collect()] == [(11, 7, 4)]


def test_alike_classes_lose_no_link(spark):
    """Members and pairs of classes tell all pairs of rows; copies add one row each, texts of the same characters stay apart."""
    from itertools import combinations

    from turnmill.operators.graph import alike_classes

    texts = ["red ring", "red ring", "ring red", "blue bolt", "red rings", "", "", None, "xyz", "red ring"] * 3
    rows = [(i, "B" if i % 7 == 3 else "A", t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in alike_classes(spark.createDataFrame(rows, "id long, block string, text string")).collect()]
    of = {b: a for kind, a, b, _ in got if kind == "member"}
    links = {(a, b) for kind, a, b, _ in got if kind == "pair"}
    told = {(i, j) for i, j in combinations(range(len(rows)), 2) if of[i] == of[j] or tuple(sorted((of[i], of[j]))) in links}
    alike = lambda a, b: 10 * len(a & b) > 7 * len(a | b)
    chars = lambda t: set(t) or {""}
    want = {(i, j) for (i, x, s), (j, y, t) in combinations(rows, 2) if x == y and s is not None and t is not None and alike(chars(s), chars(t))}
    assert told == want and len(of) == len(rows) and len(links) < 12


def test_alike_parts_are_told_pair_by_pair(spark):
    """Copies are pairs as others are; parts of another type or without a name are in none."""
    parts = spark.createDataFrame([(4, "red ring", "T"), (2, "red ring", "T"), (9, "ring red", "T"), (5, "red rings", "T"), (6, "red ring", "U"), (7, None, "T"), (8, "blue bolt", "T")], "p_partkey long, p_name string, p_type string")
    got = {(r["a"], r["b"]): r["similarity"] for r in graph.label_jaccard({"part": parts}.__getitem__).collect()}
    assert got == {(2, 4): 1.0, (2, 9): 1.0, (4, 9): 1.0, (2, 5): 0.875, (4, 5): 0.875, (5, 9): 0.875}


def test_alike_pairs_of_large_classes(spark, monkeypatch):
    """All pairs against brute force where classes are cut into chunks and these dealt into parts; ids that repeat count as often as they are."""
    from itertools import combinations

    from turnmill.operators import graph as operators

    monkeypatch.setattr(operators, "CHUNK_ROWS", 4)
    monkeypatch.setattr(operators, "TASK_PAIRS", 200)
    texts = ["red ring", "ring red", "blue bolt", "red rings", "", None, "xyz", "red ring"]
    rows = [(None if i % 23 == 5 else i - i % 19 // 18, None if i % 13 == 6 else "B" if i % 7 == 3 else "A", texts[i * i % 8 if i < 40 else 0]) for i in range(90)]
    df = operators.alike_pairs(spark.createDataFrame(rows, "id long, block string, text string"))
    chars = lambda t: set(t) or {""}
    whole = [(i, x, chars(t)) for i, x, t in rows if None not in (i, x, t)]
    want = [(min(i, j), max(i, j), round(len(s & t) / len(s | t), 6)) for (i, x, s), (j, y, t) in combinations(whole, 2) if x == y and i != j and 10 * len(s & t) > 7 * len(s | t)]
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 1000
    assert df.rdd.getNumPartitions() > 5


def test_sums_of_all_documents(spark, duck):
    check(spark, duck, "a30_memory_chars", [" WHERE doc_id < 100"])
    check(spark, duck, "a15_filled_seeds", [" FILTER (doc_id % 40 = 0)"])
    rows = spark.createDataFrame([(141, "abc", "s", 3), (143, "de", "s", 2), (145, None, "empty", None), (147, "", "empty", 0)], "doc_id long, text string, source string, n_chars int")
    assert sorted(map(tuple, docs.filled_seeds(lambda _: rows).collect())) == [("empty", 5768), ("s", 5)]
    assert sorted(map(tuple, docs.memory_chars(lambda _: rows).collect())) == [("empty", 0), ("s", 5)]


def test_sorts_keep_every_row(spark, duck):
    assert len(check(spark, duck, "o1_newest_sessions", [" LIMIT 100"])) == duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    placed = check(spark, duck, "o3_sorted_nodes", [" WHERE p_size <= 5", " LIMIT 100"])
    assert [int(r[1]) for r in placed] == list(range(1, duck.execute("SELECT count(*) FROM part").fetchone()[0] + 1))
    ranked = [(int(r[1]), int(r[0])) for r in check(spark, duck, "o4_type_ranked", [" LIMIT 200"])]
    assert ranked == sorted(ranked) and len(ranked) == len(placed)


def test_best_lines(spark):
    plain = [f"a plain line without a finding, long and of number {i} " + "x" * 60 for i in range(12)]
    good = ["结论: the cache was stale, so the build failed", "- 建议先验证这个方案,然后再修复其余的问题部分。", "结论: the cache was stale, so the build failed"]
    many = [f"结论: finding of number {i}, told in a line" for i in range(12)]
    texts = {1: [*plain, *good], 2: plain, 3: ["", "", "  - 建议先验证这个方案,然后再修复其余的问题部分。"], 4: many, 5: [" ", ""], 6: ["short"]}
    rows = spark.createDataFrame([(i, "\r\n".join(t)) for i, t in texts.items()] + [(7, None)], "doc_id long, text string")
    got = sorted(map(tuple, docs.best_lines(lambda _: rows).collect()), key=str)
    assert got == sorted([(1, 12), (1, 13), (2, None), (3, 2), *((4, i) for i in range(10)), (6, None)], key=str)


def test_best_lines_read_texts_once(spark):
    """One scan, and no cleaning repeated in a filter; ends of lines and the eleventh line come right."""
    texts = [(1, "\u00a0\r\n  short line without marks, but a sign;  \r\n" + "\n".join(f"* 结论: finding of number {i}, told in a line" for i in range(12))), (2, "x" * 20 + " \n\t;\x0b"), (3, " \r\n\t")]
    best = docs.best_lines(lambda _: spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, best.collect()), key=str) == sorted([*((1, i) for i in range(2, 12)), (2, None)], key=str)
    plan = docs.best_lines(lambda t: spark.read.parquet(f"{DATA}/{t}.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("regexp_replace") <= 1
