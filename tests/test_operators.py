import math
import random

from pyspark.sql import functions as F

from stratalens.operators import graph as G
from stratalens.operators import maintain as M
from stratalens.operators import measure as A
from stratalens.operators import render as R
from stratalens.operators import search as X
from stratalens.operators import transcript as C

SYM, EDG = "path string, name string, kind string, line bigint", "from_path string, from_name string, to_name string, kind string, line bigint, to_path string"


def test_incremental_equals_rebuild(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    old = [(f"p{i % 6}", n, "function", i) for i, n in enumerate(names)]
    calls = [(f"p{rng.randrange(6)}", "f", rng.choice(names), "call", i, None) for i in range(40)]
    s, e = spark.createDataFrame(old, SYM), spark.createDataFrame(calls, EDG)
    new = [("p0", "n3", "function", 1), ("p0", "fresh", "function", 2)]  # n3 has now two definers, p0's old names are gone
    new_e = [("p0", "f", "n1", "call", 1, None)]
    changed = spark.createDataFrame([("p0",)], "path string")
    s2, e2, refresh = M.sync(s, G.resolve(e, s), spark.createDataFrame(new, SYM), spark.createDataFrame(new_e, EDG), changed)
    full = spark.createDataFrame([x for x in old if x[0] != "p0"] + new, SYM)
    again = G.resolve(spark.createDataFrame([c for c in calls if c[0] != "p0"] + new_e, EDG), full)
    cols = ["from_path", "from_name", "to_name", "kind", "line", "to_path"]
    assert sorted(map(tuple, e2.select(cols).collect()), key=str) == sorted(map(tuple, again.select(cols).collect()), key=str)
    assert sorted(map(tuple, s2.select("path", "name").collect())) == sorted(map(tuple, full.select("path", "name").collect()))
    assert "p0" in {r["path"] for r in refresh.collect()}


def test_lost_and_queue(spark):
    old, new = spark.createDataFrame([("a", "K.m", "method", 1)], SYM), spark.createDataFrame([("a", "K.n", "method", 1)], SYM)
    assert sorted(r["name"] for r in M.lost(old, new).collect()) == ["K.m", "m"]
    files = spark.createDataFrame([("a", "s1", 80, "x"), ("b", "s2", 80, "bad"), ("c", "s3", 2, "z")], "path string, sha256 string, line_count int, text string")
    cache = spark.createDataFrame([("a", "old", "s")], "path string, sha256 string, summary string")
    todo = M.queue(files, cache, 50)
    assert sorted(r["path"] for r in todo.collect()) == ["a", "b"]
    got = M.summarize(todo, lambda t: 1 / 0 if t == "bad" else t.upper()).collect()
    assert [(r["path"], r["summary"]) for r in got] == [("a", "X")]


def test_gate_forms_agree(spark):
    """The segment form of the import gate equals the pattern form on names without pattern signs."""
    rng = random.Random(5)
    words = ["a", "b", "cc", "d"]
    sym = [(f"p{i}", rng.choice(["F", "K.m", "L.m"]), "function", i) for i in range(8)]
    edg = [(f"p{rng.randrange(8)}", "f", rng.choice(["F", "m", "K.m"]), "call", i, None) for i in range(30)] + [(f"p{rng.randrange(8)}", "f", ".".join(rng.choices([*words, "K"], k=rng.randrange(1, 4))), "import", i, None) for i in range(12)]
    stems = {f"p{i}": rng.choice(words) for i in range(8)}
    got = {tuple(r) for r in G.gated_callers(spark.createDataFrame(sym, SYM), spark.createDataFrame(edg, EDG), spark.createDataFrame(list(stems.items()), "path string, stem string")).collect()}
    want = set()
    for p, n, _, _ in sym:
        for f, _, t, k, _, _ in edg:
            if k != "call" or f == p:
                continue
            imports = [x[2].lower() for x in edg if x[3] == "import" and x[0] == f]
            stem, cls = stems[p].lower(), n.split(".")[0].lower() if "." in n else None
            gate = any(i == stem or i.endswith("." + stem) or i.startswith(stem + ".") or f".{stem}." in i or cls and (i == cls or i.endswith("." + cls)) for i in imports)
            if t == n.rsplit(".", 1)[-1] and gate or "." in n and t == n:
                want.add((p, n, f))
    assert got == want


def test_search_never_fails(spark):
    docs = spark.createDataFrame([(1, "Parse header of the file"), (2, "header parse"), (3, None)], "id int, t string")
    ix = X.index(docs, "id", "t")
    hits = lambda q: sorted(r["path"] for r in X.search(ix, q).collect())
    assert hits("parse header") == [1, 2] and hits('"parse header"') == [1] and hits("parse_header") == [1]
    assert hits("pars*") == [1, 2] and hits("^header") == [2] and hits("header NOT file") == [2] and hits("file OR zzz") == [1]
    assert hits("content:file") == [1] and hits("path:file") == [] and hits("(file OR header) AND of") == [1]
    assert hits("NEAR(parse file, 1)") == [] and hits("NEAR(parse file, 3)") == [1]
    for odd in ("", '"', "a AND", "foo:bar", "(", "*", "a - b", ")(", "NEAR(", "^", "+"):
        hits(odd)
    s = X.search(ix, "header").select("path", "snippet").collect()
    assert {r["path"]: r["snippet"] for r in s}[2] == "<<header>> parse"


def grep_text(n):
    return "\n".join(f"src/f{i % 3}.py:{i}: hit {i}" for i in range(n))


def test_bound_grep(spark):
    f = lambda t: spark.createDataFrame([(t,)], "t string").select(C.bound_grep(F.col("t")).alias("b")).first()["b"]
    out = f(grep_text(60))
    assert out.startswith("grep: 60 matches in 3 files\nsrc/f0.py\n  0: hit 0") and "(+12 more matches in this file)" in out
    assert f("some prose\nwithout hits") is None and f("a.py:1:x\n" + "prose line\n" * 10) is None
    assert f("a.py:1:x\na.py-2-ctx\n\na.py-3-ctx\na.py-4-c\n") is not None and f("a.py:1:x\n" + "other-2-note\n" * 9) is None
    many = "\n".join(f"f{i}.py:1:x" for i in range(50))
    assert f(many).endswith("(+10 more files, 10 matches)")


def test_bound_results(spark):
    long_list = "\n".join(f"src/mod{i % 4}/file_{i}.py" for i in range(100))
    calls = spark.createDataFrame([(1, "a", "grep", {"x": "y"}), (1, "b", "ls", {"x": "y"}), (1, "c", "grep", {"x": "y"}), (1, "c", "ls", {"x": "y"}), (1, "d", "Weird", {"x": "y"})], "conv_id int, id string, name string, input map<string,string>")
    rows = [(1, 0, 0, "a", grep_text(200)), (1, 1, 0, "b", long_list), (1, 2, 0, "c", grep_text(200)), (1, 3, 0, "d", grep_text(200)), (1, 4, 0, "a", "short"), (1, 5, 0, "a", grep_text(200))]
    results = spark.createDataFrame(rows, "conv_id int, turn int, idx int, id string, text string")
    central = spark.createDataFrame([("src/mod3/file_99.py", 7)], "path string, called_by bigint")
    bound = lambda r: C.bound_results(r, calls, central, keep_fresh=1).select(*results.columns)
    once = bound(results)
    got = {r["turn"]: r["text"] for r in once.collect()}
    assert got[0].startswith("⟪bounded:grep⟫\ngrep: 200 matches") and got[1].startswith("⟪bounded:ls⟫\nlisting: 100 paths, 4 dirs")
    assert "file_99.py  ·7 callers" in got[1] and got[1].endswith("(+40 more paths)")
    assert [got[t] for t in (2, 3, 4, 5)] == [rows[t][4] for t in (2, 3, 4, 5)]
    assert {r["turn"]: r["text"] for r in bound(once).collect()} == got


def test_classify(spark):
    calls = spark.createDataFrame([(1, "a", "Read", {"file_path": "big"}), (1, "b", "read_file", {"path": "small"}), (1, "c", "index_search", {}), (2, "d", "View", {"filename": "big"}), (2, "e", "Read", {})], "conv_id int, id string, name string, input map<string,string>")
    files = spark.createDataFrame([("big", 51), ("small", 50)], "path string, line_count int")
    seen = spark.createDataFrame([(2, "big")], "conv_id int, path string")
    got = {r["id"]: (r["kind"], r["path"]) for r in C.classify(calls, files, seen, 50).collect()}
    assert got == {"a": ("gated", "big"), "b": ("host", None), "c": ("virtual", None), "d": ("host", None), "e": ("host", None)}


def test_measures(spark):
    v = spark.createDataFrame([(True, False)] * 10 + [(False, True)] * 2 + [(True, True)], "control boolean, treatment boolean")
    r = A.with_p_value(A.contingency(v)).first()
    assert r["statistic"] == round((8 - 1) ** 2 / 12, 6) and 0.04 < r["p_value"] < 0.05
    xs = [0.0, -1.0, 1e-9, 0.5, 3.84, 6.63, 25.0, 59.9, 60.1, 500.0]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(A.survival(F.col("x")).alias("p")).collect()]
    assert all(abs(p - (1 if x <= 0 else math.erfc(math.sqrt(x / 2)))) < 1e-12 for p, x in zip(got, xs))
    assert A.contingency(v.where("control and treatment")).first()["statistic"] == 0


def test_unique_names(spark):
    rows = [("p", i, n, i) for i, n in enumerate(["Foo", "Foo #2", "Foo", "Foo", ""])]
    got = R.unique_names(spark.createDataFrame(rows, "path string, idx int, label string, line bigint")).orderBy("idx").collect()
    assert [r["name"] for r in got] == ["Foo", "Foo #2", "Foo #3", "Foo #4", "section-4"]


def test_edits_in_order(spark):
    files = spark.createDataFrame([("a", "x y x"), ("b", "one two"), ("c", None)], "path string, text string")
    edits = [("a", 1, "x", "z"), ("a", 2, "y", "w"), ("a", 3, "w", ""), ("b", 1, "one", "two"), ("b", 2, "two", "q"), ("b", 3, "two two", "end"), ("c", 1, "a", "b"), ("d", 1, "a", "b"), ("b", 4, "", "q")]
    out = M.apply_edits(files, spark.createDataFrame(edits, "path string, seq int, old string, new string"))
    assert sorted((r["path"], r["seq"], r["outcome"]) for r in out.collect()) == [("a", 1, "ambiguous"), ("a", 2, "edited"), ("a", 3, "edited"), ("b", 1, "edited"), ("b", 2, "ambiguous"), ("b", 3, "edited"), ("b", 4, "not found"), ("c", 1, "not found"), ("d", 1, "no file")]
    assert {r["path"]: r["text"] for r in M.edited(out).collect()} == {"a": "x  x", "b": "end"}


def test_reached_without_pairs(spark):
    """Callers of files' names by blocks of bits, many and few to a name, against plain sets; centrality makes no row of a pair."""
    from stratalens.operators.reach import reached

    rng = random.Random(11)
    names = [f"n{i}" for i in range(9)]
    defined = [(p, n) for p in range(40) for n in rng.sample(names, 1 + p % 4)] + [(99, "uncalled")]
    calls = sorted({(names[0], c) for c in range(300)} | {(rng.choice(names), rng.randrange(300)) for _ in range(200)} | {("unknown", 7)})
    of = {n: {c for m, c in calls if m == n} for n, _ in calls}
    want = {p: len(set().union(*(of.get(n, set()) for q, n in defined if q == p)) - {p}) for p, _ in defined}
    d, c = spark.createDataFrame(defined, "path bigint, name string"), spark.createDataFrame(calls, "name string, caller bigint")
    for sizes in ({}, {"block": 70, "group": 9}, {"entries": 40, "group": 1000}):
        assert {r["path"]: r["n"] for r in reached(d, c, **sizes).collect()} == want
    sym, edg = d.selectExpr("path", "name", "'method' AS kind", "1L AS line"), c.selectExpr("caller AS from_path", "'f' AS from_name", "name AS to_name", "'call' AS kind", "1L AS line")
    out = G.centrality_by_name(sym, sym, edg)
    assert {r["path"]: r["called_by"] for r in out.collect()} == want
    few = sym.where("path in (3, 99)").select("path").distinct()
    assert {r["path"]: r["called_by"] for r in G.centrality_of(few, sym, edg).collect()} == {3: want[3], 99: 0}
    assert "NOT (from_path" not in out._jdf.queryExecution().optimizedPlan().toString()  # no join that pairs files and callers


def test_centrality_of_the_pool_only(spark):
    """What ranks a search is made for the paths of its pool, not for all."""
    ix = X.index(spark.createDataFrame([(i, "the cat" if i % 2 else "dog") for i in range(10)], "path bigint, t string"), "path", "t")
    asked = []

    def centrality(pool):
        asked.extend(sorted(r["path"] for r in pool.collect()))
        return pool.where("path > 4").selectExpr("path", "path % 4 AS called_by")

    out = X.search(ix, "the", centrality, limit=3, pool=4).select("path", "called_by").collect()
    assert asked == [1, 3, 5, 7] and [tuple(r) for r in out] == [(7, 3), (5, 1), (1, 0)]


def test_impact_and_first_callers_without_pairs(spark):
    """Counts and first callers equal those of the pairs; neither joins definers of a name with its callers."""
    rng = random.Random(7)
    names = ["F", "G", "K.m", "L.m", "L.n", "M.x"]
    sym = sorted({(p, rng.choice(names)) for p in range(30) for _ in range(4)})
    calls = {(rng.randrange(40), "f", rng.choice([*names, "m", "n", "x"]), "call") for _ in range(260)}
    imports = {(rng.randrange(40), "f", rng.choice([f"pkg.s{rng.randrange(30)}", "pkg.K", "pkg.L", "a.s3.b"]), "import") for _ in range(90)}
    s = spark.createDataFrame([(p, n, "method", 1) for p, n in sym], "path bigint, name string, kind string, line bigint")
    e = spark.createDataFrame(sorted(calls | imports), "from_path bigint, from_name string, to_name string, kind string").selectExpr("*", "1L AS line")
    stems = s.selectExpr("path", "concat('s', path) AS stem").distinct()
    pairs = G.gated_callers(s, e, stems).collect()
    of = {}
    for path, name, caller in pairs:
        of.setdefault((path, name), []).append(caller)
    totals = {p: len({c for (q, _), cs in of.items() if q == p for c in cs}) for p, _ in of}
    got = G.impact_counts(s, e, stems)
    assert {tuple(r) for r in got.collect()} == {(p, n, len(cs), totals[p]) for (p, n), cs in of.items()}
    first = G.first_callers(s, e, stems, 3)
    assert {(r["path"], r["name"]): (r["callers"], r["n"]) for r in first.collect()} == {k: (sorted(cs)[:3], len(cs)) for k, cs in of.items()}
    assert any(len(cs) > 3 for cs in of.values()) and len(totals) > 20


def test_tasks_grow_with_rows(spark, sf, monkeypatch):
    """Where tables are large, the graph's steps are dealt by rows to more tasks, and give the same."""
    from stratalens import session
    from stratalens.plans import model

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    s, e = model._symbols(spark, sf), model._edges(spark, sf)
    n = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert n(s) == 1 and n(e) == 3
    asked = s.selectExpr("path", "name AS asked")
    rows = lambda df: sorted(map(str, df.collect()))
    for many, few in ((G.symbol_detail(s, asked, 3000), G.symbol_detail(s, asked)), (G.callers(e, s, 9000), G.callers(e, s)), (M.lost(s.where("line % 2 = 0"), s, 3000), M.lost(s.where("line % 2 = 0"), s))):
        assert n(many) > n(few)
        assert rows(many) == rows(few)


def test_summaries_take_a_text_at_a_time(spark):
    """A model that fails, or has nothing to say, gives no row; texts come as Arrow, not as a batch of strings."""
    from stratalens.operators import maintain

    todo = spark.createDataFrame([(1, "a", "long text"), (2, "b", "bad"), (3, "c", "none"), (4, "d", None)], "path long, sha256 string, text string")
    out = maintain.summarize(todo, lambda t: None if t == "none" else t[:4] if t != "bad" else 1 // 0)
    assert [tuple(r) for r in out.collect()] == [(1, "a", "long")] and "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_callers_shuffle_no_row_of_the_result(spark, sf):
    """Exact and leaf calls come out of one group each, so nothing is dealt after names have met callers."""
    from stratalens.plans import catalog
    from stratalens.sources.versions import CLEANUP, kept

    plan = catalog.callers_exact_and_leaf(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "LeftAnti" not in plan
    e = spark.createDataFrame([("K.m", 1, "f"), ("m", 1, "f"), ("L.m", 2, "f"), ("m", 3, None), ("K.m", 3, None), ("m", 4, "g"), ("m", 4, "g")], "to_name string, from_path bigint, from_name string").selectExpr("*", "'call' AS kind")
    names = spark.createDataFrame([("K.m",), ("L.m",), ("m",), ("m",)], "name string")
    want = [("K.m", 1, "f", "exact"), ("L.m", 1, "f", "leaf"), ("L.m", 2, "f", "exact"), ("K.m", 3, None, "exact"), ("L.m", 3, None, "leaf"), ("K.m", 4, "g", "leaf"), ("L.m", 4, "g", "leaf"), *(("m", p, f, "exact") for p, f in ((1, "f"), (3, None), (4, "g")))]
    assert sorted(map(str, (tuple(r) for r in G.callers(e, names).collect()))) == sorted(map(str, want))
    old = spark.conf.get(CLEANUP, None)
    assert kept(e.groupBy("to_name").count(), "kept-test").count() == 3 and spark.conf.get(CLEANUP, None) == old


def test_stored_graph_index_is_opened_as_made(spark, sf):
    """Edges that are opened from their groups as they are read are those of the SQL, each once."""
    from stratalens.plans import model

    e = model.edges(spark, sf)
    assert e.count() == e.distinct().count() == model._edges(spark, sf).count() == model.resolved(spark, sf).count()
    groups = model.calls(spark, sf)
    assert groups.count() == groups.select("leaf", "from_path", "from_name").distinct().count()
    got = lambda df: sorted((r["leaf"], r["from_path"], r["from_name"], tuple(sorted(r["names"]))) for r in df.collect())
    assert got(groups) == got(G.grouped_calls(e))


def test_callers_are_stored_as_lists_of_short_numbers(spark):
    """A name's callers are dealt once and stored; what counts them reads no call again, and repeated calls change nothing."""
    from stratalens.operators.reach import listed

    calls = [(c, n) for n in range(5) for c in range(200) if (c * 7 + n) % (n + 2) == 0]
    e = spark.createDataFrame([(c, "f", f"n{n}") for c, n in calls * 2], "from_path bigint, from_name string, to_name string").selectExpr("*", "'call' AS kind")
    s = spark.createDataFrame([(p, f"n{p % 7}") for p in range(60)], "path bigint, name string")
    out = G.centrality_by_name(s, s, e)
    assert "to_name" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["path"]: r["called_by"] for r in out.collect()} == {p: len({c for c, n in calls if n == p % 7} - {p}) for p in range(60)}
    of = listed(s.select("name"), e.selectExpr("to_name AS name", "from_path AS caller"), block=30)
    assert of.blocks > 1 and dict(of.lists.dtypes)["at"] == "array<smallint>"
    assert {r["name"]: r["n"] for r in of.counts().collect()} == {f"n{n}": len({c for c, m in calls if m == n}) for n in range(5)}


def test_calls_of_pairs_are_looked_up_in_bits(spark):
    """Whether a caller calls each of a list of names, by blocks, names with many and few callers; impact joins no calls."""
    from stratalens.operators.reach import called, listed

    rng = random.Random(3)
    calls = {("n0", c) for c in range(300)} | {(f"n{rng.randrange(1, 9)}", rng.randrange(300)) for _ in range(160)}
    c = spark.createDataFrame(sorted(calls), "name string, caller bigint")
    of = listed(spark.createDataFrame([(f"n{i}",) for i in range(10)], "name string"), c, block=60)
    name = {r["id"]: r["name"] for r in of.names.collect()}
    rows = [(p, rng.randrange(310), rng.sample([-1, *name], p % 4)) for p in range(200)]
    out = called(spark.createDataFrame(rows, "path bigint, caller bigint, names array<bigint>"), of, group=20).collect()
    assert {r["path"]: r["hit"] for r in out} == {p: [(name.get(x), f) in calls for x in names] for p, f, names in rows if any(f == g for _, g in calls)}
    assert of.blocks > 1 and any(any(r["hit"]) for r in out)
    s = spark.createDataFrame([(p, f"K.n{p % 9}") for p in range(20)], "path bigint, name string").selectExpr("*", "'method' AS kind", "1L AS line")
    e = c.selectExpr("caller AS from_path", "'f' AS from_name", "name AS to_name", "'call' AS kind", "1L AS line").union(spark.sql("SELECT 7L, 'f', 'a.s0', 'import', 1L"))
    out = G.impact_counts(s, e, s.selectExpr("path", "concat('s', path) AS stem"))
    assert "to_name" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(0, "K.n0", 1, 1)]


def test_first_callers_read_no_call_again(spark, sf):
    """A summary's callers come of the stored lists: no call is shuffled in the plan that makes them."""
    from stratalens.plans import catalog

    s, e, stems = catalog._gate(spark, sf)
    out = G.first_callers(s, e, stems, 5)
    assert "to_name" not in out._jdf.queryExecution().optimizedPlan().toString()
    few = {(r["path"], r["name"]): (r["callers"], r["n"]) for r in out.collect()}
    of = {}
    for path, name, caller in catalog.import_gated_callers(spark, sf).collect():
        of.setdefault((path, name), []).append(caller)
    assert few == {k: (sorted(v)[:5], len(v)) for k, v in of.items()}


def test_pairs_are_dealt_to_tasks_by_their_number(spark):
    """Lists of callers meet definers and are opened last; a name of many pairs is several tasks, and gives the same rows."""
    from stratalens.operators.reach import listed

    calls = sorted({("K.m", c) for c in range(60)} | {(f"K.n{c % 3}", c) for c in range(30)})
    whole = [(p, n) for p in range(20) for n in ("K.m", f"K.n{p % 4}")]
    c, w = spark.createDataFrame(calls, "name string, from_path bigint"), spark.createDataFrame(whole, "path bigint, name string")
    of = listed(w.select("name"), c.selectExpr("name", "from_path AS caller"), block=25)
    want = sorted((p, n, f) for p, n in whole for m, f in calls if m == n and f != p)
    for task in (50, 1 << 27):
        assert sorted(map(tuple, G._met(w, of, task).collect())) == want
    sym, edg = w.selectExpr("*", "'method' AS kind", "1L AS line"), c.selectExpr("from_path", "'f' AS from_name", "name AS to_name", "'call' AS kind", "1L AS line")
    out = G.gated_callers(sym, edg, w.selectExpr("path", "concat('s', path) AS stem").distinct())
    assert "Generate explode(callers" in out._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, out.collect())) == want
