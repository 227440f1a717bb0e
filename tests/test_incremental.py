"""Incremental steps of the code graph against a rebuild."""

import random

import pytest

from stratalens.operators import graph as G
from stratalens.operators.incremental import BUCKET, CodeGraph

SYMBOLS, EDGES = "path string, name string, kind string, line bigint", "from_path string, from_name string, to_name string, kind string, line bigint"


class Tree:
    """Files with their symbols and edges, as a parser would give them."""

    def __init__(self, seed):
        self.rng, self.files = random.Random(seed), {}
        for i in range(40):
            self.write(f"f{i}")

    def write(self, path):
        names = [f"n{k}" for k in range(60)]
        syms = [(path, x, "function", k) for k, x in enumerate(self.rng.sample(names, self.rng.randrange(0, 5)))]
        self.files[path] = (syms, [(path, "g", self.rng.choice(names), self.rng.choice(["call", "import"]), k) for k in range(self.rng.randrange(0, 6))])

    def rows(self, paths, spark):
        s, e = ([r for p in paths if p in self.files for r in self.files[p][i]] for i in (0, 1))
        return spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(e, EDGES)


def edges(df):
    return sorted(map(tuple, df.select("from_path", "from_name", "to_name", "kind", "line", "to_path").collect()), key=repr)


def rebuilt(spark, tree):
    s, e = tree.rows(tree.files, spark)
    return G.resolve(e, s)


ALL_STEPS = (["f3", "f7"], ["new1"], ["f5"], ["f9", "gone"])


@pytest.mark.parametrize("buckets,steps", [(1, ALL_STEPS[:1]), (8, ALL_STEPS)])
def test_steps_equal_a_rebuild(spark, tmp_path, buckets, steps):
    """Edits, new files and deletions, one step after another."""
    tree = Tree(5)
    graph = CodeGraph.create(*tree.rows(tree.files, spark), f"file://{tmp_path}/g", buckets)
    assert edges(graph.relation("edges")) == edges(rebuilt(spark, tree))
    for changed in steps:
        before = rebuilt(spark, tree)
        for p in changed:
            if p == "f5":
                tree.files.pop(p)
            elif p != "gone":
                tree.write(p)
        paths = spark.createDataFrame([(p,) for p in changed], "path string")
        after = rebuilt(spark, tree)
        step = graph.step(paths, *tree.rows(changed, spark))
        want = {r[0] for d in (G.dependents(before, paths), G.dependents(after, paths)) for r in d.collect()} | set(changed)
        assert {r[0] for r in step.refreshed.collect()} == want
        graph = graph.commit(step)
        assert edges(graph.relation("edges")) == edges(after)
    assert graph.versions.verified() and graph.manifest.version == len(steps) + 1
    fresh = CodeGraph.create(*tree.rows(tree.files, spark), f"file://{tmp_path}/again", buckets)
    for name in ("symbols", "outgoing", "defs", "definers"):
        assert sorted(map(tuple, graph.relation(name).collect()), key=repr) == sorted(map(tuple, fresh.relation(name).collect()), key=repr), name


def test_a_step_reads_and_writes_no_other_bucket(spark, tmp_path):
    tree = Tree(6)
    graph = CodeGraph.create(*tree.rows(tree.files, spark), f"file://{tmp_path}/g", 64)
    one = spark.createDataFrame([("f1",)], "path string")
    step = graph.step(one, spark.createDataFrame([("f1", "n1", "function", 1)], SYMBOLS), spark.createDataFrame([], EDGES))
    names = {r[1] for r in tree.files["f1"][0]} | {"n1"} | {r[2] for r in tree.files["f1"][1]}
    assert len(step.read_buckets) <= len(names) < 64 and set(step.replace["edges"]) <= set(step.read_buckets)
    plan = step.tables["edges"]._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "from_name" in x]
    assert scans and all(f"{BUCKET}#" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    old = {p["part"]: p["buckets"] for p in graph.manifest.relations["edges"]["parts"]}
    new = graph.commit(step).manifest.relations["edges"]["parts"]
    kept = {p["part"]: p["buckets"] for p in new if p["part"] in old}
    for part, buckets in old.items():  # what was not rewritten is the very same
        assert kept[part] == {b: m for b, m in buckets.items() if int(b) not in step.replace["edges"]}


def test_nothing_changes(spark, tmp_path):
    tree = Tree(7)
    graph = CodeGraph.create(*tree.rows(tree.files, spark), f"file://{tmp_path}/g", 8)
    none = spark.createDataFrame([], "path string")
    step = graph.step(none, *tree.rows([], spark))
    assert step.refreshed.count() == 0 and step.read_buckets == []
    assert edges(graph.commit(step).relation("edges")) == edges(rebuilt(spark, tree))
