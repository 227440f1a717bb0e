"""Folds over sections, and set similarity of names, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph as G
from stratalens.operators import render as R

HEADS = "path string, idx int, level int, label string, line bigint"


def brute_ends(rows, total):
    return sorted((p, i, max(ln, nxt[0] - 1) if (nxt := [l2 for q, j, v2, _, l2 in sorted(rows) if q == p and j > i and v2 <= v]) else total) for p, i, v, _, ln in rows)


def brute_names(labels):
    taken, out = set(), []
    for base in labels:
        k, name = 1, base
        while name in taken:
            k += 1
            name = f"{base} #{k}"
        taken.add(name)
        out.append(name)
    return out


def test_sections_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"p{d}", i, rng.randrange(1, 9), rng.choice(["A", "A #2", "A #2 #2", "B", "A #3"]), 3 * i + rng.randrange(0, 3)) for d in range(15) for i in range(rng.randrange(1, 60))]
    heads = spark.createDataFrame(rows, HEADS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = sorted((r["path"], r["idx"], r["end_line"]) for r in R.section_ends(heads, F.lit(999).cast("bigint")).collect())
        names = {(r["path"], r["idx"]): r["name"] for r in R.unique_names(heads).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_ends(rows, 999)
    for d in range(15):
        of = sorted(r for r in rows if r[0] == f"p{d}")
        assert [names[r[0], r[1]] for r in of] == brute_names([r[3] for r in of])


def test_very_many_headings_in_one_document(spark):
    heads = spark.range(100_000).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("idx"), (F.col("id") % 6 + 1).cast("int").alias("level"), F.lit("same").alias("label"), F.col("id").alias("line"))
    start = time.time()
    ends, names = R.section_ends(heads, F.lit(100_000).cast("bigint")), R.unique_names(heads)
    assert ends.where("idx = 0").first()["end_line"] == 5 and names.select("name").distinct().count() == 100_000
    assert time.time() - start < 30
    assert R.section_ends(heads.where("false"), F.lit(1).cast("bigint")).count() == 0


@pytest.mark.parametrize("least,most_tokens", [(1, 10), (2, 10), (2, 3), (3, 10), (3, 4)])
def test_links_and_pairs_equal_brute_force(spark, least, most_tokens):
    """Also where the longer sets are counted by joins."""
    rng = random.Random(least)
    sets = [tuple(sorted(set(rng.choices("abcdefghijkl", [9, 7, 5] + [1] * 9, k=rng.randrange(0, 8))))) for _ in range(70)]
    names = {f"n{i}": s for i, s in enumerate(sets)}
    df = spark.createDataFrame([(f"{n}:{''.join(s)}",) for n, s in names.items()] * 2, "name string")
    tokens = lambda c: F.filter(F.split(F.substring_index(c, ":", -1), ""), lambda x: x != "")
    classes = G.name_classes(df, tokens)
    got = {r["name"].split(":")[0]: (r["class"].split(":")[0], r["n_links"]) for r in G.name_links(classes, least, most_tokens).collect()}
    for n, s in names.items():
        links = sum(len(set(s) & set(t)) >= least for m, t in names.items() if m != n)
        assert got[n] == (min((m for m, t in names.items() if t == s), key=lambda m: f"{m}:{''.join(s)}"), links), n
    reps = {c: set(names[c]) for c, _ in got.values()}
    want = {(a, b): len(x & y) for a, x in reps.items() for b, y in reps.items() if f"{a}:{''.join(sorted(x))}" < f"{b}:{''.join(sorted(y))}" and len(x & y) >= least}
    pairs = [(r["a"].split(":")[0], r["b"].split(":")[0], r["shared"]) for r in G.class_pairs(classes, least, block=4).collect()]
    assert len(pairs) == len(want) and {(a, b): n for a, b, n in pairs} == want
