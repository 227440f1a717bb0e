"""Composed replay against requests that are rendered whole, step by step."""

import random

from pyspark.sql import functions as F

from stratalens.operators import replay as Y
from stratalens.operators import transcript as C


def test_replay_equals_whole_requests(spark):
    rng, tasks = random.Random(9), {}
    grep = lambda n: "\n".join(f"src/f{i % 3}.py:{i}: some hit on this line {i}" for i in range(n))
    listing = "\n".join(f"src/d{i % 4}/file_{i}_with_a_name.py" for i in range(90))
    texts = [grep(60), grep(3), listing, "short", "", "x" * 3000]
    for t in range(12):
        tasks[t] = []
        for s in range(rng.randrange(1, 14)):
            calls = [(rng.choice(["a", "b", "c", f"u{s}"]), rng.choice(["Read", "cat", "grep", "ls", "Bash"]), rng.choice(["big", "huge", "tiny"])) for _ in range(rng.randrange(0, 3))]
            results = [(rng.choice([i for i, _, _ in calls] + ["a", "b", "nobody"]), rng.choice(texts)) for _ in range(rng.randrange(0, 3))]
            tasks[t].append((rng.randrange(0, 50), calls, results))
    summaries = {"big": "s" * 90, "huge": "h" * 10}
    central = spark.createDataFrame([], "path string, called_by bigint")
    rid = spark.createDataFrame(list(enumerate(texts)), "rid int, text string")
    grepped = {r["rid"]: r["b"] for r in rid.select("rid", C.bound_grep(F.col("text")).alias("b")).collect()}
    listed = {r["rid"]: r["bounded"] for r in C.bound_listings(rid, central).collect()}
    heads = {t: (rng.choice([None, 30]), [rng.randrange(5, 60) for _ in range(rng.randrange(0, 3))], rng.random() < 0.4) for t in list(tasks)[:-1]}

    def brute(t, k):
        """(variant -> tokens, gated, bounded) of the request of step k."""
        names, paths = {}, {}
        for _, calls, _ in tasks[t][: k + 1]:
            for i, n, p in calls:
                names[i] = n if names.get(i, n) == n else ""
                if n in ("Read", "cat"):
                    paths[i] = p
        system, tools, marked = heads.get(t, (None, [], True))
        tok = lambda n: max(1, n // 4)
        out, gated, bounded = {}, False, False
        for v, chain in Y.VARIANTS.items():
            total = tok(system) if system is not None else 0
            sizes = list(tools)
            if "cache" in chain and sizes and not marked:
                sizes[-1] += Y.MARK_CHARS
            total += sum(map(tok, sizes))
            for chars, _, results in tasks[t][: k + 1]:
                for i, text in results:
                    if "gate" in chain and paths.get(i) in summaries:
                        text, gated = summaries[paths[i]], True
                    if "bound" in chain and len(text) >= 1500 and names.get(i) in ("grep", "ls"):
                        new = (grepped if names[i] == "grep" else listed).get(texts.index(text))
                        if new is not None:
                            text, bounded = f"⟪bounded:{names[i]}⟫\n{new}", True
                    chars += len(text)
                total += tok(chars)
            out[v] = total
        return out, gated, bounded

    calls = [(t, s, j, *c) for t, ss in tasks.items() for s, (_, cs, _) in enumerate(ss) for j, c in enumerate(cs)]
    results = [(t, s, j, *r) for t, ss in tasks.items() for s, (_, _, rs) in enumerate(ss) for j, r in enumerate(rs)]
    frame = spark.createDataFrame
    states = Y.result_states(frame(results, "task int, step int, idx int, id string, text string"), frame(calls, "task int, step int, idx int, id string, name string, path string"), frame(list(summaries.items()), "path string, summary string"), central)
    steps = frame([(t, s, x[0]) for t, ss in tasks.items() for s, x in enumerate(ss)], "task int, step int, chars int")
    billed = Y.replayed(steps, states, frame([(t, *h) for t, h in heads.items()], "task int, system_chars int, tool_chars array<int>, marked boolean"))
    got = {(r["task"], r["step"]): r for r in billed.collect()}
    assert set(got) == {(t, s) for t, ss in tasks.items() for s in range(len(ss))}
    bounds = 0
    for (t, s), r in got.items():
        want, gated, bounded = brute(t, s)
        assert {v: r[v] for v in Y.VARIANTS} == want and (r["gated"], r["bounded"]) == (gated, bounded), (t, s)
        bounds += bounded
    assert 0 < bounds < len(got)
    total = {r["task"]: r for r in Y.totals(billed).collect()}
    raw = sum(brute(3, s)[0]["raw"] for s in range(len(tasks[3])))
    assert total[3]["raw"] == raw and total[3]["raw_cut"] == 0 and total[3]["n_turns"] == len(tasks[3])


def test_split_lines_knows_every_break(spark):
    from stratalens.functions.text import split_lines

    texts = ["a\x0cb c", "", "\n", "a\r\nb\rc\n", "a\x85b\x1cc\x1dd\x1ee\x0bf g"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(split_lines(F.col("t")).alias("x")).collect()]
    assert got == [t.splitlines() for t in texts]
