import random

import pytest

from stratalens.operators import loop as L

TURNS, CALLS = "conv_id bigint, turn bigint", "conv_id bigint, turn bigint, id string, name string, input map<string,string>"
FILES, SEEN = [("big", 51), ("huge", 999), ("small", 50)], "conv_id bigint, path string"


def run(spark, convs, seen=(), most=24, remember=True):
    """convs: {conv: [[(name, path), ...] of each turn]} -> {conv: [action, ...]}, and all rows."""
    calls = [(c, t, f"{t}-{i}", n, {"file_path": p}) for c, ts in convs.items() for t, cs in enumerate(ts) for i, (n, p) in enumerate(cs)]
    turns = spark.createDataFrame([(c, t) for c, ts in convs.items() for t in range(len(ts))], TURNS)
    files = spark.createDataFrame(FILES, "path string, line_count bigint")
    out = L.gate_loop(turns, spark.createDataFrame(calls, CALLS), files, spark.createDataFrame(list(seen), SEEN), 50, most, remember)
    rows = sorted(map(tuple, out.collect()))
    return {c: [r[4] for r in rows if r[0] == c] for c in convs}, rows


READ, HUGE, SMALL, ASK, HOST = [("Read", "big")], [("view", "huge")], [("Read", "small")], [("index_callers", "x")], [("Bash", "ls")]


def test_second_read_is_the_hosts(spark):
    got, rows = run(spark, {1: [READ, READ, READ], 2: [READ + HUGE, HUGE], 3: [READ + READ + ASK, []], 4: [READ, ASK + READ]})
    assert got == {1: ["answer", "forward", "forward"], 2: ["answer", "forward"], 3: ["answer", "final"], 4: ["answer", "forward"]}
    assert rows[0][5] == ["big"] and rows[1][5] == []


def test_mixed_small_and_known_reads_are_forwarded(spark):
    got, _ = run(spark, {1: [READ + HOST, READ], 2: [SMALL], 3: [READ, HUGE], 4: [HOST], 5: [[]]}, seen=[(3, "big"), (9, "huge")])
    assert got == {1: ["forward", "answer"], 2: ["forward"], 3: ["forward", "answer"], 4: ["forward"], 5: ["final"]}


def test_budget(spark):
    """After 24 answers the next turn is terminal whatever it is; then the budget is whole again."""
    got, rows = run(spark, {1: [ASK] * 27 + [[]], 2: [ASK] * 24 + [[]], 3: [ASK] * 24 + [HOST] + [ASK] * 2, 4: [ASK] * 10 + [[]] + [ASK] * 24, 5: [ASK] * 51})
    assert got[1] == ["answer"] * 24 + ["terminal"] + ["answer"] * 2 + ["final"]
    assert got[2] == ["answer"] * 24 + ["terminal"] and got[3] == ["answer"] * 24 + ["terminal"] + ["answer"] * 2
    assert got[4] == ["answer"] * 10 + ["final"] + ["answer"] * 24 and [i for i, a in enumerate(got[5]) if a == "terminal"] == [24, 49]
    assert [r[3] for r in rows if r[0] == 1][23:26] == [24, 0, 1]


def test_hosts_that_log_their_own_messages_only(spark):
    convs = {1: [READ, READ, READ, READ], 2: [READ, [], READ]}
    assert run(spark, convs, remember=False)[0] == {1: ["answer", "forward", "answer", "forward"], 2: ["answer", "final", "answer"]}
    assert run(spark, convs)[0] == {1: ["answer", "forward", "forward", "forward"], 2: ["answer", "final", "forward"]}


def test_calls_of_the_loop(spark):
    files = spark.createDataFrame(FILES, "path string, line_count bigint")
    calls = spark.createDataFrame([(1, 0, "a", "Read", {"path": "big"}), (1, 0, "b", "index_read", {}), (1, 1, "c", "cat", {"path": "big"}), (1, 1, "d", "cat", {"path": "huge"}), (1, 1, "e", None, None)], CALLS)
    loop = L.gate_loop(calls, calls, files, spark.createDataFrame([], SEEN), 50)
    assert {r["id"]: (r["kind"], r["action"]) for r in L.loop_calls(calls, files, loop, 50).collect()} == {"a": ("gated", "answer"), "b": ("virtual", "answer"), "c": ("host", "forward"), "d": ("gated", "forward"), "e": ("host", "forward")}
    assert L.gate_loop(calls.where("false"), calls.where("false"), files, spark.createDataFrame([], SEEN), 50).count() == 0


@pytest.mark.parametrize("remember", [True, False])
def test_random_conversations_in_any_number_of_batches(spark, remember):
    """Equal to a plain loop, also where a conversation spans many Arrow batches."""
    rng, kinds = random.Random(7), [READ, HUGE, SMALL, ASK, ASK, ASK, HOST, [], READ + HUGE, READ + ASK]
    convs = {c: [rng.choice(kinds) for _ in range(rng.randrange(1, 80))] for c in range(40)}
    want = {}
    for c, ts in convs.items():
        seen, inner, want[c] = set(), 0, []
        for cs in ts:
            reads = {p for n, p in cs if p in ("big", "huge")}
            host = any(not n.startswith("index_") and p not in reads for n, p in cs)
            if inner == 5:
                a = "terminal"
            else:
                a = "final" if not cs else "forward" if host or reads & seen else "answer"
            inner = inner + 1 if a == "answer" else 0
            seen = seen | reads if a == "answer" else seen if remember else set()
            want[c].append(a)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, convs, most=5, remember=remember)[0] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_lists_that_are_asked_for_are_collected(spark):
    """Rows of other keys go before the values are collected; an asked key without values has an empty list."""
    from stratalens.operators import agent

    calls = spark.createDataFrame([(1, 1, "c1", "index_callees", {"path": "7"}), (1, 2, "c2", "index_callees", {"path": "8"})], "conv_id int, turn int, id string, name string, input map<string,string>")
    files, symbols = (spark.createDataFrame([], x) for x in ("path string, label string, text string, summary string", "path string, name string, line int, end_line int"))
    lists = spark.range(1000).selectExpr("'callees' AS tool", "cast(id % 100 AS string) AS key", "cast(id AS string) AS value").where("key <> '8'")
    out = agent.answers(calls, files, symbols, lists)
    got = {r["id"]: r["answer"] for r in out.collect()}
    assert got["c2"] == "[]" and got["c1"].count(",") == 9 and "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
