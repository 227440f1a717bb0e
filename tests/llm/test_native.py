"""PII, quality rules, line dedup and chat formatting: against SQL or brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from stratalens.llm import chat, lines, pii, quality, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, name):
    oracle.compare(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def spans(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["x"] for r in pii.find_pii(df).orderBy("doc_id").select(pii.listed(F.col("spans")).alias("x")).collect()]


def python_spans(text):
    """The base rules, with the plain patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(x for _, _, x in sorted(out))


def test_pii_base_equals_plain_patterns(spark):
    texts = ["x@y.z%q@r.s a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "+1 (974) 555-3436. +12", "4111 1111 1111 1111x4111-1111-1111-1112", "a.b+c@d-e.f. .@.x a@b", "1.2.3.", "é😀 a@b.co"]
    assert spans(spark, *texts) == [python_spans(t) for t in texts]


def test_pii_added_kinds_and_context(spark):
    got = spans(spark, "IBAN DE89370400440532013000 ok", "DE89370400440532013001", "my ssn is 123-45-6789", "part 123-45-6789", "x123-45-6789 ssn")
    assert got == ["iban:5:27", "", "national_id:10:21", "", ""]


def test_pii_iban_before_other_words(spark):
    iban, british = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = [f"Pay to {iban} Please note", f"Pay {iban} 2 days", f"{british} OK", f"{iban} {british}", f"AB12 {iban}", f"{iban}0", f"X{iban}", "NO9386011117947 A", "FR1420041010050500013M02606 AND"]
    got = spans(spark, *texts)
    assert got == ["iban:7:29", "iban:4:26", "iban:0:27", "iban:0:22,iban:23:50", "iban:5:27", "", "", "iban:0:15", "iban:0:27"]
    assert pii.redact(spark.createDataFrame([(texts[0],)], "text string")).first()["text"] == "Pay to <iban> Please note"


def test_pii_is_linear_in_long_runs(spark):
    assert spans(spark, "a" * 200_000, "1" * 200_000, "+1" + " " * 200_000, "a." * 100_000) == ["", "", "", ""]


def test_pii_of_very_many_matches(spark):
    """Runs of matches are placed like one list."""
    texts = [" ".join(f"u{i}@h{i % 7}.org" for i in range(n)) for n in (pii.RUN, pii.RUN + 1, 3 * pii.RUN, 30_000)]
    assert spans(spark, *texts) == [python_spans(t) for t in texts]


def test_pii_odd_rows(odd, empty):
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(empty).count() == 0
    by = {r["doc_id"]: r["spans"] for r in pii.find_pii(odd).collect()}
    assert by[2] == by[3] == [] and len(by[6]) == 3
    red = pii.redact(odd)
    assert red.columns == odd.columns and {r["doc_id"]: r["text"] for r in red.collect()}[6].count("<email>") == 3


def test_pii_base_digest(spark, sf):
    for r in pii.op1_pii(spark, sf).collect():
        base = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE_KINDS)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_quality_counts(spark):
    eight = "a b c d e f g h"
    texts = {1: f"{eight} x {eight}", 2: f"{eight} {eight}", 3: "a " * 20, 4: "l1\nl1\n \n\nl2\nl1", 5: "#*$ a|b", 6: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    f = {r["doc_id"]: r["quality"] for r in quality.judge(df).collect()}
    assert [f[i]["features"]["n_repeat_words"] for i in (1, 2, 3)] == [16, 16, 20]
    assert f[4]["features"]["n_dup_lines"] == 2 and f[5]["features"]["n_symbols"] == 4 and f[6]["features"]["n_words"] == 0
    assert f[3]["base_failed"] and not f[6]["kept"]


def test_quality_keeps_labelled_good(spark, sf):
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    got = quality.op6_quality_rules(spark, sf).join(good, "doc_id").where("n_words >= 20")
    assert got.where("kept").count() >= 0.99 * got.count()
    bad = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0")
    got = quality.op6_quality_rules(spark, sf).join(bad, "doc_id")
    assert got.where("kept").count() <= 0.3 * got.count()


def test_quality_odd_rows(odd, empty):
    assert quality.judge(odd).count() == odd.count() and quality.judge(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_lines_keep_the_first(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank on a cold morning in may"
    near = base.replace("may", "day")
    df = spark.createDataFrame([(2, f"{near}\nown line two"), (1, f"intro\n{base}\n\n"), (3, base), (None, "x y")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {1: f"intro\n{base}\n\n", 2: "own line two", 3: "", None: "x y"}


def test_lines_odd_rows(odd, empty):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and lines.dedup_lines(empty).count() == 0
    assert [r["text"] for r in out.where("doc_id = 2").collect()] == [None]


def test_chat(spark):
    rows = [(1, True, 0, "user", "hi"), (1, False, 0, "user", "hi"), (1, True, 1, "assistant", "good <|end|>"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", None), (2, True, 0, None, "x"), (None, True, 0, "user", "lost")]
    out = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id bigint, is_chosen boolean, turn int, role string, text string")).collect()}
    p = out[1]
    assert p["prompt"] == "<|user|>\nhi<|end|>\n" and p["n_prompt_turns"] == 1 and p["usable"]
    assert p["chosen"] == "<|assistant|>\ngood < |end|><|end|>\n" and p["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    assert [p["chosen"][s["start"] : s["end"]] for s in p["chosen_spans"]] == ["good < |end|><|end|>\n"]
    assert [p["rejected"][s["start"] : s["end"]] for s in p["rejected_spans"]] == ["bad<|end|>\n"]
    assert out[2]["rejected"] is None and not out[2]["usable"] and out[2]["chosen"] == "<|unknown|>\nx<|end|>\n" and set(out) == {1, 2}


def all_characters(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute_near(texts):
    """The lines, of distinct ones in order, that stay when every pair is compared on all its character shingles."""
    sets, parent, having = [all_characters(x) for x in texts], list(range(len(texts))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, y in enumerate(sets):
        for i, both in Counter(i for x in y for i in having[x]).items():
            if 100 * both >= 80 * (len(sets[i]) + len(y) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in y:
            having[x].append(j)
    return [x for i, x in enumerate(texts) if find(i) == i]


def test_lines_are_compared_on_every_character(spark):
    rng = random.Random(12)
    long = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    cjk = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(60))
    texts = ["https://a.example/x/1", "https://b.example/y/2", cjk, cjk[:8] + cjk[::-1], cjk[:30] + "😀" + cjk[31:], cjk[:20] + cjk[21:] + "x", "field one" + long(50), "field one" + long(50)]
    texts += ["a\tb\tc\td\te\t" + long(30), "a\tb\tc\td\te\t" + long(30), "ab", "ab c", "sha256:" + long(64), "sha256:" + long(64)]
    tail = long(90)
    texts += [f"first {tail}", f"{tail}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["text"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()]
    want = set(brute_near(texts))
    assert got == [x if x in want else "" for x in texts] and 1 < len(want) < len(texts)


def test_lines_of_the_documents_are_compared_on_every_character(spark, sf, documents):
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    is_line, seen = lambda x: x.strip(" \t\n\x0b\f\r") != "", set()
    stay = set(brute_near(list(dict.fromkeys(x for _, t in rows for x in t.split("\n") if is_line(x)))))
    want = {i: "\n".join(x for x in t.split("\n") if not is_line(x) or x in stay and not (x in seen or seen.add(x))) for i, t in rows}
    got = {r["doc_id"]: r["text"] or "" for r in lines.op4_line_dedup(spark, sf).collect()}
    assert set(got) == set(want) and sum(got[i] != want[i] for i in want) <= 1  # high recall, not certainty


def test_lines_that_share_only_keys_of_a_third(spark, monkeypatch):
    """Families in which many lines are too far from the earliest of their keys: the second pass has to find their links."""
    rng, letters = random.Random(13), "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for f in range(3):
        family = ["".join(rng.choices(letters, k=150))]
        for _ in range(120):
            t = rng.choice(family)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(t))
                t = t[:i] + rng.choice(letters) + t[i + 1 :]
            family.append(t)
        texts += family[:1] + rng.sample(family[1:], 80)
    texts = list(dict.fromkeys(texts))
    monkeypatch.setattr(lines, "BLOCK", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["text"] for r in lines.dedup_lines(docs).collect()} - {""}
    want = set(brute_near(texts))
    assert want <= got and len(got - want) <= 1 and len(want) < len(texts) - 50


def test_pairs_of_a_crowded_key_that_are_too_far_apart_are_no_rows(spark, monkeypatch):
    """A family around one line, its members of similarity 0.6 to each other: about none of its pairs are compared on their texts."""
    rng, letters, asked = random.Random(15), "abcdefghijklmnopqrstuvwxyz", []
    base = "".join(rng.choices(letters, k=240))
    texts = ["".join(rng.choice(letters) if j in at else x for j, x in enumerate(base)) for at in (set(rng.sample(range(240), 4)) for _ in range(160))]
    near = lines._near
    monkeypatch.setattr(lines, "_near", lambda pairs, *more: asked.append(pairs.count()) or near(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["text"] for r in lines.dedup_lines(docs).collect()} - {""}
    assert got == set(brute_near(texts)) and sum(asked[1:]) <= len(texts)


def test_pairs_of_many_crowded_keys_are_one_row(spark, monkeypatch):
    """A family whose members share most of their keys and are about as near as may be: no pair is a row of each shared key."""
    rng, letters, asked = random.Random(18), "abcdefghijklmnopqrstuvwxyz", []
    base = "".join(rng.choices(letters, k=700))
    texts = ["".join(rng.choice(letters) if j in at else x for j, x in enumerate(base)) for at in (set(rng.sample(range(700), 8)) for _ in range(150))]
    pairs = lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda found: asked.append((found.count(), (out := pairs(found)).count())) or out)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["text"] for r in lines.dedup_lines(docs).collect()} - {""}
    assert got == set(brute_near(texts)) and asked[-1][0] == asked[-1][1] > 0


def test_least_hashes_are_of_different_shingles(spark):
    """Also where the least ones repeat very often."""
    rng = random.Random(19)
    texts = ["ab", "abcdefgh" * 40, "x" * 500, ("y" * 300).join("".join(rng.choices("abcdef", k=60)) for _ in range(4))]
    texts += ["".join(rng.choices("abcdefghijkl", k=n)) * m for n in (9, 30, 60, 90) for m in (1, 2, 9)]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("every", F.sort_array(lines.shingles(F.col("line"))))
    rows = df.select(lines.sketch(F.col("line"), F.col("every")).alias("some"), lines.hashes(F.col("line")).alias("all")).collect()
    assert len(rows) == len(texts) and all(r["some"] == r["all"][: lines.SKETCH] for r in rows)


def keys_of(spark, texts):
    """(i, key) of the texts' band keys."""
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, line string")
    return [tuple(r) for r in df.select("i", F.explode(lines.band_keys(F.slice(lines.hashes(F.col("line")), 1, lines.SKETCH)))).collect()]


def test_common_words_are_no_company(spark):
    """Different lines that have a few words in common share hardly a key."""
    rng, letters = random.Random(16), "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choices(letters, k=n))
    common = [word(12) for _ in range(60)]
    texts = [" ".join(w for _ in range(12) for w in (rng.choice(common), word(12))) for _ in range(400)]
    rows = keys_of(spark, texts)
    shared = Counter(k for _, k in rows)
    assert len({i for i, k in rows if shared[k] > 1}) <= 100


def test_lines_around_the_short_ones_meet(spark):
    """A line and the same without its last characters, at similarity 0.8 or just above, on both sides of SHORT shingles."""
    rng, letters = random.Random(17), "abcdefghijklmnopqrstuvwxyz"
    whole = ["".join(rng.choices(letters, k=n + 7)) for n in range(4, 60) for _ in range(10)]
    cut = [t[: 7 - (-(len(t) - 7) * 4 // 5)] for t in whole]
    keys = [{(i, k) for i, k in keys_of(spark, x)} for x in (whole, cut)]
    assert len({i for i, _ in keys[0] & keys[1]}) >= len(whole) - 1


def test_short_lines_meet(spark):
    """Lines of five shingles and of four of them: similarity 0.8, and most bins are empty."""
    rng = random.Random(14)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(600)]
    docs = spark.createDataFrame([(i, f"{t}\n{t[:11]}") for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sum(len(r["text"]) != 12 for r in lines.dedup_lines(docs).collect()) <= 2


def test_chat_odd_rows(spark):
    """An empty table, repeated rows, clashing columns, null turns, very long texts: each has its defined result."""
    schema = "pair_id bigint, is_chosen boolean, turn int, role string, text string"
    assert chat.format_preferences(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 200_000
    rows = [(1, True, 0, "user", "q"), (1, True, 0, "user", "q"), (1, False, 0, "user", "q"), (1, True, 1, "assistant", long), (1, False, 1, "assistant", "b"), (2, True, None, "assistant", None), (2, False, None, "assistant", "")]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS c", "2 AS r", "3 AS n", "4 AS p")
    out = {r["pair_id"]: r for r in chat.format_preferences(docs).collect()}
    a = out[1]
    assert a["n_prompt_turns"] == 1 and a["prompt"] == "<|user|>\nq<|end|>\n" and a["chosen"] == f"<|user|>\nq<|end|>\n<|assistant|>\n{long}<|end|>\n"
    assert [a["chosen"][s["start"] : s["end"]] for s in a["chosen_spans"]] == [f"{long}<|end|>\n"] and a["usable"]
    assert out[2]["n_prompt_turns"] == 1 and out[2]["chosen"] == "" and not out[2]["usable"] and out[2]["prompt"] == "<|assistant|>\n<|end|>\n"
