"""Source divergence, language identification and fill-in-middle: brute force, held-out accuracy, odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from stratalens.llm import divergence, fim, langid

# ---- source divergence


def brute_audit(rows, min_docs):
    """By the definition alone, with whole numbers of any size."""
    rows = [(g or "", s or "", re.findall(divergence.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for g, s, t in rows]
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for g, s, ts in rows:
        groups[g].add(s)
        docs[g].update(set(ts))
        n[g, s].update(ts)
    out = []
    for g, sources in groups.items():
        kept = [t for t, c in docs[g].items() if c >= min_docs]

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        all_, own = p(sum((n[g, s] for s in sources), Counter())), {s: p(n[g, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(own[s][t], all_[t]), t.encode()) for t in kept if n[g, s][t] and own[s][t] > all_[t])[:10]
            out += [(g, s, part, i.decode(), -v, k) for part, items in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def audit_rows(seed, n, sources):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "a1b", "日本", "x-y", "\x7f", "😀", "é"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    return [(rng.choice(["en", "de", None, "x"]) if i % 9 else "solo", rng.choice(sources), " ".join(rng.choices(words, k=rng.randrange(0, 60))) if i % 7 else rng.choice([None, "", "12 34"])) for i in range(n)]


@pytest.mark.parametrize("groups,terms", [(48, 4096), (3, 16)])
def test_audit_equals_brute_force(spark, monkeypatch, groups, terms):
    """Also where the groups of a language and its terms take many tiles."""
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = audit_rows(1, 300, [None, "", "a", "B", "é", "z", "src1", "src2", "src3"])
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS block", "3 AS n", "4 AS gb")
    got = [tuple(r) for r in divergence.audit(docs, min_docs=4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_audit(rows, 4)


def test_audit_of_odd_and_empty_rows(odd, empty, spark):
    assert divergence.audit(empty.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).count() == 0
    rows = divergence.audit(odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.col("spans")})).collect()
    n = odd.select(F.coalesce("spans", F.lit(""))).distinct().count()
    assert {(r["part"], r["value"]) for r in rows} == {("pair", 0)} and len(rows) == n * (n - 1)


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = "Ab cd1ef ÉG [x]^`{y}~ 日本\x85ß\u2028 " * 500 + "".join(map(chr, range(128))) + "q" * 5000
    all_of = lambda: [t.decode() for ts in divergence.terms_of(text.encode()) for t in ts]
    whole = all_of()
    monkeypatch.setattr(divergence, "PIECE", 100)
    assert all_of() == whole == re.findall(divergence.TERM, "".join(c.lower() if c.isascii() else c for c in text))


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randrange(1, rng.choice([10, 10**6, 9 * 10**15]))
        n = rng.randrange(0, total + 1)
        assert int(divergence.shares(np.array([n], np.int64), np.array([total], np.int64))[0]) == 1 + 10**9 * n // total


# ---- language identification


def brute_grams(text):
    x = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return [x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n] != " "]


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


@pytest.mark.parametrize("piece", [1 << 18, 1, 2, 7])
def test_grams_equal_brute_force(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    reader, rng = langid.Reader(), random.Random(4)
    for text in ["", "a", "12 34", "Été! 日本語 x", "  a  b", "a1b", *("".join(rng.choices("aB é1 \n日", k=40)) for _ in range(50))]:
        got = Counter(int(g) for x in reader.grams(text) for g in x)
        assert got == Counter(map(code, brute_grams(text))), text


@pytest.fixture(scope="module")
def model(spark, documents):
    return langid.learn(documents.where(~langid.held_out(F.col("doc_id"))))


def test_filter_holds_what_counts_say(documents, model):
    """No language is missing for any n-gram; others come as often as the false rate says; all grams of all texts count."""
    n = defaultdict(Counter)
    for r in documents.where(~langid.held_out(F.col("doc_id"))).collect():
        n[r["lang"]].update(brute_grams(r["text"] or ""))
    rate = defaultdict(dict)
    for lang, c in n.items():
        total = Counter()
        for g, k in c.items():
            total[len(g)] += k
        for g, k in c.items():
            if k * langid.RATE >= total[len(g)]:
                rate[g][lang] = k / total[len(g)]
    want = {g: {x for x, v in of.items() if v * langid.CONTRAST >= max(of.values())} for g, of in rate.items()}
    grams = np.array([code(g) for g in want], np.uint64)
    masks = model.contained(grams, 0)
    false = asked = 0
    for langs, m in zip(want.values(), masks):
        got = {x for i, x in enumerate(model.languages) if int(m) >> i & 1}
        assert langs <= got
        false, asked = false + len(got - langs), asked + len(model.languages) - len(langs)
    assert false <= asked * 4 * model.false_rate.max() + 5
    random_grams = np.random.default_rng(5).integers(1 << 50, 1 << 62, 200_000).astype(np.uint64)
    seen = model.contained(random_grams, 0)
    for i, rate_ in enumerate(model.false_rate):
        assert abs(np.count_nonzero(seen >> np.uint64(i) & np.uint64(1)) / 200_000 - rate_) < 0.002


def test_held_out_accuracy(spark, documents, model):
    got = langid.predict(documents.where(langid.held_out(F.col("doc_id"))), model)
    assert got.where("language.lang_pred = lang").count() >= 0.98 * got.count() and got.count() > 20
    cut = langid.predict(documents.withColumn("text", F.substring("text", 1, 60)), model).where("text rlike '[a-z]{3}'")
    assert cut.where("language.lang_pred = lang").count() >= 0.9 * cut.count()


def test_language_of_odd_rows(spark, odd, empty, model):
    texts = [None, "", "12 !? 34", "der", "日本", "日本 der"]
    rows = langid.predict(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), model).collect()
    assert [r["language"]["lang_pred"] for r in rows[:3]] == [langid.UNKNOWN] * 3 and all(0 <= r["language"]["score"] <= 1 for r in rows)
    assert rows[4]["language"]["lang_pred"] in model.languages
    assert langid.predict(empty, model).count() == 0 and langid.predict(odd, model).count() == odd.count()
    none = langid.learn(empty.withColumn("lang", F.lit("x")))
    assert none.languages == [] and {r["language"]["lang_pred"] for r in langid.predict(odd, none).collect()} == {langid.UNKNOWN}


def test_more_than_64_languages(spark):
    """Each language has a letter of its own; the masks take a second word."""
    rows = [(f"l{i:03}", f"ab{chr(0x4E00 + i)} " * 20) for i in range(70)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = langid.predict(docs, langid.learn(docs)).where("language.lang_pred = lang").count()
    assert got == 70


def test_very_long_text(spark, model):
    long = spark.createDataFrame([("der die das und ist " * 60_000,)], "text string")
    assert langid.predict(long, model).first()["language"]["lang_pred"] == "de"


# ---- fill-in-middle


def test_fill_in_middle_round_trip(spark, odd, empty):
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\r\nb c\n", "x<P>y\nz", "<", "<\n<S\n<M", "P>\nM>", "é😀\n" * 50, "l\n" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts * 8)] + [(None, "a\nb\nc\nd")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fim", "2 AS output")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    for r in out:
        text, f = r["text"] or "", r["fim"]
        assert r["back"]["text"] == text and r["back"]["sha256"] == hashlib.sha256(text.encode()).hexdigest() and f["output_sha256"] == hashlib.sha256(f["output"].encode()).hexdigest()
        units = regex.findall(fim.LINES, text)
        assert f["n"] == len(units) and (f["form"] == "plain") == (not text or "<P>" in text) == (f["prefix_chars"] is None)
        if f["form"] != "plain":
            h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
            h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
            a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
            x, m, y = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
            assert f["output"] == (f"<S>{y}<P>{x}<M>{m}" if h4 % 100 < 50 else f"<P>{x}<S>{y}<M>{m}") and f["form"] == ("spm" if h4 % 100 < 50 else "psm")
            assert (f["prefix_chars"], f["middle_chars"]) == (len(x), len(m))
    assert {r["fim"]["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0 and fim.fill_in_middle(odd).count() == odd.count()


def test_recipes(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(400)], "doc_id bigint, text string")
    words = fim.Recipe(unit=r"\S+\s*|\s+", fim_percent=25, spm_percent=0, prefix="[p]", suffix="[s]", middle="[m]")
    forms = Counter(r["fim"]["form"] for r in fim.fill_in_middle(docs, recipe=words).collect())
    assert 60 < forms["psm"] < 140 and forms["spm"] == 0
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("", "<S>", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fim.Recipe(prefix=marks[0], suffix=marks[1], middle=marks[2])
