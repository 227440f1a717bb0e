"""PII: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Everything is a DataFrame expression: no user functions, no shuffle, one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.session import spread

#: Kinds in the order in which spans with one start are listed. Each pattern is possessive and starts only where a
#: run starts (or where the last match ended), which finds the same leftmost matches in time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?:[\x20]?[A-Z0-9]){11,30}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Length of an IBAN by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban() -> str:
    """IBANs that stand alone, of the length of their country, so that a word after one is no part of it.

    Other country codes have the plain pattern, which stops before an IBAN of a known country.
    """
    known = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    sized = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[\\x20]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    other = f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?:[\\x20](?!(?:{known})[0-9]{{2}}))?[A-Z0-9]){{11,30}}"
    return f"(?<![A-Za-z0-9])(?=[A-Z][A-Z][0-9][0-9])(?:{sized}|{other})"


#: What proposes spans in place of PATTERNS.
FOUND_BY = {"iban": _iban()}
BASE_KINDS = ("email", "ip", "card", "phone")
#: What a confirmed candidate of a kind scores before its context is read; a kind without a checksum starts low.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4}
CONTEXT_WORDS = {
    "email": "mail|contact|correo|courriel",
    "ip": "server|host|address|adresse",
    "card": "card|credit|visa|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|tax id|identity",
}
CONTEXT_BONUS, THRESHOLD, CONTEXT_CHARS = 0.3, 0.6, 48
#: Matches that are placed one after the other; longer lists are placed run by run, as each step copies its list.
RUN = 512


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(
        F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(False)


def _ip(m: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _mod97(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.when(F.length(s).between(15, 34), rest == 1).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _ip,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": _mod97,
    "national_id": lambda m: F.lit(True),
}
#: A cheap test that a text must pass to hold the kind at all; the expensive expression runs only then.
NEEDS = {"email": "@", "phone": "+"}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once."""
    return F.transform(F.array(value), f)[0]


def _candidates(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches with positions in code points: an array of (start, end, m, before, after)."""
    pattern = FOUND_BY.get(kind, PATTERNS[kind])
    matches, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,before:string,after:string>>")

    def step(acc, z):
        s = acc["pos"] + F.length(z["0"])
        e = s + F.length(z["1"])
        row = F.struct(s.alias("s"), e.alias("e"), z["1"].alias("m"), F.right(z["0"], F.lit(1)).alias("before"), F.left(z["2"], F.lit(1)).alias("after"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

    n = F.size(matches)
    zipped = F.arrays_zip(F.slice(parts, 1, n), matches, F.slice(parts, 2, n))
    zipped = F.transform(zipped, lambda z: F.struct(z["0"].alias("0"), z["1"].alias("1"), z["2"].alias("2")))
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out"))
    run = lambda rows: F.aggregate(rows, start, step)

    def in_runs(rows):
        """Every run of RUN matches for itself, then moved to where the runs before it end."""
        ends = lambda runs: F.aggregate(runs, F.array(F.lit(0).cast("bigint")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["pos"])))
        at = lambda x, by: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        moved = lambda runs, by: F.flatten(F.transform(runs, lambda r, i: F.transform(r["out"], lambda x: at(x, F.get(by, i)))))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda i: run(F.slice(rows, i * RUN + 1, RUN)))
        return _let(runs, lambda x: _let(ends(x), lambda by: moved(x, by)))

    found = F.when(n <= RUN, run(zipped)["out"]).otherwise(_let(zipped, in_runs))
    test = text.contains(NEEDS[kind]) & text.rlike(pattern) if kind in NEEDS else text.rlike(pattern)
    return F.when(test, found).otherwise(none)


def _spans(text: Column, kind: str) -> Column:
    # in UTF-32 a position is found at once, in a text only by reading all before it
    part = lambda w, s, n: F.decode(F.substr(w, (4 * s + 1).cast("int"), (4 * n).cast("int")), "UTF-32")
    near = lambda w, x: F.lower(part(w, F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0)), F.least(x["s"], F.lit(CONTEXT_CHARS)) + x["e"] - x["s"] + CONTEXT_CHARS))
    scored = lambda w, x: F.lit(BASE_SCORE[kind]) + F.when(near(w, x).rlike(f"(?:{CONTEXT_WORDS[kind]})"), CONTEXT_BONUS).otherwise(0.0)
    found = F.filter(_candidates(text, kind), lambda x: VALID[kind](x["m"]))
    if kind not in BASE_KINDS:  # these must stand alone: no letter or digit at either side
        found = F.filter(found, lambda x: ~F.coalesce(x["before"].rlike("[A-Za-z0-9]"), F.lit(False)) & ~F.coalesce(x["after"].rlike("[A-Za-z0-9]"), F.lit(False)))
    rank = list(PATTERNS).index(kind)
    span = lambda w, x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("end"), F.round(F.least(scored(w, x), F.lit(1.0)), 2).alias("score"))
    wide = F.encode(text, "UTF-32")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")
    out = _let(found, lambda f: F.when(F.size(f) > 0, _let(wide, lambda w: F.transform(f, lambda x: span(w, x)))).otherwise(none))
    return out if kind in BASE_KINDS else F.filter(out, lambda x: x["score"] >= THRESHOLD)


def pii_spans(text: Column) -> Column:
    """Sorted array of (start, rank, kind, end, score); positions in code points, end exclusive; empty for null."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_spans(text, k) for k in PATTERNS)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of docs.

    Base kinds (email, ip, card with Luhn, phone) keep every confirmed match. The method adds IBANs that pass mod-97
    and national ids that nearby context words lift over the threshold. A null text counts as empty; a null id and
    repeated rows are passed through row by row; other columns are not read, so their names cannot clash. An empty
    table gives an empty result. Time and memory are linear in the text and its matches.
    """
    return docs.select(F.col(id_col), pii_spans(F.col(text_col)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span of text_col replaced by <kind>; overlapping spans are replaced as one, by the first's kind.

    Null texts stay null; all other columns are kept.
    """
    text, spans = F.col(text_col), pii_spans(F.col(text_col))
    init = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc, x):
        ahead = x["start"] >= acc["pos"]
        kept = F.concat(acc["out"], F.substr(text, (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int")), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(ahead, kept).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, init, step, lambda a: F.concat(a["out"], F.substr(text, (a["pos"] + 1).cast("int"))))
    return docs.withColumn(text_col, F.when(text.isNotNull() & (F.size(spans) > 0), done).otherwise(text))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    base = F.filter(F.col("spans"), lambda x: x["rank"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter(F.col("spans"), lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    re2 = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
    } | {k: v for k, v in PATTERNS.items() if k in ("phone", "iban", "national_id")}
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN {digits}[-1 - i]::INT > 4 THEN 2 * {digits}[-1 - i]::INT - 9 ELSE 2 * {digits}[-1 - i]::INT END ELSE {digits}[-1 - i]::INT END)) % 10 = 0"
    flat = "replace(m, ' ', '')"
    moved = f"({flat}[5:] || {flat}[:4])"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE (ascii(c) - 55)::BIGINT END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    valid = {
        "email": "true",
        "ip": rf"regexp_full_match(m, '{part}(?:\.{part}){{3}}')",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"CASE WHEN length({flat}) BETWEEN 15 AND 34 THEN {mod97} ELSE false END",
        "national_id": "true",
    }
    kinds = []
    for rank, (k, pattern) in enumerate((k, re2[k]) for k in PATTERNS):
        alone = "" if k in BASE_KINDS else " AND NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')"
        context = f"regexp_matches(lower(substr(text, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS}) + e - s + {CONTEXT_CHARS})), '{CONTEXT_WORDS[k]}')"
        scored = "" if k in BASE_KINDS else f" AND {BASE_SCORE[k]} + CASE WHEN {context} THEN {CONTEXT_BONUS} ELSE 0 END >= {THRESHOLD}"
        kinds.append(f"""SELECT r, s, {rank} AS rank, '{k}' AS kind, e FROM (
  SELECT r, text, ms[i] AS m, ps[i] AS before, ps[i + 1] AS after,
    (list_sum(list_transform(ps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
    (list_sum(list_transform(ps[:i], lambda x: length(x))) + list_sum(list_transform(ms[:i], lambda x: length(x))))::BIGINT AS e
  FROM (SELECT r, text, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d)))
WHERE {valid[k]}{alone}{scored}""")
    tag = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
  string_agg({tag}, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_KINDS)}) AS base, string_agg({tag}, ',' ORDER BY s, rank) AS spans FROM x GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


ORACLE = _oracle()
