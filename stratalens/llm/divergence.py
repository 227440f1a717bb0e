"""Source divergence audit: how far the sources of a language differ in their use of words, and by which words.

Terms are counted once per task, and summed by (language, source, term); those in too few documents of their language go.
What is left is dealt by a hash of (language, term) into blocks of about TERMS terms, and by a hash of the source into
group blocks; a tile is a block against two group blocks. A tile fills a dense int64 matrix, groups by terms, turns counts
into exact shares, and compares all pairs of its groups by broadcasting. Spark adds up the tiles' partial pair matrices and
merges their heaps of the ten most telling terms of each group.

  partials  (lang, source, term, n, docs)     by task         -> summed by (lang, source, term)
  kept      (lang, source, term, n, lang_n)   by (lang, term) -> stored
  tiles     kept beside every group of the two group blocks   -> pair sums, heaps
No row is per pair of terms, and the pairs of groups are the result itself. The largest thing held is one tile.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import stored, table

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms and groups of a tile, about; cells compared at once; distinct terms counted before they are sent on.
TERMS, GROUPS, CELLS, HELD = 4096, 48, 1 << 20, 1 << 19
#: A longer text is read in pieces that end between terms.
PIECE = 1 << 20
#: Bytes of UTF-8: letters in lower case, anything else below 0x80 a space.
_BYTES = bytes(i if i >= 128 or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256))
PARTIALS = "lang string, source string, term string, n bigint, docs bigint"
TILES = "lang string, source string, part string, item string, value bigint"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    plain, at = text.translate(_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if len(plain) - at > PIECE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _partials(docs: DataFrame) -> DataFrame:
    """Occurrences of each term, and documents with it, by (language, source), from one task at a time."""

    def rows(n: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARTIALS.split(", ")]
        for (lang, source), terms in n.items():
            got = docs[lang, source]
            cols = [*(pa.array(x, pa.string()) for x in ([lang] * len(terms), [source] * len(terms), list(terms))), *(pa.array(x, pa.int64()) for x in (list(terms.values()), [got[t] for t in terms]))]
            yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, seen = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                key, own = (lang.as_py(), source.as_py()), set()
                before = len(n[key])
                for terms in terms_of(text.as_py()):
                    n[key].update(terms)
                    own.update(terms)
                docs[key].update(own)
                seen += len(n[key]) - before
                if seen >= HELD:
                    yield from rows(n, docs)
                    n, docs, seen = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(n, docs)

    return docs.mapInArrow(run, PARTIALS)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurrences in the group and in the language; first marks one row a term.

    docs has lang, source, text without nulls. A term's rows meet by (lang, term) only after they are summed by source,
    so a very frequent term brings as many rows as it has sources.
    """
    sums = _partials(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    seen = sums.select("*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return seen.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")


def shares(n: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * n / total), exactly, by long division in base 1000: no product leaves 64 bits below 9e15."""
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergences of every row of p from every row of q, summed over the terms (columns)."""
    out, step = np.zeros((len(p), len(q)), np.int64), max(1, CELLS // max(1, len(p) * len(q)))
    for at in range(0, p.shape[1], step):
        out += divergence(p[:, None, at : at + step], q[None, :, at : at + step]).sum(2)
    return out


def _tile(key, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of terms against two blocks of groups, language by language."""
    a, b = key[1].as_py(), key[2].as_py()
    out: list[tuple] = []
    here = groups.to_pylist()
    by_lang = defaultdict(list)
    for g in here:
        by_lang[g["lang"]].append(g)
    langs = np.array(rows.column("lang").to_pylist(), object)
    for lang, of in by_lang.items():
        mine = rows.filter(pa.array(langs == lang)) if rows.num_rows else rows
        of.sort(key=lambda g: g["source"])
        place, total = {g["source"]: i for i, g in enumerate(of)}, np.array([g["total"] for g in of], np.int64)
        v, lang_total, n_terms, side = of[0]["v"], of[0]["lang_total"], of[0]["n_terms"], np.array([g["gb"] for g in of])
        terms = mine.column("term").combine_chunks().dictionary_encode()
        terms, code = (terms.dictionary.to_pylist(), terms.indices.to_numpy()) if mine.num_rows else ([], np.zeros(0, np.int64))
        n, lang_n = np.zeros((len(of), len(terms)), np.int64), np.zeros(len(terms), np.int64)
        row = np.array([place[s] for s in mine.column("source").to_pylist()], np.int64)
        n[row, code], lang_n[code] = mine.column("n").to_numpy(), mine.column("lang_n").to_numpy()
        d = np.maximum(total + 2 * v, 1)
        p, none = shares(n + 2, d[:, None]), shares(np.full(len(of), 2, np.int64), d)  # none: of a term that the group lacks
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        sums = pair_sums(p[left], p[right]) + (n_terms - len(terms)) * divergence(none[left][:, None], none[right][None, :])
        out += [(lang, of[i]["source"], "pair", of[j]["source"], int(sums[x, y])) for x, i in enumerate(left) for y, j in enumerate(right) if a != b or i < j]
        if a == b and terms:
            q = shares(lang_n + 2, max(lang_total + 2 * v, 1))
            value = np.where((n > 0) & (p > q), divergence(p, q), -1)
            for i, g in enumerate(of):
                at = np.flatnonzero(value[i] >= 0)
                if len(at) > TOP:  # ties at the edge stay, for the order by term
                    at = at[value[i, at] >= np.partition(value[i, at], -TOP)[-TOP]]
                best = heapq.nsmallest(TOP, ((-int(value[i, t]), terms[t]) for t in at))
                out += [(lang, g["source"], "term", t, -x) for x, t in best]
    cols = list(zip(*out)) or [()] * 5
    return pa.table({x.split()[0]: pa.array(c, pa.int64() if x.endswith("bigint") else pa.string()) for x, c in zip(TILES.split(", "), cols)})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources, part `term` the most telling terms.

    Nulls in the three columns are ''. A group without any kept term still stands in every pair of its language; in a
    language without kept terms all values are 0. Repeated rows are documents of their own; equal values are ranked by
    item. An empty table gives an empty result. A text longer than PIECE is read in pieces; a term is held whole. Other
    columns are not read, whatever their names. Counts are exact below 9e15.
    """
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    d = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    kept = stored(kept_terms(d, min_docs), "audit-terms")
    every = stored(d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")), "audit-groups")
    n_terms = kept.agg(F.count_if("first")).first()[0]
    most = every.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, group_blocks = max(1, -(-n_terms // TERMS)), max(1, -(-most // GROUPS))

    block = F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block")
    gb = F.pmod(F.xxhash64("source"), F.lit(group_blocks)).cast("int").alias("gb")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(group_blocks - 1)), lambda y: F.struct(F.least("gb", y).alias("a"), F.greatest("gb", y).alias("b")))).alias("ab")
    tiled = lambda x: x.select("*", pairs).select("*", "ab.a", "ab.b").drop("ab")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), gb)
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    # terms of every block by language; block 0 stands for every language, so that each pair comes from some tile
    sizes = kept.groupBy(block, "lang").agg(F.count_if("first").alias("n_terms")).union(every.select(F.lit(0), "lang", F.lit(0).cast("bigint")).distinct())
    sizes = sizes.groupBy("block", "lang").agg(F.sum("n_terms").alias("n_terms")).withColumn("v", F.sum("n_terms").over(Window.partitionBy("lang")))
    beside = tiled(sizes.join(groups, "lang").select("block", "lang", "n_terms", "v", "source", "total", "lang_total", "gb"))
    rows = tiled(kept.select(block, *(F.col(c).alias(c) for c in ("lang", "source", "term", "n", "lang_n")), gb))  # new columns: both sides stem from kept
    made = stored(rows.groupBy("block", "a", "b").cogroup(beside.groupBy("block", "a", "b")).applyInArrow(_tile, TILES), "audit-tiles")

    one = made.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = one.union(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = ranked(made.where("part = 'term'"), "term").where(F.col("rank") <= TOP)
    return ranked(both, "pair").union(terms)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
m AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + ({UNIT}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)) AS p FROM m JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM m GROUP BY ALL),
q AS (SELECT lang, term, (1 + ({UNIT}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)) AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pair UNION ALL FROM term)) WHERE part = 'pair' OR rank <= {TOP}"""
