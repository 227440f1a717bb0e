"""Full-text search over token arrays: a query language compiled to one predicate, hits ranked by call-graph centrality."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import let, like, search_tokens
from stratalens.sources.versions import kept

_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|(\^)|([()+*:,])|([^\s"()^+*:,]+))')
_WORD = re.compile(r"^[\w\x80-\U0010ffff]+$")


class QueryError(ValueError):
    """The text is no query; search() then takes it as one phrase."""


def tokens_of(text: str) -> list[str]:
    """The driver-side twin of search_tokens()."""
    plain = "".join(unicodedata.normalize("NFD", c)[0] if "\xc0" <= c < "ɐ" else c for c in text).lower()
    out, run = [], ""
    for c in plain + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


NOTHING = ("nothing",)


class _Parser:
    """OR < AND < NOT and implicit AND < phrases; columns are content (searched) and path (never matches).

    The tree: (or, x, y), (and, x, y), (not, x, y: x without y), (phrase, words, whether the last is a prefix, whether at
    the very beginning), (near, [(words, prefix)], distance) and NOTHING.
    """

    def __init__(self, text: str):
        self.at, self.lex = 0, []
        end = 0
        while end < len(text.rstrip()):
            m = _LEX.match(text, end)
            if not m or m.end() == end or text[m.start() : m.end()].strip() == "":
                raise QueryError(text)
            self.lex.append(m.group(1) or m.group(2) or m.group(3) or m.group(4))
            end = m.end()
        if not self.lex:
            raise QueryError(text)

    def peek(self):
        return self.lex[self.at] if self.at < len(self.lex) else None

    def next(self):
        x = self.peek()
        if x is None:
            raise QueryError("ends too early")
        self.at += 1
        return x

    def parse(self) -> tuple:
        out = self.either()
        if self.peek() is not None:
            raise QueryError(self.peek())
        return out

    def either(self) -> tuple:
        out = self.all_of()
        while self.peek() == "OR":
            self.next()
            out = ("or", out, self.all_of())
        return out

    def all_of(self) -> tuple:
        out = self.without()
        while self.peek() == "AND":
            self.next()
            out = ("and", out, self.without())
        return out

    def without(self) -> tuple:
        out = self.row()
        while self.peek() == "NOT":
            self.next()
            out = ("not", out, self.row())
        return out

    def row(self) -> tuple:
        out = self.item()
        while self.peek() not in (None, "OR", "AND", "NOT", ")", ",", "+", "*", ":"):
            out = ("and", out, self.item())
        return out

    def item(self) -> tuple:
        if self.peek() == "(":
            self.next()
            out = self.either()
            if self.next() != ")":
                raise QueryError("(")
            return out
        if self.at + 1 < len(self.lex) and self.lex[self.at + 1] == ":":
            column = self.next()
            self.next()
            if column not in ("content", "path"):
                raise QueryError(column)
            out = self.item()
            return out if column == "content" else NOTHING
        if self.peek() == "NEAR" and self.at + 1 < len(self.lex) and self.lex[self.at + 1] == "(":
            return self.near()
        return self.phrase()

    def words(self) -> tuple[list[str], bool]:
        x = self.next()
        if x.startswith('"'):
            words = tokens_of(x[1:-1].replace('""', '"'))
        elif _WORD.match(x) and x not in ("OR", "AND", "NOT"):
            words = tokens_of(x)
        else:
            raise QueryError(x)
        if self.peek() == "+":  # the rest of the phrase says whether its last word is a prefix
            self.next()
            more, prefix = self.words()
            return words + more, prefix
        prefix = self.peek() == "*"
        if prefix:
            self.next()
        return words, prefix

    def phrase(self) -> tuple:
        first = self.peek() == "^"
        if first:
            self.next()
        words, prefix = self.words()
        return ("phrase", words, prefix, first) if words else NOTHING

    def near(self) -> tuple:
        self.at += 2
        groups, distance = [], 10
        while self.peek() not in (")", ",", None):
            groups.append(self.words())
        if self.next() == ",":
            n = self.next()
            if not n.isdigit() or self.next() != ")":
                raise QueryError("NEAR")
            distance = int(n)
        if not groups or any(not w for w, _ in groups):
            raise QueryError("NEAR")
        return ("near", groups, distance)


def parsed(text: str) -> tuple:
    """The query's tree, else the text as one phrase, else NOTHING: arbitrary text never fails."""
    try:
        return _Parser(text).parse()
    except QueryError:
        words = tokens_of(text)
        return ("phrase", words, False, False) if words else NOTHING


def _near(groups: list, distance: int, tokens: Column) -> Column:
    def places(words: list[str], prefix: bool) -> Column:
        """Where the phrase begins: array of positions."""
        def fits(t, x, i):
            tests = [x == words[0]] + [F.get(t, i + k) == w for k, w in enumerate(words) if k]
            if prefix:
                tests[-1] = (F.get(t, i + len(words) - 1) if len(words) > 1 else x).startswith(words[-1])
            return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

        at = lambda t: F.transform(t, lambda x, i: F.when(fits(t, x, i), i))
        return F.array_compact(F.flatten(F.transform(F.array(tokens), at)))

    # every phrase's places are found once; then some place of the first has all others within `distance` tokens
    named = F.struct(*(places(*g).alias(f"p{k}") for k, g in enumerate(groups)))
    n = [len(w) for w, _ in groups]

    def within(i, size):
        return lambda j: F.when(j > i, j - i - n[0]).otherwise(i - j - size) <= distance

    def close(s):
        def around(i):
            out = F.lit(True)
            for k in range(1, len(groups)):
                out = out & F.exists(s[f"p{k}"], within(i, n[k]))
            return out

        return F.exists(s["p0"], around)

    return F.exists(F.array(named), close)


def predicate(text: str, padded: Column, tokens: Column) -> Column:
    """The query as one predicate over a row's tokens, for tables without postings."""
    def test(t: tuple) -> Column:
        if t[0] in ("or", "and", "not"):
            x, y = test(t[1]), test(t[2])
            return x | y if t[0] == "or" else x & y if t[0] == "and" else x & ~y
        if t[0] == "phrase":
            _, words, prefix, first = t
            run = " " + " ".join(words) + ("" if prefix else " ")
            return padded.startswith(run) if first else padded.contains(run)
        return _near(t[1], t[2], tokens) if t[0] == "near" else F.lit(False)

    return test(parsed(text))


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' (path, tokens, padded): padded is the tokens between single spaces, for phrases."""
    t = search_tokens(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("path"), t.alias("tokens")).withColumn("padded", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")))


def snippet(tokens: Column, words: list[str], size: int = 32) -> Column:
    """The best `size` tokens, matches between << and >>; marks with ... what is cut.

    Windows begin at a match. A different word counts 1000, a repeated one 1; the first of the best is taken and moved
    so that its matches lie in the middle.
    """
    def chosen(hits):
        def scored(h):
            inside = F.filter(hits, lambda x: (x["i"] >= h["i"]) & (x["i"] < h["i"] + size))
            kinds = F.size(F.array_distinct(F.transform(inside, lambda x: x["w"])))
            return F.struct((999 * kinds + F.size(inside)).alias("score"), (-h["i"]).alias("neg"), F.array_max(F.transform(inside, lambda x: x["i"])).alias("last"))

        best = F.array_max(F.transform(hits, scored))
        middle = -best["neg"] - F.floor((size - (best["last"] + 1 + best["neg"])) / 2).cast("int")
        return F.coalesce(F.greatest(F.least(middle, F.size(tokens) - size), F.lit(0)), F.lit(0))

    hits = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda h: h["w"].isin(*words))
    start = let(hits, chosen)

    def shown(at):
        marked = F.transform(F.slice(tokens, at + 1, F.lit(size)), lambda x: F.when(x.isin(*words), F.concat(F.lit("<<"), x, F.lit(">>"))).otherwise(x))
        return F.concat(F.when(at > 0, "...").otherwise(""), F.array_join(marked, " "), F.when(at + size < F.size(tokens), "...").otherwise(""))

    return let(start, shown)


def search(indexed, text: str, centrality: DataFrame | Callable[[DataFrame], DataFrame] | None = None, symbols: DataFrame | None = None, limit: int = 15, pool: int | None = None, size: int = 32) -> DataFrame:
    """(path, snippet, called_by[, symbol]) of the best hits: of the pool, the first max(4 * limit, 50) in path order, the most called.

    indexed is a table of index(), or a postings.Index, which reads the postings of the query's tokens and the texts of the
    pool only. centrality is (path, called_by), or makes that of the pool's (path).
    """
    words, most = tokens_of(text) or [""], pool or max(4 * limit, 50)
    if isinstance(indexed, DataFrame):
        found = indexed.where(predicate(text, F.col("padded"), F.col("tokens"))).orderBy("path").limit(most).select("path", "tokens")
    else:
        best = indexed.found(text).orderBy("doc").limit(most)
        found = indexed.texts().join(F.broadcast(best), ["doc", "part"]).select(F.col("doc").alias("path"), "tokens")  # at most `most` rows
    hits = found.select("path", snippet(F.col("tokens"), words, size).alias("snippet"))
    if callable(centrality):
        hits = kept(hits, "pool")  # at most `most` rows, read by what ranks them too
        centrality = centrality(hits.select("path").distinct())
    hits = hits.join(centrality, "path", "left").withColumn("called_by", F.coalesce("called_by", F.lit(0).cast("bigint"))) if centrality is not None else hits.withColumn("called_by", F.lit(0).cast("bigint"))
    if symbols is not None:
        term = text.strip().strip('"').split()[0] if text.strip().strip('"') else ""
        top = symbols.where(like(F.col("name"), f"%{term}%") if term else F.lit(False)).groupBy("path").agg(F.min_by("name", F.struct("line", "name")).alias("symbol"))
        hits = hits.join(top, "path", "left")
    return hits.orderBy(F.desc("called_by"), "path").limit(limit)
