"""The call graph as set-oriented joins: what point queries in a loop would answer one by one."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.text import dotted, head, leaf
from stratalens.operators.reach import Lists, called, listed, reached, reached_in
from stratalens.session import dealt
from stratalens.sources.versions import kept

CALLABLE = ("function", "method", "class")
#: Pairs of a symbol and a caller that one task makes, about.
TASK_PAIRS = 1 << 27


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key: the earliest by seq. min_by combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(seq, *(c for c in rest if c != seq))).alias("__row"))
    return out.select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def unique_definers(symbols: DataFrame) -> DataFrame:
    """(name, to_path) of names that exactly one path defines; two minima tell it without a distinct count."""
    return symbols.groupBy("name").agg(F.min("path").alias("to_path"), F.max("path").alias("__hi")).where("to_path = __hi").drop("__hi")


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with to_path: the only definer of to_name, else null."""
    return targeted(edges.drop("to_path"), unique_definers(symbols))


def targeted(edges: DataFrame, definers: DataFrame) -> DataFrame:
    """edges with to_path, of unique_definers(). Where these are stored and few, the edges are not shuffled for them."""
    return edges.join(definers.withColumnRenamed("name", "to_name"), "to_name", "left")


def callees(resolved: DataFrame) -> DataFrame:
    return resolved.where("kind = 'call' and to_path is not null").select("from_path", "to_name", "to_path").distinct()


def grouped_calls(edges: DataFrame, rows: int = 0) -> DataFrame:
    """(leaf, from_path, from_name, names): what a caller calls under names of one leaf, each group once.

    rows tells about how many edges there are, where they are many.
    """
    key = ["leaf", "from_path", "from_name"]
    calls = edges.where("kind = 'call'").select(leaf(F.col("to_name")).alias("leaf"), "from_path", "from_name", "to_name")
    return dealt(calls, rows, *key).groupBy(*key).agg(F.collect_set("to_name").alias("names"))


def callers(edges: DataFrame, names: DataFrame, rows: int = 0) -> DataFrame:
    """(symbol, from_path, from_name, how) for each name asked for: exact calls, and leaf calls that are not exact ones.

    rows tells about how many edges there are, where they are many.
    """
    return callers_in(grouped_calls(edges, rows), names)


def callers_in(groups: DataFrame, names: DataFrame) -> DataFrame:
    """callers() of grouped_calls(). A group tells by itself which leaf calls are exact ones too, so that no row of the
    result is shuffled for it; the names asked for are stored first, and few of them go to all tasks."""
    asked = kept(names.select(F.col("name").alias("symbol")).distinct(), "asked")
    exact = groups.select(F.explode("names").alias("symbol"), "from_path", "from_name").join(asked, "symbol")
    by_leaf = asked.where(dotted(F.col("symbol"))).withColumn("leaf", leaf(F.col("symbol")))
    loose = groups.where(F.array_contains("names", F.col("leaf"))).join(by_leaf, "leaf").where(~F.array_contains("names", F.col("symbol")))
    return exact.withColumn("how", F.lit("exact")).unionByName(loose.select("symbol", "from_path", "from_name", F.lit("leaf").alias("how")))


def import_keys(edges: DataFrame) -> DataFrame:
    """(from_path, gate): what a file's imports open: every dot segment as a module, the last one as a class."""
    parts = F.split("to_name", "\\.")
    gates = F.concat(F.transform(parts, lambda s: F.concat(F.lit("m:"), F.lower(s))), F.array(F.concat(F.lit("c:"), F.lower(F.element_at(parts, -1)))))
    return edges.where("kind = 'import'").select("from_path", F.explode(gates).alias("gate")).distinct()


def _pairs(own: DataFrame, edges: DataFrame, stems: DataFrame, standard_stems=()) -> DataFrame:
    """(path, caller, classes): the files that another file's imports open to it, each pair once and stored; of a file whose
    module is not imported, only the classes that are, else null.
    """
    module = F.concat(F.lit("m:"), F.lower("stem"))
    opened = stems.where(~F.col("stem").isin(*standard_stems)) if standard_stems else stems
    keys = import_keys(edges)
    by_module = keys.where("gate LIKE 'm:%'").join(opened.select("path", module.alias("gate")).distinct(), "gate").where("from_path <> path")
    by_module = kept(by_module.select("path", F.col("from_path").alias("caller")).distinct(), "import-pairs").withColumn("classes", F.lit(None).cast("array<string>"))
    heads = own.where(dotted(F.col("name"))).select("path", head(F.col("name")).alias("c")).withColumn("gate", F.concat(F.lit("c:"), F.lower("c")))
    # few classes are asked for by their gates first; where imports name none of them there is no more to do
    some = edges.where("kind = 'import'").select("from_path", F.concat(F.lit("c:"), F.lower(F.substring_index("to_name", ".", -1))).alias("gate"))
    some = kept(some.join(kept(heads.select("gate").distinct(), "class-gates"), "gate", "left_semi").distinct(), "class-imports")
    if some.isEmpty():
        return by_module
    by_class = heads.join(some, "gate").where("from_path <> path").select("path", F.col("from_path").alias("caller"), "c")
    by_class = by_class.join(by_module.select("path", "caller"), ["path", "caller"], "left_anti").groupBy("path", "caller").agg(F.collect_set("c").alias("classes"))
    return by_module.union(kept(by_class.select("path", "caller", "classes"), "class-pairs"))


def _gated(symbols: DataFrame, edges: DataFrame, stems: DataFrame, standard_stems=()) -> tuple[DataFrame, Lists, DataFrame]:
    """(whole, of, leafs): the dotted names (path, name) that calls can meet as they are; the Lists of their and their
    leafs' callers; and what leaf names add to these calls, (path, caller, ids, exact), stored, a row a pair of files.

    exact tells whether the caller calls any whole name of the file too. The names of a file go with each pair as numbers,
    and a block's callers are looked up in bits, so that no symbol meets its callers' calls in a join.
    """
    own = kept(symbols.where(F.col("kind").isin(*CALLABLE)).select("path", "name").distinct(), "own-symbols")
    names = own.select("name").distinct()
    of = listed(names.union(names.select(leaf(F.col("name")))), edges.where("kind = 'call'").select(F.col("to_name").alias("name"), F.col("from_path").alias("caller")))
    some = of.lists.select("id").distinct()
    met = kept(of.names.join(some.withColumn("met", F.lit(True)), "id", "left").select("name", "id", F.coalesce("met", F.lit(False)).alias("met")), "met-names")
    # a name with its leaf: few rows, whatever the number of files
    both = met.withColumn("l", leaf(F.col("name"))).join(met.select(F.col("name").alias("l"), F.col("id").alias("l_id"), F.col("met").alias("l_met")), "l")
    both = kept(both.where("met or l_met").select("name", "id", "l_id"), "names-and-leafs")
    one = F.struct(F.col("l_id"), F.when(dotted(F.col("name")), F.col("id")).otherwise(-1).alias("id"), F.when(dotted(F.col("name")), head(F.col("name"))).alias("c"), F.col("id").alias("own"))
    files = own.join(both, "name").groupBy("path").agg(F.collect_list(one).alias("x"))
    asked = _pairs(own, edges, stems, standard_stems).join(files, "path")
    open_ = F.transform("x", lambda x: F.when(F.col("classes").isNull() | F.coalesce(F.array_contains("classes", x["c"]), F.lit(False)), x["l_id"]).otherwise(-1))
    # leafs that are open, whole names, and the names themselves; the last are not asked for, but come back
    asked = asked.select("path", "caller", F.concat(open_, F.col("x.id"), F.col("x.own")).alias("names"))
    size = (F.size("names") / 3).cast("int")
    hits = called(asked, of).withColumn("n", size)
    new = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("hit", k) & ~F.get("hit", k + F.col("n")))
    ids = F.transform(new, lambda k: F.get("names", k + 2 * F.col("n")))
    exact = F.exists(F.slice("hit", F.col("n") + 1, F.col("n")), lambda h: h)
    leafs = hits.select("path", "caller", ids.alias("ids"), exact.alias("exact")).where(F.size("ids") > 0)
    return own.where(dotted(F.col("name"))), of, kept(leafs, "leaf-callers")


def _by_leaf(leafs: DataFrame, of: Lists) -> DataFrame:
    return leafs.select("path", F.col("caller").alias("from_path"), F.explode("ids").alias("id")).join(of.names, "id").select("path", "name", "from_path")


def gated_callers(symbols: DataFrame, edges: DataFrame, stems: DataFrame, standard_stems=()) -> DataFrame:
    """(path, name, from_path): files that plausibly call each callable symbol of other files.

    A call of the leaf name counts if the caller imports the defining module or the class; a call of the whole dotted
    name counts by itself. stems is (path, stem). Imports are opened to one key per segment, so the gate is an equi-join, not
    a pattern match per pair. A row a pair: where a name has many definers and many callers, both numbers multiplied.
    """
    whole, of, leafs = _gated(symbols, edges, stems, standard_stems)
    # calls of the whole name are one row each as they are; only what the leaf adds to them is new
    return _met(whole, of).unionByName(_by_leaf(leafs, of))


def _met(whole: DataFrame, of: Lists, task: int = TASK_PAIRS) -> DataFrame:
    """(path, name, from_path) of whole (path, name): the other files that call each name, a row a pair, `task` pairs about in a task.

    A definer meets its name's lists of callers, which are opened last, so only the result has a row for a pair. A name of
    more pairs than a task takes has its definers dealt to several.
    """
    sizes = whole.groupBy("name").agg(F.count(F.lit(1)).alias("d")).join(of.counts(), "name").join(of.names, "name")
    sizes = kept(sizes.select("name", "id", (F.col("d") * F.col("n")).alias("pairs")), "pairs")
    total = sizes.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(-(-total // task), 2 * whole.sparkSession.sparkContext.defaultParallelism)
    sizes = sizes.select("name", "id", F.ceil(F.col("pairs") / task).alias("chunks"))
    block = kept(of.numbers.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "caller"))), lambda x: x["caller"]).alias("known")), "block-callers")
    lists = of.lists.join(sizes, "id").join(block, "block").select("name", F.transform("at", lambda i: F.get("known", i.cast("int"))).alias("callers"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    definers = whole.join(sizes.drop("id"), "name").select("path", "name", F.pmod(F.xxhash64("path"), F.col("chunks")).alias("chunk"))
    both = definers.repartition(tasks, "name", "chunk").join(lists.repartition(tasks, "name", "chunk"), ["name", "chunk"])
    return both.select("path", "name", F.explode("callers").alias("from_path")).where("from_path <> path")


def _less_own(whole: DataFrame, of: Lists, by_name: DataFrame) -> DataFrame:
    """whole (path, name) with what by_name (name, n, ...) says of its names, n less one where the file itself is a caller."""
    own = of.own(whole.join(of.names, "name").select("path", "id")).join(of.names, "id").select("path", "name", F.lit(1).alias("me"))
    return whole.join(by_name, "name").join(kept(own, "own-calls"), ["path", "name"], "left").withColumn("n", F.col("n") - F.coalesce("me", F.lit(0))).drop("me")


def first_callers(symbols: DataFrame, edges: DataFrame, stems: DataFrame, most: int, standard_stems=()) -> DataFrame:
    """(path, name, callers, n): of gated_callers(), the first `most` of each symbol in order, and how many there are.

    A name's first callers are found once and go to all of its definers, with one to spare for the definer itself.
    """
    whole, of, leafs = _gated(symbols, edges, stems, standard_stems)
    first = of.lists.select("id", "block", F.explode(F.slice("at", 1, most + 1)).alias("i")).join(of.numbers, ["block", "i"])
    first = first.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("caller")), 1, most + 1).alias("callers")).join(of.names, "id").select("name", "callers")
    by_name = _less_own(whole, of, kept(of.counts().join(first, "name"), "first-callers"))
    by_name = by_name.select("path", "name", F.array_remove("callers", F.col("path")).alias("callers"), "n")
    more, key = _by_leaf(leafs, of), ["path", "name"]
    few = more.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("from_path"))).where(F.col("rn") <= most).groupBy(*key).agg(F.collect_list("from_path").alias("callers"))
    by_leaf = few.join(more.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key).select("path", "name", "callers", "n")
    both = by_name.where("n > 0").union(by_leaf).groupBy(*key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("callers"))), 1, most).alias("callers"), F.sum("n").alias("n"))
    return both


def impact(callers_of: DataFrame) -> DataFrame:
    """(path, name, n_callers, file_total): callers of each symbol, and distinct callers of the file's symbols."""
    per = callers_of.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n_callers"))
    total = callers_of.select("path", "from_path").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("file_total"))
    return per.join(total, "path")


def impact_counts(symbols: DataFrame, edges: DataFrame, stems: DataFrame, standard_stems=()) -> DataFrame:
    """impact() of gated_callers(), without a row for any pair of a symbol and a caller of its whole name."""
    whole, of, leafs = _gated(symbols, edges, stems, standard_stems)
    per = _less_own(whole, of, of.counts()).select("path", "name", "n")
    added = leafs.select("path", F.explode("ids").alias("id")).groupBy("path", "id").agg(F.count(F.lit(1)).alias("n")).join(of.names, "id").select("path", "name", "n")
    per = per.union(added).groupBy("path", "name").agg(F.sum("n").alias("n_callers")).where("n_callers > 0")
    # a file's callers: those of its whole names, and those that only a leaf has led to
    new = leafs.where("not exact").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = reached_in(whole, of).union(new).groupBy("path").agg(F.sum("n").alias("file_total"))
    return per.join(total, "path").select("path", "name", "n_callers", "file_total")


def _calls(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'call'").select("from_path", "to_name").distinct()


def centrality_by_name(paths: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, called_by): distinct other files that call a name which the file defines; unresolved names count too.

    No pair of a file and a caller is a row (see reach.reached).
    """
    n = reached(symbols.select("path", "name"), edges.where("kind = 'call'").select(F.col("to_name").alias("name"), F.col("from_path").alias("caller")))
    return paths.select("path").distinct().join(n, "path", "left").select("path", F.coalesce("n", F.lit(0).cast("bigint")).alias("called_by"))


def centrality_of(few: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """centrality_by_name() of few paths (path), each once: only their names and the calls of these are looked at."""
    own = symbols.join(F.broadcast(few), "path").select("path", F.col("name").alias("to_name")).distinct()
    hits = edges.where("kind = 'call'").join(F.broadcast(own), "to_name").where("from_path <> path").select("path", "from_path").distinct()
    n = hits.groupBy("path").agg(F.count(F.lit(1)).alias("called_by"))
    return few.join(n, "path", "left").select("path", F.coalesce("called_by", F.lit(0).cast("bigint")).alias("called_by"))


def centrality_resolved(resolved: DataFrame) -> DataFrame:
    """(path, called_by) over resolved calls, calls of a file into itself included."""
    pairs = resolved.where("kind = 'call' and to_path is not null").select("to_path", "from_path").distinct()
    return pairs.groupBy(F.col("to_path").alias("path")).agg(F.count(F.lit(1)).alias("called_by"))


def file_graph(resolved: DataFrame) -> DataFrame:
    """(from_path, to_path, n_calls, calls): calls between two files in line order."""
    g = resolved.where("kind = 'call' and to_path is not null and from_path <> to_path")
    rows = F.array_sort(F.collect_list(F.struct("line", "from_name", "to_name")))
    out = g.groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("n_calls"), rows.alias("x"))
    text = F.array_join(F.transform("x", lambda r: F.concat(r["line"].cast("string"), F.lit(":"), r["from_name"], F.lit(">"), r["to_name"])), ",")
    return out.select("from_path", "to_path", "n_calls", text.alias("calls"))


def symbol_detail(symbols: DataFrame, asked: DataFrame, rows: int = 0) -> DataFrame:
    """(path, asked, status, found, candidates) for each (path, asked): exact name, else the only leaf match.

    rows tells about how many symbols there are, where they are many.
    """
    s = symbols.where(F.col("kind").isin(*CALLABLE)).select("path", "name")
    both = s.withColumn("asked", F.col("name")).withColumn("exact", F.lit(1)).union(s.where(dotted(F.col("name"))).withColumn("asked", leaf(F.col("name"))).withColumn("exact", F.lit(0)))
    key = ["path", "asked"]
    m = dealt(asked.select(*key), 2 * rows, *key).distinct().join(dealt(both, 2 * rows, *key), key, "left")
    g = m.groupBy("path", "asked").agg(F.max(F.when(F.col("exact") == 1, F.col("name"))).alias("e"), F.count("name").alias("n"), F.min("name").alias("one"), F.sort_array(F.collect_set("name")).alias("names"))
    status = F.when(F.col("e").isNotNull(), "found").when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("not found")
    return g.select("path", "asked", status.alias("status"), F.coalesce("e", F.when(F.col("n") == 1, F.col("one"))).alias("found"), F.when(F.col("e").isNull() & (F.col("n") > 1), F.array_join("names", ",")).alias("candidates"))


def dependents(resolved: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that call into a changed file, themselves not counted for themselves."""
    return resolved.where("to_path is not null and from_path <> to_path").join(changed.select(F.col("path").alias("to_path")).distinct(), "to_path", "left_semi").select(F.col("from_path").alias("path")).distinct()


def longest_prefix(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(to_name, path): the module whose dotted key is the longest prefix of the import; the first path wins a key."""
    parts = F.split("to_name", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    keys = modules.groupBy("key").agg(F.min("path").alias("path"))
    met = imports.select("to_name").distinct().select("to_name", F.posexplode(prefixes).alias("n", "key")).join(keys, "key")
    return met.groupBy("to_name").agg(F.max_by("path", "n").alias("path"))


def targets_or_null(resolved: DataFrame) -> DataFrame:
    """(from_path, to_name, to_path): null where one caller's name leads to several targets."""
    g = resolved.where("kind = 'call' and to_path is not null").groupBy("from_path", "to_name").agg(F.min("to_path").alias("lo"), F.max("to_path").alias("hi"))
    return g.select("from_path", "to_name", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("to_path"))


def shared_names(names: DataFrame, tokens_of, least: int = 2) -> DataFrame:
    """(a, b, shared) of names that share `least` tokens or more.

    Names meet under two tokens at once where two are wanted, so a token that very many names have pairs none of them.
    """
    t = names.select("name", F.array_sort(F.array_distinct(tokens_of(F.col("name")))).alias("tokens")).distinct()
    keys = F.flatten(F.transform("tokens", lambda x: F.transform(F.filter("tokens", lambda y: y > x), lambda y: F.array(x, y)))) if least > 1 else F.transform("tokens", lambda x: F.array(x))
    k = t.select("name", "tokens", F.explode(keys).alias("k"))
    met = k.alias("x").join(k.alias("y"), F.col("x.k") == F.col("y.k")).where(F.col("x.name") < F.col("y.name"))
    pairs = met.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.size(F.array_intersect("x.tokens", "y.tokens")).cast("bigint").alias("shared")).distinct()
    return pairs.where(F.col("shared") >= least)


def name_classes(names: DataFrame, tokens_of) -> DataFrame:
    """(name, class, tokens): names with equal tokens are one class, known by the least of them; each name once.

    tokens are in the order of their frequency among classes, rarest first, ties by the token.
    """
    t = names.select("name", F.array_sort(F.array_distinct(tokens_of(F.col("name")))).alias("set")).distinct()
    classes = t.groupBy("set").agg(F.min("name").alias("class"))
    n = classes.select(F.explode("set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    placed = classes.select("class", F.explode("set").alias("token")).join(n, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    ordered = classes.join(placed, "class", "left").select("set", "class", F.coalesce(F.transform("o", lambda x: x["token"]), F.array().cast("array<string>")).alias("tokens"))
    return t.join(ordered, "set").select("name", "class", "tokens")


#: Sets of more tokens are counted by joins, not by their subsets.
SUBSET_TOKENS = 10


def name_links(classes: DataFrame, least: int = 2, most_tokens: int = SUBSET_TOKENS) -> DataFrame:
    """(name, class, n_links): with how many other names a name shares `least` tokens or more. No pair of names is a row.

    A class of m tokens reads from its subsets how many names share any `least` of them: with N(T) names that have all of T,
    the sum over its subsets T of k >= least tokens of (-1)^(k - least) * C(k - 1, least - 1) * N(T). Rows are names times
    subsets. Classes of more than most_tokens tokens meet the others by single tokens, and are counted as they are.
    """
    sizes = classes.groupBy("class", "tokens").agg(F.count(F.lit(1)).alias("n"))
    short, long = sizes.where(F.size("tokens") <= most_tokens), sizes.where(F.size("tokens") > most_tokens)
    bits = F.sequence(F.lit(1), F.greatest(F.pow(F.lit(2), F.size("tokens")).cast("int") - 1, F.lit(1)))
    chosen = F.filter(bits, lambda b: (F.bit_count(b) >= least) & (b < F.pow(F.lit(2), F.size("tokens"))))
    # the subset in an order that all classes share
    of = F.transform(chosen, lambda b: F.array_sort(F.filter("tokens", lambda _, i: F.getbit(b, i) == 1)))
    subsets = short.select("class", "n", F.explode(of).alias("t"))
    held = subsets.groupBy("t").agg(F.sum("n").alias("held"))
    binom = functools.reduce(lambda a, j: a * (F.size("t") - j) / j, range(1, least), F.lit(1.0)) if least > 1 else F.lit(1.0)
    sign = F.when((F.size("t") - least) % 2 == 0, 1).otherwise(-1)
    by_subsets = subsets.join(held, "t").groupBy("class").agg(F.sum(sign * F.round(binom).cast("bigint") * F.col("held")).alias("met"))
    # long ones: pairs of a long class and any class under their first common token
    x, y = long.select(F.col("class").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na")), sizes.select(F.col("class").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    met = x.withColumn("k", F.explode("ta")).join(y.withColumn("k", F.explode("tb")), "k")
    met = met.where((F.size(F.array_intersect("ta", "tb")) >= least) & (F.get(F.array_intersect("ta", "tb"), F.lit(0)) == F.col("k")))
    short_b = F.size("tb") <= most_tokens
    by_joins = met.select(F.col("a").alias("class"), F.col("nb").alias("met")).union(met.where(short_b).select(F.col("b").alias("class"), F.col("na").alias("met"))).groupBy("class").agg(F.sum("met").alias("met"))
    total = by_subsets.union(by_joins).groupBy("class").agg(F.sum("met").alias("met"))
    own = F.when(F.size("tokens") >= least, 1).otherwise(0)  # a name meets itself
    return classes.join(total, "class", "left").select("name", "class", (F.coalesce("met", F.lit(0)) - own).cast("bigint").alias("n_links"))


def class_pairs(classes: DataFrame, least: int = 2, block: int = 1024) -> DataFrame:
    """(a, b, shared): the pairs of classes that share `least` tokens or more, each once, a < b.

    Two such classes share one of the tokens before their last least - 1 ones, in the order of frequency, so the most
    frequent tokens of a class bring no candidates; a candidate's first common token must leave room for the others
    behind it. A token's classes are dealt to blocks, so a very frequent one is many tasks.
    """
    c = classes.select("class", "tokens").distinct().where(F.size("tokens") >= least)
    prefix = F.slice("tokens", 1, F.size("tokens") - (least - 1))
    k = c.select("class", "tokens", F.posexplode(prefix).alias("at", "k"))
    blocks = k.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    k = k.join(blocks, "k").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    x = k.select("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("class").alias("a"), F.col("tokens").alias("ta"), F.col("at").alias("i"))
    y = k.select("k", F.col("own").alias("block"), F.col("class").alias("b"), F.col("tokens").alias("tb"), F.col("at").alias("j"))
    room = F.least(F.size("ta") - F.col("i"), F.size("tb") - F.col("j")) >= least  # the token itself and those behind it
    met = x.join(y, ["k", "block"]).where((F.col("a") < F.col("b")) & room)
    both = F.array_intersect("ta", "tb")
    return met.where(F.get(both, F.lit(0)) == F.col("k")).select("a", "b", F.size(both).cast("bigint").alias("shared")).where(F.col("shared") >= least)


def stats(files: DataFrame, symbols: DataFrame, resolved: DataFrame, sidecars: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    parts = [files.agg(n.alias("files")), symbols.agg(n.alias("symbols")), resolved.agg(n.alias("edges"), F.count("to_path").alias("resolved_edges")), sidecars.agg(n.alias("sidecars"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
