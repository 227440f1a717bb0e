"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

A line's shingles are the SHINGLE characters that begin at each of its positions, spaces included; a shorter line is one
shingle. The SKETCH least hashes of its different shingles are its signature. Three signature values that follow each other,
or two in short lines, make a band key; the signature's bits, or-ed, make a fingerprint.

Equal lines are one class first. Classes that share a key are compared with the key's centre, if their sizes fit and their
fingerprints are alike enough, on the sets of all their shingles; links become components by union-find. Where a key
still joins different components, the members outside of its largest one are compared with a few others, and then,
where the key is still open, with all, by blocks. The parities of all shingles' hashes, in 64 * WORDS bits, turn pairs of
open keys away before they are rows: each shingle that only one line of a pair has flips one bit, so parities never differ
in more bits than the lines differ in shingles, and no link is lost by them. One line of each component stays.

Two lines of similarity 0.8 share no key three times in ten thousand, and never if they have up to SHORT_BANDS shingles. Their
fingerprints are not alike once in 100,000, or four times in ten thousand if one's shingles are all the other's.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import components, fresh, mapped, merged, removed, shared_dir, sifted, stored

SHINGLE, PERCENT = 8, 80
#: Signature values, those of them that make band keys, and how many a key takes.
SKETCH, BANDS, RUN = 28, 24, 3
#: The same for sets of up to SHORT shingles, whose keys take two.
SHORT, SHORT_BANDS = 25, 13
#: Members that others of a key are compared with before all, members in a block when all are compared, and words of 64
#: parities: in longer lines than two thousand characters fewer pairs are turned away, and more are compared on their texts.
SAMPLES, BLOCK, WORDS = 8, 1024, 16
PARITIES = [f"p{w}" for w in range(WORDS)]


def shingles(line: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n characters from every position on, or of a shorter line as a whole; repeated ones stay."""
    wide = F.encode(line, "UTF-32")  # four bytes a character: any position is found at once
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.length(b) - 4 * n, F.lit(0)) + 1, F.lit(4))
    return F.transform(F.array(wide), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substr(b, i, F.lit(4 * n)))))[0]


def hashes(line: Column) -> Column:
    """The hashes of the line's different shingles, in order."""
    return F.sort_array(F.array_distinct(shingles(line)))


def sketch(line: Column, every: Column) -> Column:
    """The SKETCH least of hashes(line); every: all shingles' hashes in order. Only where most of the least repeat are all made distinct."""
    few = F.array_distinct(F.slice(every, 1, 2 * SKETCH))
    enough = (F.size(few) >= SKETCH) | (F.size(every) <= 2 * SKETCH)
    return F.slice(F.when(enough, few).otherwise(hashes(line)), 1, SKETCH)


def band_keys(sig: Column) -> Column:
    """A key for each RUN of the first BANDS values that follow each other; for SHORT sets each two of their first values.

    Sets of up to three shingles are near only to equal ones and have one key. Two values in a row often come from one
    common word, so long lines would share them with very many lines that are not near. Sets around SHORT have keys of both
    kinds: of two near sets one has at most five shingles for four of the other.
    """
    run = lambda i, r: F.xxhash64(F.lit(r), *(F.get(sig, F.lit(i + j)) for j in range(r)))
    runs = lambda values, r: F.array_compact(F.array(*(F.when(F.size(sig) >= i + r, run(i, r)) for i in range(values - r + 1))))
    some = lambda when, values, r: F.when(when, runs(values, r)).otherwise(F.array().cast("array<bigint>"))
    both = F.concat(some(F.size(sig) <= SHORT, SHORT_BANDS, 2), some(5 * F.size(sig) >= 4 * SHORT, BANDS, RUN))
    return F.when(F.size(sig) <= 3, F.array(F.xxhash64(sig))).otherwise(both)


def fingerprint(sig: Column) -> list[Column]:
    """128 bits in two words, w0 and w1; each value of the signature sets one."""
    none = F.lit(0).cast("bigint")

    def word(w: int) -> Column:
        bit = lambda x: F.when(x.bitwiseAND(F.lit(64)) == 64 * w, F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int")))
        return functools.reduce(Column.bitwiseOR, (F.coalesce(bit(F.get(sig, F.lit(i))), none) for i in range(SKETCH)))

    return [word(0).alias("w0"), word(1).alias("w1")]


def alike() -> Column:
    """Whether the fingerprints of _side() rows a and b share three eighths or more of the bits that either sets."""
    count = lambda f: sum(F.bit_count(f(F.col(f"{w}_a"), F.col(f"{w}_b"))) for w in ("w0", "w1"))
    return 8 * count(Column.bitwiseAND) >= 3 * count(Column.bitwiseOR)


def fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m can be so similar."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def parities(texts: DataFrame) -> DataFrame:
    """(lid, p0, p1, ...) of lines (lid, line): for each of 64 * WORDS slots whether an odd number of different shingles falls there."""
    h = texts.select("lid", F.explode(F.array_distinct(shingles(F.col("line")))).alias("h"))
    word, bit = F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    x = h.select("lid", word.alias("word"), bit.alias("bit"))
    return x.groupBy("lid").agg(*(F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(p) for w, p in enumerate(PARITIES)))


def may_be_near(percent: int) -> Column:
    """Whether the parities of _side() rows a and b differ in no more bits than near lines may differ in shingles; true for all near ones."""
    differ = sum(F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES)
    return (100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, dkey, pos, line) of lines with a word. Rows equal in id and text share dkey, and so their fate."""
    return docs.select("doc_id", "dkey", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))


def _near(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of lines with 100 * |A and B| >= percent * |A or B| on their whole shingle sets."""
    x, y = (texts.select(F.col("lid").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab")
    some = lambda k: F.array_distinct(shingles(F.col(f"line_{k}")))
    sizes = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect(some("a"), some("b"))).alias("both"), "n_a", "n_b")
    return sizes.where((100 + percent) * F.col("both") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _texts(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(lid, w0, w1, n, line) of places (lid, dkey, pos, w0, w1); n: how many different shingles the line has."""
    some = sifted(lines.select("dkey", "pos", "line"), places, ["dkey", "pos"])
    n = F.size(F.array_distinct(shingles(F.col("line")))).alias("n")
    return some.join(places, ["dkey", "pos"]).dropDuplicates(["lid"]).select("lid", "w0", "w1", n, "line")


def _copied(lines: DataFrame) -> DataFrame:
    """(h1, h2, fdkey, fpos) of lines that stand more than once, and where they stand first."""
    groups = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos", "dkey")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return groups.select("h1", "h2", F.col("first.dkey").alias("fdkey"), F.col("first.pos").alias("fpos"))


def _firsts(lines: DataFrame, copied: DataFrame) -> DataFrame:
    """(doc_id, dkey, pos, line): of equal lines the first. Only lines that may have copies are shuffled with their texts."""
    seen = fresh(lines, "__seen")
    marked = mapped(lines, copied, ["h1", "h2"], seen)
    some = marked.where(seen).join(copied, ["h1", "h2"], "left").where("fpos is null or (dkey = fdkey and pos = fpos)").dropDuplicates(["h1", "h2"])
    columns = ("doc_id", "dkey", "pos", "line")
    return marked.where(~F.col(seen)).select(*columns).union(some.select(*columns))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct()


def _side(rows: DataFrame, k: str, *more) -> DataFrame:
    """One side of pairs. Its numbers are never null, and said to be so: the test of a pair is then half the code, and runs compiled."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(*more, F.col("lid").alias(k), *(number(c).alias(f"{c}_{k}") for c in ("root", "w0", "w1", "n", *PARITIES) if c in rows.columns))


def _alike(percent: int) -> Column:
    """The first test of a pair of _side() rows."""
    return fits(F.col("n_a"), F.col("n_b"), percent) & alike()


def _found(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "n_a", "n_b")


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), each pair once."""
    swap = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    return found.select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), swap("n_a", "n_b").alias("n_a"), swap("n_b", "n_a").alias("n_b")).distinct()


def _centred(members: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): lines and the centres of their keys, if alike."""
    pairs = members.where("lid <> centre").select(F.col("lid").alias("a"), F.col("centre").alias("b")).distinct()
    return pairs.join(_side(prints, "a"), "a").join(_side(prints, "b"), "b").where(_alike(percent)).select("a", "b", "n_a", "n_b")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, lid, root, other, blocks): the members of keys that still join different components.

    Two members of different components are never both of the key's largest one, so only the others go against all. The
    centre has met them all.
    """
    rooted = members.where("n > 2").join(roots.withColumnRenamed("node", "lid"), "lid", "left").select("key", "lid", "centre", F.coalesce("root", "lid").alias("root"))
    open_ = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("all"))
    open_ = open_.where("main.m < all").select("key", F.col("main.root").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    return rooted.join(open_, "key").where("lid <> centre").select("key", "lid", "root", (F.col("root") != F.col("main")).alias("other"), "blocks")


def _lesser(dealt: DataFrame) -> DataFrame:
    """The rows of _open() with lesser: those of the line's open keys that are less than this one, at most all its keys."""
    keys = dealt.groupBy("lid").agg(F.collect_list("key").alias("keys"))
    return dealt.join(keys, "lid").withColumn("lesser", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")


def _test(percent: int) -> Column:
    """The test of a pair of members of one open key before their lines are read."""
    return (F.col("root_a") != F.col("root_b")) & _alike(percent) & may_be_near(percent)


def _sampled(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): others of a key and those of its members with the least hashes in SAMPLES parts of them, if alike.

    Families grow together by these few pairs, which leaves few others for all pairs.
    """
    mark = F.xxhash64("lid")
    row = F.struct(mark.alias("mark"), "lid", "root", "w0", "w1", "n", *PARITIES)
    some = dealt.groupBy("key", F.pmod(mark, F.lit(SAMPLES)).alias("part")).agg(F.min(row).alias("m")).select("key", "m.*")
    return _pairs(_side(dealt.where("other"), "a", "key").join(_side(some, "b", "key"), "key").where(_test(percent)))


def _apart(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): all lines of different components that share a key and are alike.

    Members are dealt to blocks, so that a crowded key is many tasks. Keys of one block are dealt once for both sides. The
    members of a family share most of their keys; a pair is a row of the least of them only.
    """
    first = ~F.arrays_overlap("lesser_a", "lesser_b")
    single = dealt.where("blocks = 1").repartition("key")
    a, b = (_side(single, k, "key", F.col("other").alias(f"other_{k}"), F.col("lesser").alias(f"lesser_{k}")) for k in "ab")
    # as a sum, for a condition on one side alone would be pushed below the exchange, and there would be two of them
    one = F.col("other_a").cast("int") * 2 + (~F.col("other_b") | (F.col("a") < F.col("b"))).cast("int") == 3
    small = _found(a.join(b.hint("merge"), (a["key"] == b["key"]) & one & _test(percent) & first))
    dealt = dealt.where("blocks > 1")
    x = _side(dealt.where("other").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "a", "key", "block", F.col("lesser").alias("lesser_a"))
    y = _side(dealt, "b", "key", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int").alias("block"), "other", F.col("lesser").alias("lesser_b"))
    once = ~F.col("other") | (F.col("a") < F.col("b"))
    # a merge join: it tests the pairs of a block as they meet, so none but those alike are rows
    return _pairs(small.union(_found(x.join(y.hint("merge"), (x["key"] == y["key"]) & (x["block"] == y["block"]) & once & _test(percent) & first))))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(dkey, pos) of every line to drop; dkey is row_key(id, text).

    Of each component the line with the smallest (id, position) stays; a null id comes first. Lines without a word are
    no lines and stay. Null texts have no lines. Rows equal in id and text count as one. A line is hashed in one row: 12
    bytes for each of its characters, so a very long text without line feeds takes about that many times its size.
    """
    base = f"{shared_dir(docs.sparkSession).rstrip('/')}/line-classes-{uuid.uuid4().hex}"
    kept = lambda df, what: stored(df, what, base=base)
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("dkey"), F.col(text_col).alias("text"))
    lines = _lines(d, "text").select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    copied = kept(_copied(lines), "copied")
    every = _firsts(lines, copied).select("doc_id", "dkey", "pos", "line", F.sort_array(shingles(F.col("line"))).alias("every"))
    sets = every.select("doc_id", "dkey", "pos", sketch(F.col("line"), F.col("every")).alias("sig"))
    classes = kept(sets.select("doc_id", "dkey", "pos", *fingerprint(F.col("sig")), band_keys(F.col("sig")).alias("keys")).withColumn("lid", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("lid", F.explode("keys").alias("key")).repartition("key")  # dealt once, to be counted and joined
    centres = keyed.groupBy("key").agg(F.min("lid").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept(keyed.join(centres.hint("shuffle_hash"), "key"), "members")  # of keys with company, which are few of a task's keys
    places = kept(classes.select("lid", "dkey", "pos", "w0", "w1").join(members.select("lid").distinct(), "lid", "left_semi"), "places")
    texts = kept(_texts(lines, places), "texts")  # of lines with company, so that the documents are split once for them
    prints = texts.select("lid", "w0", "w1", "n")
    texts_of = lambda pairs: sifted(texts, _ends(pairs), ["lid"])
    pairs = kept(_centred(members, prints, percent), "pairs")
    roots = kept(components(_near(pairs, texts_of(pairs), percent)), "stars")
    dealt = kept(_open(members, roots), "open")
    mine = sifted(texts, dealt, ["lid"]).join(dealt.select("lid").distinct(), "lid", "left_semi")
    odd = kept(parities(mine).join(prints, "lid"), "parities")  # of keys open later, too
    for find in (_sampled, _apart):
        rows = dealt if find is _sampled else kept(_lesser(dealt), "lesser")
        pairs = kept(find(rows.join(odd, "lid"), percent), "more-pairs")
        roots = merged(roots, _near(pairs, texts_of(pairs), percent))
        dealt = kept(_open(members, roots), "open") if find is _sampled else dealt
    best = classes.select(F.col("lid").alias("node"), "doc_id", "pos", "dkey").join(roots, "node")
    keep = best.groupBy("root").agg(F.min(F.struct("doc_id", "pos", "node")).alias("m")).select(F.col("m.node").alias("node"))
    lost = kept(best.join(keep, "node", "left_anti").select("dkey", "pos"), "lost")  # whole classes that another line stands for
    gone = copied.join(lost.select(F.col("dkey").alias("fdkey"), F.col("pos").alias("fpos"), F.lit(True).alias("lost")), ["fdkey", "fpos"], "left")
    some = sifted(lines.select("dkey", "pos", "h1", "h2"), copied, ["h1", "h2"]).join(gone, ["h1", "h2"]).where("lost or dkey <> fdkey or pos <> fpos")
    out = stored(some.select("dkey", "pos").union(lost).distinct(), "repeated-lines")
    removed(docs.sparkSession, base)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of the row's id and text: by 64 alone, one document's lines would go for another's among very many."""
    row = (F.col(id_col), F.col(text_col))
    return F.struct(F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(1), *row).alias("k2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs, with all their columns and rows, and text_col without the lines that repeated_lines() names.

    A document that loses all its lines has an empty text; null texts stay null; an empty table stays empty.
    """
    key, gone = fresh(docs, "__line_key"), fresh(docs, "__lines_gone")
    drop = repeated_lines(docs, id_col, text_col, percent).groupBy("dkey").agg(F.sort_array(F.collect_list("pos")).alias(gone)).withColumnRenamed("dkey", key)
    n, start = F.size(gone), lambda i: F.when(i > 0, F.get(F.col(gone), i - 1) + 1).otherwise(0)
    part = lambda x, i: F.slice(x, start(i) + 1, F.when(i < n, F.get(F.col(gone), i)).otherwise(F.size(x)) - start(i))
    stretches = lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: part(x, i))), "\n")
    left = F.transform(F.array(F.split(F.col(text_col), "\n", -1)), stretches)[0]  # what lies between the lines that go
    # what is to go grows with the documents, so it is never broadcast, however small it may be here
    out = docs.withColumn(key, row_key(id_col, text_col)).join(drop.hint("merge"), key, "left")
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint")))
    return out.select("doc_id", "n_lines", "text")
