"""A positional inverted index: postings by token, kept in versions, and queries evaluated by joins of postings.

  postings    (token, doc, n, places), partitioned by bucket, a hash of the token; places are sorted, and the file format
              stores them as deltas
  dictionary  (token, n_docs, n), in token order, so that a prefix reads the row groups that can hold it
  texts       (doc, tokens), for excerpts
  gone        (doc): earlier entries of a document in older parts are void

A search reads the buckets of its own tokens only, which the scan's partition filter shows. Adding a document writes a part
with its postings and voids its older ones; no other document's postings are read or written. compacted() merges the parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.text import search_tokens
from stratalens.operators.search import NOTHING, parsed
from stratalens.session import dealt
from stratalens.sources.versions import Manifest, Versions

BUCKETS = 16
#: Tokens of a task that makes postings, about: there are as many splits of a bucket as that takes.
TASK_TOKENS = 1 << 20
RELATIONS = ("postings", "dictionary", "texts", "gone")
DOC = ["doc", "part"]


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), search_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


class Index:
    """One opened version of an index; searches see that version, whatever is written meanwhile."""

    def __init__(self, versions: Versions, manifest: Manifest, buckets: int = BUCKETS, splits: int = 1):
        self.versions, self.manifest, self.buckets, self.splits = versions, manifest, buckets, splits

    @staticmethod
    def open(spark: SparkSession, folder: str, buckets: int = BUCKETS, splits: int = 1) -> Index | None:
        """The current version; None where nothing was written yet. buckets and splits are those of its first write."""
        v = Versions(spark, folder)
        m = v.manifest()
        return Index(v, m, buckets, splits) if m else None

    @staticmethod
    def create(docs: DataFrame, folder: str, id_col: str, text_col: str, buckets: int = BUCKETS, splits: int = 1) -> Index:
        """A new index of docs in place of what the folder's current version holds."""
        v = Versions(docs.sparkSession, folder)
        new = Index(v, Manifest(0, {}), buckets, splits)
        new._write(tokenised(docs, id_col, text_col), append=False)
        return Index(v, v.manifest(), buckets, splits)

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> Index:
        """The next version, with these documents new or in place of their earlier texts."""
        self._write(tokenised(docs, id_col, text_col), append=True)
        return Index(self.versions, self.versions.manifest(), self.buckets, self.splits)

    def remove(self, docs: DataFrame, id_col: str) -> Index:
        """The next version, without these documents."""
        self.versions.write({"gone": docs.select(F.col(id_col).alias("doc")).distinct()}, append=True)
        return Index(self.versions, self.versions.manifest(), self.buckets, self.splits)

    def compacted(self) -> Index:
        """The next version, with all living documents in one part."""
        self._write(self.texts().select("doc", "tokens"), append=False)
        return Index(self.versions, self.versions.manifest(), self.buckets, self.splits)

    def _write(self, docs: DataFrame, append: bool) -> None:
        def postings(written):
            at = written["texts"].select("doc", F.posexplode("tokens").alias("place", "token"))
            tokens = written["texts"].agg(F.sum(F.size("tokens"))).first()[0] or 0
            splits = max(self.splits, -(-tokens // (self.buckets * TASK_TOKENS)))
            at = at.withColumn("bucket", bucket_of(F.col("token"), self.buckets)).withColumn("split", F.pmod(F.xxhash64("doc"), F.lit(splits)))
            # dealt once, by bucket and a split of it: a token of every document is as many tasks as splits
            posts = at.repartition(self.buckets * splits, "bucket", "split").groupBy("bucket", "split", "token", "doc").agg(F.sort_array(F.collect_list("place")).alias("places"))
            return posts.select("token", "doc", F.size("places").alias("n"), "places", "bucket").sortWithinPartitions("bucket", "token", "doc")

        def dictionary(written):
            words = written["postings"].groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
            return words.repartitionByRange("token").sortWithinPartitions("token")

        # texts are tokenised once; the others are made of what was written
        tables = {"texts": docs.select("doc", "tokens"), "postings": postings, "dictionary": dictionary, "gone": lambda written: written["texts"].select("doc").distinct()}
        self.versions.write(tables, append=append, partitions={"postings": ["bucket"]})

    # ---- relations

    def _read(self, name: str) -> DataFrame:
        return self.versions.read(name, self.manifest, with_part=True)

    def alive(self, docs: DataFrame) -> DataFrame:
        """docs (doc, part, ...) without those that a later part has voided. One part voids nothing."""
        if len(self.manifest.relations["gone"]["parts"]) < 2:
            return docs
        gone = self._read("gone").groupBy(F.col("doc").alias("d")).agg(F.max("part").alias("p"))
        return docs.join(gone, (F.col("doc") == F.col("d")) & (F.col("part") < F.col("p")), "left_anti")

    def texts(self) -> DataFrame:
        """(doc, part, tokens) of the living documents."""
        return self.alive(self._read("texts"))

    def counts(self) -> DataFrame:
        """(token, n, files) over the living documents; of one part, the dictionary itself."""
        if len(self.manifest.relations["gone"]["parts"]) < 2:
            return self._read("dictionary").select("token", "n", F.col("n_docs").alias("files"))
        return self.alive(self._read("postings").select("token", "doc", "part", "n")).groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))

    def _of(self, word: str) -> DataFrame:
        return self._read("postings").where((F.col("bucket") == bucket_of(F.lit(word), self.buckets)) & (F.col("token") == word))

    def _starting(self, prefix: str) -> DataFrame:
        """Postings of the tokens with a prefix; the dictionary says in which buckets they are."""
        hit = self._read("dictionary").where(F.col("token").startswith(prefix)).select(bucket_of(F.col("token"), self.buckets).alias("b")).distinct()
        buckets = sorted(r["b"] for r in hit.collect())  # not more than there are buckets
        return self._read("postings").where(F.col("bucket").isin(buckets) & F.col("token").startswith(prefix)) if buckets else self._read("postings").where("false")

    # ---- queries

    def found(self, text: str) -> DataFrame:
        """(doc, part) of the living documents that match a query; text that is no query is one phrase."""
        tree = parsed(text)
        self._n = self._frequencies(tree)
        # frames that meet are dealt alike, by the most documents that one of them can have
        self._rows = max([*self._n.values(), *(self._n_starting(p) for p in _prefixes(tree))], default=0)
        return self.alive(self._eval(tree))

    def _frequencies(self, tree) -> dict[str, int]:
        words = sorted(set(_words(tree)))
        if not words:
            return {}
        rows = self._read("dictionary").where(F.col("token").isin(words)).groupBy("token").agg(F.sum("n_docs").alias("n")).collect()  # one row a word of the query
        return {r["token"]: r["n"] for r in rows}

    def _n_starting(self, prefix: str) -> int:
        """Postings of the tokens with a prefix."""
        return self._read("dictionary").where(F.col("token").startswith(prefix)).agg(F.sum("n_docs")).first()[0] or 0

    def _dealt(self, df: DataFrame) -> DataFrame:
        return dealt(df, self._rows, *DOC)

    def _eval(self, t) -> DataFrame:
        kind = t[0]
        if kind == "or":
            return self._dealt(self._eval(t[1]).union(self._eval(t[2]))).distinct()
        if kind == "and":
            return self._dealt(self._eval(t[1])).join(self._dealt(self._eval(t[2])), DOC, "left_semi")
        if kind == "not":
            return self._dealt(self._eval(t[1])).join(self._dealt(self._eval(t[2])), DOC, "left_anti")
        if kind == "phrase":
            _, words, prefix, first = t
            if len(words) == 1 and not first:  # places are not read
                return self._dealt(self._starting(words[0]).select(*DOC)).distinct() if prefix else self._of(words[0]).select(*DOC)
            at = self._places(words, prefix)
            return at.where(F.array_contains("at", 0)).select(*DOC) if first else at.select(*DOC)
        if kind == "near":
            return self._near(*t[1:])
        return self._read("texts").where("false").select(*DOC)

    def _places(self, words: list[str], prefix: bool) -> DataFrame:
        """(doc, part, at): where a phrase begins. Postings meet rarest token first, so what is joined on only shrinks."""
        order = sorted(range(len(words)), key=lambda k: (prefix and k == len(words) - 1, self._n.get(words[k], 0)))
        out = None
        for k in order:
            if prefix and k == len(words) - 1:
                one = self._dealt(self._starting(words[k]).select(*DOC, "places"))
                if out is not None:  # only the places of documents that have the words before
                    one = one.join(out.select(*DOC), DOC, "left_semi")
                one = one.groupBy(*DOC).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
            else:
                one = self._of(words[k])
                one = self._dealt(one.select(*DOC, "places")) if len(words) > 1 else one
            one = one.select(*DOC, _back(F.col("places"), k).alias("at" if out is None else "more"))
            out = one if out is None else out.join(one, DOC).select(*DOC, F.array_intersect("at", "more").alias("at"))
            out = out.where(F.size("at") > 0)
        return out

    def _near(self, groups: list, distance: int) -> DataFrame:
        """Documents where some place of the first phrase has a place of every other one within distance tokens.

        Places meet by blocks of the reach around a place, so frequent phrases are not compared place by place.
        """
        size = [len(w) for w, _ in groups]
        first = self._places(*groups[0]).select(*DOC, F.explode("at").alias("i"))
        for (words, prefix), n in zip(groups[1:], size[1:]):
            reach = distance + n + size[0]
            other = self._places(words, prefix).select(F.col("doc").alias("d"), F.col("part").alias("p"), F.explode("at").alias("j"))
            other = other.withColumn("b", F.expr(f"floor(j / {reach})"))
            here = first.select("*", F.explode(F.array(*(F.floor(F.col("i") / reach) + k for k in (-1, 0, 1)))).alias("block"))
            gap = F.when(F.col("j") > F.col("i"), F.col("j") - F.col("i") - size[0]).otherwise(F.col("i") - F.col("j") - n)
            on = (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")) & (gap <= distance)
            first = here.join(other, on, "left_semi").select(*DOC, "i").distinct()
        return first.select(*DOC).distinct()


def _back(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def _prefixes(t) -> list[str]:
    if t[0] == "phrase":
        return [t[1][-1]] if t[2] else []
    if t[0] == "near":
        return [ws[-1] for ws, prefix in t[1] if prefix]
    return reduce(lambda a, b: a + b, (_prefixes(x) for x in t[1:]), []) if t != NOTHING else []


def _words(t) -> list[str]:
    if t[0] == "phrase":
        return list(t[1])
    if t[0] == "near":
        return [w for ws, _ in t[1] for w in ws]
    return reduce(lambda a, b: a + b, (_words(x) for x in t[1:]), []) if t != NOTHING else []
