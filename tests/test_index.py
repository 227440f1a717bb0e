"""Versions of relations, and the positional index on top of them, against the predicate over whole token arrays."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import postings as P
from stratalens.operators import search as X
from stratalens.sources import sinks
from stratalens.sources.versions import Versions

QUERIES = ["the", "the cat", "cat OR dog", "the NOT cat", '"the cat"', "ca*", '"the ca" *', "^the", '^"the cat"', "NEAR(the dog, 1)", "NEAR(the dog)", "NEAR(cat dog the, 2)", 'NEAR("the cat" do*, 3)', "path:the", "content:cat", "(cat OR dog) AND the",
           "zzz", "zzz OR the", "the NOT zzz", "of:the", "", '"', "a AND", "(", "*", "NEAR(", "^", "+", "the + cat", "cat NOT (dog OR the)", "Été", "NEAR(the the, 0)", "^ca*", "zz*"]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "dog", "cats", "door", "été", "a1", "x-y", "the, cat", "of"]
    return [(i, rng.choice([None, "", "..."]) if i % 11 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(n)]


def plain(spark, rows, query):
    ix = X.index(spark.createDataFrame(rows, "doc int, t string"), "doc", "t")
    return sorted(r[0] for r in ix.where(X.predicate(query, F.col("padded"), F.col("tokens"))).select("path").collect())


@pytest.fixture(scope="module")
def rows():
    return texts(1, 60)


@pytest.fixture(scope="module")
def built(spark, rows, tmp_path_factory):
    return P.Index.create(spark.createDataFrame(rows, "doc int, t string"), f"file://{tmp_path_factory.mktemp('ix')}", "doc", "t", buckets=8, splits=2)


def hits(index, query):
    return sorted(r["doc"] for r in index.found(query).select("doc").collect())


@pytest.mark.parametrize("query", QUERIES)
def test_postings_find_what_the_predicate_finds(spark, built, rows, query):
    assert hits(built, query) == plain(spark, rows, query)


def test_a_search_reads_its_tokens_buckets_only(built):
    one = built.found('"the cat"')._jdf.queryExecution().executedPlan().toString()
    assert one.count("PartitionFilters") >= 2
    scans = [x for x in one.split("FileScan")[1:] if "postings" in x]
    assert scans and all("bucket" in x.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(token" in x for x in scans)
    word = built.found("the")._jdf.queryExecution().executedPlan().toString()
    assert "places" not in word.split("ReadSchema")[1]  # a single word needs no places


def test_an_added_document_touches_its_own_postings(spark, tmp_path):
    rows = texts(2, 30)
    folder = f"file://{tmp_path}/ix"
    first = P.Index.create(spark.createDataFrame(rows, "doc int, t string"), folder, "doc", "t", buckets=4)
    new = [(3, "wholly new door"), (99, "the cat again")]
    second = first.add(spark.createDataFrame(new, "doc int, t string"), "doc", "t")
    parts = second.manifest.relations["postings"]["parts"]
    assert parts[0] == first.manifest.relations["postings"]["parts"][0] and parts[1]["rows"] == 6
    now = [r for r in rows if r[0] != 3] + new
    third = second.remove(spark.createDataFrame([(5,)], "doc int"), "doc")
    last = [r for r in now if r[0] != 5]
    merged = third.compacted()
    for q in ("the", "door", "cat*", '"the cat"', "the NOT door", "NEAR(the cat, 2)", "^wholly"):
        assert hits(first, q) == plain(spark, rows, q) and hits(second, q) == plain(spark, now, q)
        assert hits(third, q) == hits(merged, q) == plain(spark, last, q)
    assert len(merged.manifest.relations["postings"]["parts"]) == 1
    count = lambda ix: sorted(map(tuple, ix.counts().collect()))
    assert count(third) == count(merged) and merged.versions.verified()
    got = {r["path"]: r["snippet"] for r in X.search(third, "again").collect()}
    assert got == {99: "the cat <<again>>"}


def test_a_rebuild_that_dies_leaves_the_old_index_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    frame = lambda n: spark.range(n).withColumn("x", F.col("id") * 2)
    assert sinks.write_index({"files": frame(3), "symbols": frame(4), "edges": frame(5)}, folder) == 1
    old = sinks.read_index(spark, folder)
    broken = frame(7).withColumn("x", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_index({"files": frame(9), "symbols": broken, "edges": frame(9)}, folder)
    v = Versions(spark, folder)
    assert v.numbers() == [1] and v.verified() and {n: d.count() for n, d in sinks.read_index(spark, folder).items()} == {"files": 3, "symbols": 4, "edges": 5}
    assert {x.split("/")[0] for x in v.expire()} == {"files", "symbols"}  # what the dead write left
    assert sinks.write_index({"files": frame(1), "symbols": frame(1), "edges": frame(0)}, folder) == 2
    assert old["files"].count() == 3 and sinks.read_index(spark, folder)["edges"].count() == 0 and sinks.read_index(spark, folder, version=1)["edges"].count() == 5
    v.write({"files": frame(2)}, append=True)
    assert v.read("files").count() == 3 and v.read("symbols").count() == 1 and v.manifest().version == 3
    gone = v.expire(keep=1)
    assert len(gone) == 3 and v.numbers() == [3] and v.verified()


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    v = Versions(spark, f"file://{tmp_path}/v")
    v.write({"a": spark.range(1)})
    late = Versions(spark, v.folder)
    seen = late.manifest()
    v.write({"a": spark.range(2)})
    monkeypatch.setattr(late, "manifest", lambda version=None: seen)
    with pytest.raises(RuntimeError):
        late.write({"a": spark.range(3)})
    assert v.read("a").count() == 2 and v.verified()


def test_damage_is_seen(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    v.write({"a": spark.range(5)})
    part = v.manifest().relations["a"]["parts"][0]["part"]
    spark.range(1).write.mode("append").parquet(f"{v.folder}/a/part={part}")
    assert not v.verified()


def test_nothing_there(spark, tmp_path):
    assert P.Index.open(spark, f"file://{tmp_path}/none") is None
    with pytest.raises(FileNotFoundError):
        Versions(spark, f"file://{tmp_path}/none").read("a")
    empty = P.Index.create(spark.createDataFrame([], "doc int, t string"), f"file://{tmp_path}/e", "doc", "t")
    assert hits(empty, "the") == [] and hits(empty, "t*") == [] and empty.counts().count() == 0


def test_tasks_grow_with_texts_and_postings(spark, tmp_path, monkeypatch):
    """Many tokens make more splits of a bucket, many postings more tasks of a search; what is found stays."""
    from stratalens import session

    rows = texts(8, 60)
    monkeypatch.setattr(P, "TASK_TOKENS", 40)
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    index = P.Index.create(spark.createDataFrame(rows, "doc int, t string"), f"file://{tmp_path}/ix", "doc", "t", buckets=2)
    files = index._read("postings").select(F.input_file_name().alias("f"), "bucket").distinct().groupBy("bucket").count().collect()
    assert all(r["count"] > 2 for r in files)
    plan = index.found('"the ca" *')._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    for q in ("the cat", "cat OR dog", "the NOT cat", "ca*", '"the ca" *', "NEAR(the dog, 1)"):
        assert hits(index, q) == plain(spark, rows, q)
