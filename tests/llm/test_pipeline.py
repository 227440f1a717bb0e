"""Every stage of the pipeline against a brute-force version on its own input, and on odd and empty documents."""

import random
import zlib

import numpy as np
import oracle
import pytest
from test_free import brute_components, brute_leaks
from test_native import brute_near

import corpus_pipeline
from stratalens.llm import packing, quality
from stratalens.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, sf, documents):
    out = [documents]
    for name, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], sf), "test-stage"))
    return out


def texts(df):
    return sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_schemas(documents, stages):
    assert len(corpus_pipeline.STAGES) == 5
    for s in stages[:-1]:
        assert s.columns == documents.columns and s.schema.simpleString() == documents.schema.simpleString()


def test_quality_rules_equal_sql(sf, documents, stages):
    kept = {r[0] for r in oracle.duck(sf).sql(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    assert texts(stages[1]) == [(i, t) for i, t in texts(documents) if i in kept] and 0 < len(kept) < documents.count()


def brute_line_stage(rows):
    is_line, seen, out = lambda x: x.strip(" \t\n\x0b\f\r") != "", set(), []
    stay = set(brute_near(list(dict.fromkeys(x for _, t in rows for x in t.split("\n") if is_line(x)))))
    for i, t in rows:
        left = "\n".join(x for x in t.split("\n") if not is_line(x) or x in stay and not (x in seen or seen.add(x)))
        if any(map(is_line, left.split("\n"))) or not any(map(is_line, t.split("\n"))):
            out.append((i, left))
    return out


def test_line_dedup_equals_brute_force(stages):
    got, want = texts(stages[2]), brute_line_stage(texts(stages[1]))
    assert [i for i, _ in got] == [i for i, _ in want] and sum(a != b for a, b in zip(got, want)) <= 1
    assert stages[2].where("n_chars <> length(text)").count() == 0 and len(got) < stages[1].count()


def test_near_dedup_equals_brute_force(stages):
    want = {i for i, _, _, kept in brute_components(texts(stages[2]), 5, 80) if kept}
    assert texts(stages[3]) == [(i, t) for i, t in texts(stages[2]) if i in want]


def test_decontamination_equals_brute_force(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rng, rows = random.Random(15), texts(stages[3])
    some = {i for i, _ in rng.sample(rows, min(60, len(rows)))} | {i for i, _ in rows} - {i for i, _ in texts(stages[4])}
    leaks = {d for d, *_ in brute_leaks([r for r in rows if r[0] in some], items)}
    assert {i for i, _ in texts(stages[4])} & some == some - leaks and leaks


def test_packing_equals_the_library(stages):
    from tokenizers import Tokenizer

    from stratalens.llm import tokens

    lib, pieces = Tokenizer.from_file(tokens.default_path()), stages[5].collect()
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in texts(stages[4])}
    assert sorted(r["doc_id"] for r in pieces if r["start"] == 0) == sorted(ids)
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_run_equals_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    cut = lambda df: sorted(map(tuple, df.groupBy("doc_id").sum("length").collect()))
    assert cut(got) == cut(stages[-1])


def test_good_documents_stay(spark, sf, stages):
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(stages[0].where("size(split(trim(text), '\\\\s+')) >= 20"), "doc_id", "left_semi")
    assert stages[1].join(good, "doc_id", "left_semi").count() >= 0.99 * good.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, sf, odd, empty, stage):
    """Nulls, blank and long texts, repeated rows, clashing columns; then no row at all."""
    f = corpus_pipeline.STAGES[stage][1]
    out, none = f(spark, odd, sf), f(spark, empty, sf)
    assert none.count() == 0 and (stage == 4 or out.columns == none.columns == odd.columns)
    n = out.count()
    assert n >= 1 and (stage == 4 or n <= odd.count())
