"""Decontamination, near-dedup, packing, token files, archives and scores against brute force, and on odd rows."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratalens.llm import common, decontaminate, huffman, lm, neardup, packing, warc
from stratalens.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoded(documents):
    """Ids by the library alone, a text at a time."""
    encoder = Encoder()
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    return {i: np.frombuffer(b, "<u4") for (i, _), b in zip(rows, encoder._whole([t for _, t in rows]))}


def test_encoder_equals_library():
    rng, encoder = random.Random(1), Encoder()
    letters = "abZé 'sllre\n\t\r\x85\xa0\x1c\x00 1²½_!?…“€ʼnß '  日本語  "
    texts = ["".join(rng.choices(letters, k=40)) for _ in range(3000)] + ["<|endoftext|> a", "", None]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == np.frombuffer(encoder._whole([t or ""])[0], "<u4").tolist()


def test_added_tokens_as_by_the_library_itself():
    from tokenizers import Tokenizer

    from stratalens.llm import tokens

    lib = Tokenizer.from_file(tokens.default_path())
    texts = ["a<|endoftext|> b", "<|endoftext|>", "x <|endoftext|>\n<|endoftext|> y", "<|endoftext> z", "plain words"]
    assert [x.tolist() for x in Encoder().encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert Encoder().encode(texts[:1])[0].tolist() == [64, 50256, 275]


def test_packing(spark, sf, encoded):
    pieces, by, seq = packing.op7_packing(spark, sf).collect(), defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.append(encoded[r["doc_id"]], packing.END_ID).astype("<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        by[r["doc_id"]].append((r["start"], r["length"]))
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, total in [(by[i], len(encoded[i]) + 1) for i in encoded] + [(v, None) for v in seq.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == total if total else at <= packing.CAPACITY and (at == packing.CAPACITY or at & (at - 1) == 0)


def test_best_fill_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = Counter(rng.choices(range(1, 30), k=rng.randrange(1, 8)))
        items, cap = list(counts.elements()), rng.randrange(1, 80)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        best, used = packing.best_fill(counts, cap)
        assert best == max(s for s in sums if s <= cap) == sum(k * n for k, n in used.items()) and all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("lengths", [[1500] * 3000, [2047, 1] * 500 + [3] * 5, [700, 701, 702] * 900, [1]])
def test_packing_is_bounded_and_without_padding(lengths):
    """Whatever the lengths: a window holds no more, all ids come out in order, and only the last sequences are short."""
    p, most, rows = packing.Packer(0, window=400, window_ids=1 << 18), 0, []
    for i, n in enumerate(lengths):
        p.add(i, np.full(n, i, "<u4"))
        most = max(most, p.n_held)
        rows += p.take().to_pylist()
    p.finish()
    rows += p.take().to_pylist()
    seq, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.full(r["length"], r["doc_id"], "<u4").tobytes())
    for parts, total in [*((v, None) for v in seq.values()), *((docs[i], n) for i, n in enumerate(lengths))]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == total if total else at & (at - 1) == 0
    assert most < 400 and sum(n < 2048 for n in (sum(n for _, n in v) for v in seq.values())) <= 11


def test_closest_fill_decides_where_none_is_exact():
    done, left = packing.closest({1500: 1, 500: 1, 300: 1, 200: 1}, 2048, lambda pieces, ids: False)
    assert done == [([1500, 500], 1, (300, 48))] and left == {252: 1, 200: 1}


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 1)
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1] and packing.pack(empty).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(3)
    for n, limit in ((2, 8), (5, 8), (40, 20), (300, 9)):
        counts = rng.zipf(1.3, n).clip(1, 10**7)
        bits = huffman.code_lengths(counts, limit)
        assert bits.max() <= limit and sum(2.0 ** -b for b in bits.astype(float)) <= 1
        if limit >= n or limit == 20:
            heap, cost = counts.tolist(), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                a = heapq.heappop(heap) + heapq.heappop(heap)
                cost += a
                heapq.heappush(heap, a)
            assert cost == int((counts * bits).sum())


def test_block_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 5000):
        ids = rng.zipf(1.5, n).clip(0, 999).astype("<u4")
        bits = huffman.code_lengths(np.bincount(ids, minlength=1000), huffman.limit_for(1000))
        data = huffman.encode_block([(None, ids[: n // 2]), (7, ids[n // 2 :])], 5, bits, huffman.canonical(bits))
        first, names, lengths, back = huffman.decode_block(data, huffman.decode_table(bits))
        assert first == 5 and names.tolist() == [huffman.NULL_ID, 7] and lengths.tolist() == [n // 2, n - n // 2] and back.tolist() == ids.tolist()


def test_token_files(spark, sf, encoded):
    want, at = [], 0
    for i in sorted(encoded):
        ids = np.append(encoded[i], huffman.END_ID).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, huffman.op8_token_files(spark, sf).collect())) == want


def test_token_files_of_many_shards(spark, sf, documents, monkeypatch):
    """Starts run on over shards and over stretches of shards."""
    want = sorted(map(tuple, huffman.op8_token_files(spark, sf).collect()))
    monkeypatch.setattr(huffman, "SHARD_TOKENS", 1 << 13)
    monkeypatch.setattr(huffman, "STRETCH", 4)
    assert sorted(map(tuple, huffman.op8_token_files(spark, sf).collect())) == want


def test_token_files_odd_rows(spark, odd, empty):
    got = huffman.read_tokens(spark, huffman.write_tokens(odd), with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8] and got[3]["n_tokens"] == 1
    assert np.frombuffer(got[1]["ids"], "<u4")[:-1].tolist() == Encoder().encode(["alpha beta gamma delta epsilon"])[0].tolist()
    assert huffman.read_tokens(spark, huffman.write_tokens(empty)).count() == 0


def test_warc(spark):
    big = "é" * 300_000
    rows = [(1, "u", "x" * 1000), (2, "u", "x" * 1000), (None, "u", "x" * 1000), (3, None, None), (3, "a b", ""), (4, "u", big), (5, "u", big), (6, "u", "x" * 999), (7, "u", "x" * 999)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(0, 1000, "revisit", 2), (1, 1000, "revisit", 2), (2, 1000, "response", None), (3, 0, "response", None), (3, 0, "response", None), (4, 600000, "revisit", 5), (5, 600000, "response", None), (6, 999, "response", None), (7, 999, "response", None)]
    chunks = spark.read.parquet(path)
    assert chunks.selectExpr("max(octet_length(data)) AS n").first()["n"] <= warc.CHUNK_BYTES + 500
    out = io.BytesIO()
    for a in sorted(r["archive"] for r in chunks.select("archive").distinct().collect()):
        warc.export(spark, path, a, out)
    raw, records = out.getvalue(), 0
    while raw:  # the exported file parses as WARC
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        raw, records = rest[n + 4 :], records + 1
    assert records == len(rows)
    bad = f"{path}-bad"
    chunks.selectExpr("archive", "record", "chunk", "last", "sha1_so_far", "CASE WHEN chunk = 1 THEN cast('?' AS binary) ELSE data END AS data").write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, bad).collect()
    assert warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], "page_id bigint, html string"))).count() == 0


def test_warc_large_group_and_odd_columns(spark):
    """A third of the pages share a payload; payloads of whole and broken chunks; columns named like the operator's own."""
    n, chunk = 300, warc.CHUNK_BYTES
    rows = [(i, f"http://h/{i}", "same " * 300 if i % 3 == 0 else f"page {i} " * (i % 7 * 40), i) for i in range(n)]
    rows += [(n + k, "u", "z" * size, 0) for k, size in enumerate((chunk - 1, chunk, chunk + 1, 3 * chunk))] + [(n, "u", "z" * (chunk - 1), 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, salt bigint").selectExpr("*", "1 AS body", "2 AS payload_sha1", "'x' AS chunk", "4 AS first_id", "5 AS pieces", "6 AS data")
    path = warc.write_archives(df.repartition(7))
    got = sorted(map(tuple, warc.read_archives(spark, path).collect()), key=str)
    first = {}
    for i, _, t, _ in rows:
        first[t] = max(i, first.get(t, -1))
    refers = lambda i, t: first[t] if len(t) >= 1000 and first[t] != i else None
    want = [(i, len(t), hashlib.sha1(t.encode()).hexdigest(), "response" if refers(i, t) is None else "revisit", refers(i, t)) for i, _, t, _ in rows]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(path).selectExpr("max(octet_length(data)) AS n").first()["n"] <= chunk + 500
    assert spark.read.parquet(path).where("chunk > 0").groupBy("archive", "record").count().count() == 2


def brute_leaks(docs, items):
    w = decontaminate.Words()
    items, out = [(i, w(t)) for i, t in items], []
    for d, t in docs:
        x = w(t)
        for i, y in items:
            if len(x) and len(y):
                out += [(d, *r) for r in decontaminate.best_of((i, *decontaminate.overlap(x, y, s)) for s in range(-len(y) + 1, len(x)))]
    return sorted(out, key=str)


def test_leaks_equal_brute_force_both_ways(spark):
    rng, words = random.Random(6), [f"w{i}" for i in range(500)]
    say = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(say(rng.randrange(4, 40)))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(99, None), (98, "")]
    for i in range(60):
        t = say(rng.randrange(20, 120))
        if i % 2:
            p = (items[i % 12][1]).split()
            p = [rng.choice(words) if rng.random() < (i % 5) * 0.06 else x for x in p]
            at = rng.randrange(len(t))
            t = t[:at] + p[: rng.randrange(len(p) // 2, len(p) + 1)] + t[at:]
        docs.append((i, " ".join(t).capitalize()))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    small = sorted(map(tuple, decontaminate.find_leaks(d, b).collect()), key=str)
    assert small == sorted(map(tuple, decontaminate.find_leaks(d, b, broadcast_seeds=0).collect()), key=str)
    want = brute_leaks(docs, items)
    assert set(small) <= set(want) and len(small) >= 0.95 * len(want) and len(want) > 10
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in small}


def test_short_items_are_found_whatever_is_substituted(spark):
    items = [(n, [f"i{n}w{j}" for j in range(n)]) for n in range(1, 13)]
    docs = []
    for n, w in items:
        for k in range(n // 5 + 1):
            for gone in itertools.combinations(range(n), k):
                docs.append((len(docs) * 100 + n, " ".join(["before", *("other" if j in gone else x for j, x in enumerate(w)), "after"])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id bigint, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, broadcast_seeds=most).collect()}
        assert got == {(i, i % 100) for i, _ in docs}


def test_longest_stretch_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        same = np.array([rng.random() < 0.8 for _ in range(rng.randrange(1, 40))], float)
        s, k, n = decontaminate.best_stretch(same, 5, 0.8)
        good = [j - i for i in range(len(same)) for j in range(i + 5, len(same) + 1) if same[i:j].sum() >= 0.8 * (j - i) - 1e-9]
        assert k == max(good, default=0) and (not k or n == same[s : s + k].sum() >= 0.8 * k - 1e-9)


def test_leaks_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (None, "one")], "item_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in decontaminate.find_leaks(odd, b).collect()) == [(0, 1), (1, 1), (1, 1), (7, 0)]
    assert decontaminate.drop_leaks(odd, b).columns == odd.columns and decontaminate.find_leaks(empty, b).count() == 0
    assert decontaminate.drop_leaks(odd, b.where("false")).count() == odd.count()


def brute_components(docs, k, percent):
    sets, inv, parent = [(i, neardup.shingle_set(t, k)) for i, t in docs], defaultdict(list), {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        c = Counter(m for x in s for m in inv[x])
        for x in s:
            inv[x].append(n)
        for m, both in c.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                a, b = sorted((find(i), find(sets[m][0])))
                parent[b] = a
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_near_duplicates_equal_brute_force(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(map(tuple, neardup.op3_near_duplicates(spark, sf).collect())) == brute_components(docs, 2, 80)


def test_near_duplicates_of_rows_with_one_id(spark):
    """Id 5 has two texts, so what equals either of them is of one component; a blank row of an id is its own."""
    one, two = "a b c d e f", "x y z w v u"
    rows = [(3, one), (2, one), (5, one), (5, two), (7, two), (9, two), (9, ""), (8, "other words here"), (None, one)]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()), key=str)
    assert got == sorted([(2, 5, 2, True), (3, 5, 2, False), (5, 5, 2, False), (5, 5, 2, False), (7, 5, 2, False), (8, 2, 8, True), (9, 5, 2, False), (9, 0, 9, True), (None, 5, None, True)], key=str)


def test_near_copies_of_copies(spark):
    """A family in which many members are too far from its centre: the second step has to find their links."""
    rng, words = random.Random(8), [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    family = [base]
    for _ in range(150):
        t = list(rng.choice(family))
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        family.append(t)
    docs = [(1000 - i, " ".join(t)) for i, t in enumerate(family)] + [(2000 + i, " ".join(rng.choices(words, k=50))) for i in range(20)]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), k=2).collect()))
    assert got == brute_components(docs, 2, 80)


def test_intersections():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(20)]
    assert (neardup.intersections(sets[:8], sets[8:]) == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]).all()


def test_signature_estimates_similarity():
    rng, s = random.Random(10), neardup.Signer(1)
    for part in (0.5, 0.8, 0.95):
        a = [f"a{i}" for i in range(400)]
        b = a[: int(400 * 2 * part / (1 + part))]
        b += [f"b{i}" for i in range(400 - len(b))]
        x, y = (s.signature(s.hashes(" ".join(t))) for t in (a, b))
        assert abs((x == y).mean() - part) < 0.09
    rng.random()


def test_near_duplicates_odd_rows(odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd, k=2).collect()}
    assert {(1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 4, None, True), (5, 1, 5, True), (7, 1, 7, True)} <= got
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(odd).columns == odd.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200) if i % 50] + [(300, 300), (None, 4), (7, 5), (7, 5)] + [(1000 + i, 900) for i in range(300)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert all(got[i] == (i - 1) // 50 * 50 + 1 for i in range(1, 200)) and got[1299] == 900 and got[900] == 900
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_model(docs):
    one, two = Counter(), Counter()
    for w in docs:
        one.update(w)
        two.update(zip(["\n", *w], w))
    return one, two, sum(one.values()), len(one)


def parts(model, u, x):
    one, two, n, v = model
    return two[u, x] / one[u] if one[u] else 0, one[x] / max(n, 1), 1 / (v + 1)


def brute_weights(docs):
    """Expectation-maximisation, a token at a time, over the documents of fold 1 in the counts of folds 2 to 9."""
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    model = brute_model([w for i, w in docs if fold(i) not in (0, 1)])
    pairs = Counter((u, x) for i, w in docs if fold(i) == 1 for u, x in zip(["\n", *w], w))
    lam, last = [[0.0, 0.7, 0.3] if b == 0 else [0.4, 0.4, 0.2] for b in range(64)], None
    for _ in range(40):
        uses, likelihood = [[0.0] * 3 for _ in lam], 0.0
        for (u, x), times in pairs.items():
            b = min(model[0][u].bit_length(), 63)
            p = [a * q for a, q in zip(lam[b], parts(model, u, x))]
            likelihood += times * math.log(sum(p))
            for k in range(3):
                uses[b][k] += times * p[k] / sum(p)
        for b, x in enumerate(uses):
            if sum(x):
                new = [y / sum(x) for y in x]
                new[2] = max(new[2], 1e-6)
                lam[b] = [y / sum(new) for y in new]
        if last is not None and abs(likelihood - last) <= 1e-7 * abs(last):
            break
        last = likelihood
    return lam


def brute_scores(rows):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]
    docs, out = [(i, split(t)) for i, t in rows], {}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    lam, model = brute_weights(docs), brute_model([w for i, w in docs if not held(i)])
    one, _, n, v = model
    for i, w in docs:
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(sum(a * q for a, q in zip(lam[min(one[u].bit_length(), 63)], parts(model, u, x)))) for u, x in zip(["\n", *w], w))
        out[i] = (held(i), len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out, lam


def test_scores_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 30_000)
    df, lam = lm.score(documents)
    want, brute_lam = brute_scores([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert lam.tolist() == pytest.approx(np.array(brute_lam), rel=1e-5)
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    assert set(got) == set(want)
    for i, g in got.items():
        assert g[:4] == want[i][:4] and g[4:] == pytest.approx(want[i][4:], rel=1e-6)


def test_held_out_texts_teach_nothing(spark, documents):
    """Other texts in the held-out documents change no other score and no weight."""
    other = documents.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 10 = 0 THEN 'quite other words' ELSE text END AS text")
    (a, lam), (b, same) = lm.score(documents), lm.score(other)
    assert lam.tolist() == same.tolist()
    rows = lambda df: sorted(map(tuple, df.where("not held_out").collect()))
    assert rows(a) == rows(b)


def test_weights_raise_the_held_out_likelihood():
    rng = np.random.default_rng(11)
    n, v = 10_000, 500
    cu, cw = rng.integers(0, 300, 2000), rng.integers(0, 200, 2000)
    cuw = np.minimum(rng.integers(0, 50, 2000), cu)
    at, times = lm.context_bucket(cu), np.ones(2000)
    lam, last = lm.start_weights(), -np.inf
    for _ in range(20):
        uses = lm.em_step(lam, at, *lm.estimates(cw, cu, cuw, n, v), times)
        assert uses[-1, 0] >= last - 1e-6
        last, lam = uses[-1, 0], lm.next_weights(lam, uses)
    assert np.allclose(lam.sum(1), 1)


def test_scores_odd_rows(odd, empty):
    got = lm.score(odd)[0].collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm.score(empty)[0].count() == 0
