"""Benchmark decontamination by spaced seeds: masks of token positions that tolerate substitutions.

A seed is a window of words of which only the positions of a mask count. Test items and documents are hashed under the
same masks; a shared hash proposes an alignment (item, document, shift), and the words around it are compared one by
one. Words substituted by others keep their place, so an alignment survives them; the masks ignore different positions,
so some seed falls between the substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import fresh, stored

#: Weight 5 each: one contiguous and three spaced ones, span at most 9.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 8))
#: An alignment is a leak if some stretch of it has so many words and agrees on so large a part of them; an item
#: shorter than that must lie in the document as a whole.
MIN_WORDS, MIN_SAME = 13, 0.8
#: From so many words on, the masks alone find every leak of an item as a whole.
SHORT = 11
#: Up to so many hashes of the test items go to every task; beyond it, hits are found by a shuffled join.
BROADCAST_SEEDS = 2_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STRIP = b".,;:!?\"'()[]"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
ENTRIES = 500_000


class Words:
    """64-bit hashes of a text's words: lower-cased ASCII, punctuation at the ends dropped."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        parts, known = (text or "").encode().translate(_LOWER).split(), self.known
        if len(known) > ENTRIES:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = xxhash.xxh3_64_intdigest(p.strip(_STRIP) or p)
        return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))


def seeds(w: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
    """The hash at each position under mask number k; fewer words than the span: none."""
    n = len(w) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k + 1, np.uint64)
    for j, at in enumerate(mask):
        h = (h ^ w[at : at + n]) * _MIX[j]
        h ^= h >> np.uint64(29)
    return h


def short_seeds(w: np.ndarray) -> tuple[int, np.ndarray]:
    """Short items are also looked up by every run of three words: with a fifth of the words substituted, one is left.

    Only of five words the middle one may leave runs of two. Items of one or two words are a run.
    """
    n = 2 if len(w) == 5 else min(len(w), 3)
    return 100 + n, seeds(w, tuple(range(n)), 100 + n)


def best_stretch(same: np.ndarray, least: int, part: float) -> tuple[int, int, int]:
    """(start, length, agreements) of the longest stretch of at least `least` words of which `part` agree; length 0: none.

    With y[i] the surplus of agreements over `part` up to i, a stretch (i, j] is good when y[j] >= y[i]; the longest one
    comes from the running minimum of y and the running maximum from behind.
    """
    n = len(same)
    if n < least or not n:
        return 0, 0, 0
    y = np.concatenate([[0.0], np.cumsum(same - part)]) + 1e-9 * np.arange(n + 1)
    behind = np.maximum.accumulate(y[::-1])[::-1]
    ahead = np.minimum.accumulate(y)
    best, i, j = (0, 0), 0, 0
    while j <= n and i <= n:
        if behind[j] >= ahead[i]:
            if j - i > best[1]:
                best = (i, j - i)
            j += 1
        else:
            i += 1
            j = max(j, i)
    i, k = best
    if k < least:
        return 0, 0, 0
    return i, k, int(same[i : i + k].sum())


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The best stretch where item word i lies at document word i + shift: (first document word, words, agreements)."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    least = min(MIN_WORDS, len(item))
    if hi - lo < least:
        return 0, 0, 0
    s, k, same = best_stretch((doc[lo + shift : hi + shift] == item[lo:hi]).astype(np.float64), least, MIN_SAME)
    return s + lo + shift, k, same


def _masks():
    return [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in (1, 2, 3))]


def _item_seeds(w: np.ndarray) -> list[tuple[int, np.ndarray]]:
    out = [(k, seeds(w, m, k)) for k, m in enumerate(MASKS)]
    if 0 < len(w) < SHORT:
        out.append(short_seeds(w))
    return out


HITS = "doc_id bigint, item_id bigint, doc_word bigint, n_words bigint, n_same bigint"
_NAMES = [x.split()[0] for x in HITS.split(", ")]


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 5)], _NAMES)


class Table:
    """The test items' seeds, sorted, with a bitmap in front of the search."""

    def __init__(self, texts: list[tuple[int, str | None]]):
        words = Words()
        self.items = [(i, words(t)) for i, t in texts]
        h, row, at, kinds = [], [], [], set()
        for r, (_, w) in enumerate(self.items):
            for k, s in _item_seeds(w):
                kinds.add(k)
                h.append(s)
                row.append(np.full(len(s), r))
                at.append(np.arange(len(s)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h, row, at = cat(h, np.uint64), cat(row, np.int64), cat(at, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.row, self.at = h[order], row[order], at[order]
        self.masks = [(k, m) for k, m in _masks() if k in kinds]
        bits = max(16, int(len(h)).bit_length() + 5)
        self.low = np.uint64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[h & self.low] = True

    def maybe(self, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, m in self.masks:
            s = seeds(doc, m, k)
            at = np.flatnonzero(self.bitmap[s & self.low])
            yield at, s[at]

    def find(self, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, words, agreements): the best stretch of each item that leaks into doc."""
        shifts = set()
        for at, s in self.maybe(doc):
            lo, hi = np.searchsorted(self.h, s, "left"), np.searchsorted(self.h, s, "right")
            n = hi - lo
            if n.any():
                take = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows, sh = self.row[take], np.repeat(at, n) - self.at[take]
                shifts |= set(zip(rows.tolist(), sh.tolist()))
        return best_of((self.items[r][0], *overlap(doc, self.items[r][1], sh)) for r, sh in shifts)


def best_of(found) -> list[tuple[int, int, int, int]]:
    best: dict = {}
    for i, s, k, same in found:
        if k and (i not in best or (-k, -same, s) < (-best[i][1], -best[i][2], best[i][0])):
            best[i] = (s, k, same)
    return [(i, *v) for i, v in sorted(best.items(), key=lambda x: (x[0] is None, x[0]))]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row (see HITS) for each document and item that leaks into it, with the longest stretch found.

    Null or blank texts, of documents or items, leak nothing. Items with equal ids are taken as parts of one item;
    null ids stay null. Repeated document rows give repeated results. Empty tables give none. Columns but the four named
    are not read. Few enough items (their words are counted first) go to every task; else hits are joined by their hash.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    b = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a word and a separator have two bytes at least
    if size / 2 * (len(MASKS) + 1) <= broadcast_seeds or b.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\\s+")))).first()[0] * (len(MASKS) + 1) <= broadcast_seeds:
        return _by_broadcast(d, b)
    return _by_join(d, b)


def _by_broadcast(d: DataFrame, b: DataFrame) -> DataFrame:
    texts = [(r["item_id"], r["text"]) for r in b.collect()]  # its size was checked
    sent = d.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = Table(sent.value), Words()
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(i, *x) for x in table.find(words(t))]
            yield _batch(rows)

    return d.mapInArrow(run, HITS)


def _by_join(d: DataFrame, b: DataFrame) -> DataFrame:
    """Seeds of both sides meet by hash; a bitmap of fixed size keeps nearly all seeds without a partner at home."""
    bits = 1 << 24

    def item_seeds(batches):
        words = Words()
        for batch in batches:
            h, item, at = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, s in _item_seeds(words(t)):
                    h += s.view(np.int64).tolist()
                    item += [i] * len(s)
                    at += range(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, item, at)], ["h", "item_row", "item_at"])

    items = stored(b.withColumn("item_row", F.monotonically_increasing_id()), "bench-items")
    table = stored(items.select("item_row", "text").mapInArrow(item_seeds, "h bigint, item_row bigint, item_at bigint"), "bench-seeds")
    blocks = table.select(F.pmod("h", F.lit(bits)).alias("x")).distinct().groupBy((F.col("x") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(x, 64) AS int)))").alias("v"))
    bitmap = np.zeros(bits // 64, np.uint64)  # 2 MB at most, whatever the number of items
    got = blocks.toPandas()
    bitmap[got["word"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    sent = d.sparkSession.sparkContext.broadcast(bitmap)

    def doc_seeds(batches):
        words, flags = Words(), np.unpackbits(sent.value.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            h, row, at = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(t)
                for k, m in _masks():
                    s = seeds(w, m, k)
                    p = np.flatnonzero(flags[s & np.uint64(bits - 1)])
                    h.append(s[p].view(np.int64))
                    at.append(p)
                    row.append(np.full(len(p), i))
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([cat(h), cat(row), cat(at)], ["h", "doc_row", "at"])

    docs = d.withColumn("doc_row", F.xxhash64("doc_id", "text"))  # rows that are equal in both have equal leaks
    hits = docs.select("doc_row", "text").mapInArrow(doc_seeds, "h bigint, doc_row bigint, at bigint")
    aligned = hits.join(table, "h").select("doc_row", "item_row", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = aligned.join(items, "item_row").join(docs.select("doc_row", F.col("text").alias("doc_text")).distinct(), "doc_row")

    def verify(batches):
        words = Words()
        for batch in batches:
            rows = []
            for row, item, shift, text, doc in zip(*(batch.column(k).to_pylist() for k in range(5))):
                s, k, same = overlap(words(doc), words(text), shift)
                if k:
                    rows.append((row, item, s, k, same))
            yield _batch(rows)

    found = pairs.select("doc_row", "item_id", "shift", "text", "doc_text").mapInArrow(verify, HITS)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_same", (-F.col("doc_word")).alias("w"))).alias("m"))
    best = best.select(F.col("doc_id").alias("doc_row"), "item_id", (-F.col("m.w")).alias("doc_word"), "m.n_words", "m.n_same")
    return docs.select("doc_id", "doc_row").join(best, "doc_row").select(*_NAMES)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their own columns, into which no item leaks. Rows with a null id are judged by a key of their text."""
    key, more = fresh(docs, "__leak_key"), fresh(docs, "__leak_more")
    keyed = docs.withColumns({key: F.xxhash64(F.col(text_col)), more: F.xxhash64(F.lit(1), F.col(text_col))})
    leaking = lambda d, k: stored(find_leaks(d, benchmark, k, text_col, **options).select(F.col("doc_id").alias(k)).distinct(), "leaks")
    # a document goes by two hashes of its text: by one alone, another's leak would take it along among very many
    found = keyed.join(leaking(keyed, key), key, "left_semi")
    bad = stored(found.join(leaking(found, more), more, "left_semi").select(key, more).distinct(), "leaking")
    return keyed.join(bad, [key, more], "left_anti").select(*docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
