"""Language identification by a bit-sliced Bloom filter over character n-grams.

Training counts the n-grams (one to three characters of lower-cased letters, any other run one space) of each language. A
language contains an n-gram when the n-gram makes up at least one of RATE of its n-grams of that length, and at least one
of CONTRAST of the share it has in the language that uses it most: loan words and noise stay out. By arithmetic a language
contains at most 3 * RATE n-grams, however large the corpus.

The filter has SLOTS slots, each with one bit a language. An n-gram sets its languages' bits in HASHES slots; the AND of
the slots it falls on gives, in one look, all languages that contain it. A text's n-grams are looked up, the hits are
counted language by language, and the count is corrected for the false positives that the language's share of set bits
lets expect. The language with the most corrected hits is the answer.

The filter's size depends on the number of languages only: 8 bytes a slot for each 64 of them. It is broadcast; more than
MOST_LANGUAGES are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import stored, table

FOLDS, HELD_OUT_FOLD, UNKNOWN = 5, 0, "und"
ORDERS = (1, 2, 3)
RATE, CONTRAST = 100_000, 8
SLOTS, HASHES, MOST_LANGUAGES = 1 << 20, 4, 1024
#: Characters read at a time; n-grams counted together before they are sent on; slots in a row of the filter's table.
PIECE, HELD, ROW_SLOTS = 1 << 18, 1 << 22, 1 << 12
#: A code point is 21 bits, so three of them are a whole number of 63 bits: n-grams are told apart without a hash.
BITS, SPACE = np.uint64(21), 32
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Reader:
    """Texts as n-grams: whole numbers of up to three code points, letters lower-cased, other runs one space."""

    def __init__(self):
        self.letter = _letters()

    def pieces(self, text: str) -> Iterator[tuple[np.ndarray, int]]:
        """(characters, how many of them were in the piece before), so that n-grams across pieces come once."""
        last = np.array([SPACE], np.uint32)
        for at in range(0, len(text), PIECE):
            x = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            x = np.concatenate([last[-1:], np.where(self.letter[x], x, SPACE)])
            x = x[1:][(x[1:] != SPACE) | (x[:-1] != SPACE)]
            yield np.concatenate([last, x]), len(last)
            last = np.concatenate([last, x])[-(len(ORDERS) - 1) :]
        if last[-1] != SPACE:  # a word ends with the text
            yield np.concatenate([last, [np.uint32(SPACE)]]), len(last)

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """The n-grams with a letter, piece by piece; none for a text without letters."""
        for chars, old in self.pieces(text):
            c = chars.astype(np.uint64)
            for n in ORDERS:
                first = max(0, old - n + 1)
                g = c[first : len(c) - n + 1] if len(c) >= n else c[:0]
                for k in range(1, n):
                    g = g << BITS | c[first + k : len(c) - n + 1 + k]
                yield g[g != SPACE]


def order_of(gram: Column) -> Column:
    return F.when(gram >= 1 << 42, 3).when(gram >= 1 << 21, 2).otherwise(1)


GRAMS = "lang string, gram bigint, n bigint"


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of docs (lang, text), summed in each task as far as HELD n-grams go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Reader(), {}, 0

        def out():
            for lang, arrays in held.items():
                g, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for g in reader.grams(text.as_py()):
                    held.setdefault(lang.as_py(), []).append(g)
                    size += len(g)
                    if size >= HELD:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return docs.mapInArrow(run, GRAMS)


def places(gram: np.ndarray, slots: int = SLOTS) -> Iterator[np.ndarray]:
    """The slots of n-grams: two halves of a 64-bit mix, one added to the other again and again."""
    x = gram.astype(np.uint64) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    x ^= x >> np.uint64(31)
    a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    for k in range(HASHES):
        yield (a + np.uint64(k) * b) & np.uint64(slots - 1)


@dataclass
class Filter:
    """languages in order of their bits; masks (words of 64 languages, slots)."""

    languages: list[str]
    masks: np.ndarray

    def __post_init__(self):
        size = len(self.languages)
        self.false_rate = np.array([np.count_nonzero(self.masks[i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / self.masks.shape[1] for i in range(size)]) ** HASHES

    def contained(self, gram: np.ndarray, word: int) -> np.ndarray:
        """For each n-gram the mask of the languages (of one word of 64) that contain it."""
        out = None
        for at in places(gram, self.masks.shape[1]):
            m = self.masks[word][at]
            out = m if out is None else out & m
        return out

    def corrected(self, reader: Reader, text: str) -> tuple[np.ndarray, int]:
        """Hits of each language without the false ones to expect, and the number of n-grams."""
        hits, n = np.zeros(len(self.languages)), 0
        for g in reader.grams(text):
            n += len(g)
            for word in range(len(self.masks)):
                m = self.contained(g, word)
                for i in range(word << 6, min(len(hits), (word + 1) << 6)):
                    hits[i] += np.count_nonzero(m & np.uint64(1 << (i & 63)))
        return np.maximum(hits - self.false_rate * n, 0) / np.maximum(1 - self.false_rate, 1e-9), n

    def predict(self, reader: Reader, text: str | None) -> tuple[str, float]:
        """(language, share of the text's n-grams that it is held to contain); the first of equal languages."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        hits, n = self.corrected(reader, text)
        if not n:
            return UNKNOWN, 0.0
        best = int(np.argmax(hits))
        return self.languages[best], min(1.0, float(hits[best]) / n)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Filter:
    """The filter of all rows with a language and a text.

    Every row counts, a repeated one as often as it comes. The driver gets the languages' names and one array of a size
    that their number fixes. With no such row the filter has no language. Other columns are not read.
    """
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = stored(_counted(d).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    totals = counts.groupBy("lang", order_of(F.col("gram")).alias("size")).agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    if not languages:
        return Filter([], masks)
    # at most three rows a language, counted above
    rates = counts.withColumn("size", order_of(F.col("gram"))).join(F.broadcast(totals), ["lang", "size"]).select("lang", "gram", "n", "total", (F.col("n") / F.col("total")).alias("rate"))
    top = rates.where(F.col("n") * RATE >= F.col("total")).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("of"))
    held = top.select("gram", F.filter("of", lambda x: x["rate"] * CONTRAST >= F.col("top")).alias("of"))
    bit = {x: i for i, x in enumerate(languages)}

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, slot, mask) for the n-grams of a batch."""
        for batch in batches:
            gram, of = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for word in range(len(masks)):
                mask = np.array([sum(1 << (b & 63) for x in ls if (b := bit[x["lang"]]) >> 6 == word) for ls in of], np.uint64)
                some = mask != 0
                slot = np.concatenate(list(places(gram[some])))
                cols = [pa.array(np.full(len(slot), word, np.int32)), pa.array(slot.astype(np.int32)), pa.array(np.tile(mask[some], HASHES).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["word", "slot", "mask"])

    def block(rows: pa.Table) -> pa.Table:
        dense, word, first = np.zeros(ROW_SLOTS, np.uint64), rows.column("word")[0].as_py(), rows.column("slot")[0].as_py() // ROW_SLOTS
        dense[rows.column("slot").to_numpy() % ROW_SLOTS] = rows.column("mask").to_numpy().view(np.uint64)
        return pa.table({"word": pa.array([word], pa.int32()), "first": pa.array([first * ROW_SLOTS], pa.int32()), "masks": pa.array([dense.tobytes()], pa.binary())})

    slots = held.mapInArrow(set_bits, "word int, slot int, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    for r in slots.groupBy("word", F.expr(f"slot div {ROW_SLOTS}").alias("row")).applyInArrow(block, "word int, first int, masks binary").collect():  # of the filter's own size
        masks[r["word"], r["first"] : r["first"] + ROW_SLOTS] = np.frombuffer(r["masks"], np.uint64)
    return Filter(languages, masks)


PREDICTED = "lang_pred string, score double"


def predict(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """docs with a struct column `language` (see PREDICTED), replacing a column of that name.

    A null text, one without a letter, and every text under a filter without languages are UNKNOWN with score 0. A text of
    unknown n-grams gets the first language with score 0. Only the text is looked at; it is read in pieces, so a very long
    one takes no more memory than the Arrow batch it came in. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))

    @F.pandas_udf(PREDICTED)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader, own = Reader(), Filter(*shared.value)
        for texts in batches:
            yield pd.DataFrame([own.predict(reader, t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("language", guess(F.col(text_col).cast("string")))


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")
