"""Fill-in-middle: cut a text at two unit ends chosen by a hash of its id, and put the middle last.

A pandas UDF works on Arrow batches. The regex library finds the units of one text; only their end offsets are kept, in
an array of eight bytes a unit, and two look-ups there give the cuts. hashlib makes the seeds and the digests. Every row
is by itself: no shuffle, and any number of executors may be lost and their rows made again alike.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import table

LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
REBUILT = "text string, sha256 string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@dataclass(frozen=True)
class Recipe:
    """What decides a document's form: the units, the seed's salt, the share of documents moved, that of spm among them."""

    unit: str = LINES
    salt: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # a mark must never seem to begin or end inside another one, or before it in the text that it follows
        for a in marks:
            if not a or any(a.endswith(b[:k]) for b in marks for k in range(1, len(b)) if a != b[:k]) or any(a != b and a in b for b in marks):
                raise ValueError("marks must differ, and none may overlap with another or with itself")
        if len(set(marks)) < 3:
            raise ValueError("marks must differ, and none may overlap with another or with itself")

    def draws(self, doc_id) -> list[int]:
        """h1 to h4 of an id; a null id is drawn as an empty one."""
        digest = hashlib.sha256(f"{self.salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def cut(self, units: regex.Pattern, doc_id, text: str) -> tuple:
        """(units, form, prefix length, middle length, output): see MADE."""
        ends = array("q", [0])
        ends.extend(m.end() for m in units.finditer(text))
        n, (h1, h2, h3, h4) = len(ends) - 1, self.draws(doc_id)
        if not text or any(x in text for x in (self.prefix, self.suffix, self.middle)) or h3 % 100 >= self.fim_percent:
            return n, PLAIN, None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = ends[a], ends[b]
        head, body, tail = text[:i], text[i:j], text[j:]
        if h4 % 100 < self.spm_percent:
            return n, SPM, i, j - i, f"{self.suffix}{tail}{self.prefix}{head}{self.middle}{body}"
        return n, PSM, i, j - i, f"{self.prefix}{head}{self.suffix}{tail}{self.middle}{body}"

    def rebuilt(self, output: str, form: str) -> str:
        """The text, from the output and its form alone: no part holds a mark, so each mark stands once."""
        if form == PLAIN:
            return output
        first, second = (self.prefix, self.suffix) if form == PSM else (self.suffix, self.prefix)
        x, _, rest = output[len(first) :].partition(second)
        y, _, body = rest.partition(self.middle)
        return x + body + y if form == PSM else y + body + x


def transformed(doc_id: Column, text: Column, recipe: Recipe = Recipe()) -> Column:
    """A struct (see MADE) for each document."""

    @F.pandas_udf(MADE)
    def made(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units = regex.compile(recipe.unit)
        rows = [recipe.cut(units, i, t) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        return out.assign(output_sha256=[_sha256(r[-1]) for r in rows])

    # ids travel as text: a null among whole numbers would turn them all into floats
    return made(doc_id.cast("string"), F.coalesce(text.cast("string"), F.lit("")))


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """A struct (see REBUILT) with the text that the output was made from, and its digest."""

    @F.pandas_udf(REBUILT)
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [recipe.rebuilt(o, f) for o, f in zip(outputs, forms)]
        return pd.DataFrame({"text": texts, "sha256": [_sha256(t) for t in texts]})

    return back(output, form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recipe: Recipe = Recipe()) -> DataFrame:
    """docs with a struct column `fim` (see MADE), replacing a column of that name.

    A null text is an empty one and stays plain, as does a text that holds a mark. A null id is drawn as an empty id. Rows
    that repeat an id and text come out alike. One text and its output are held at a time besides the Arrow batch, however
    long they are. An empty table stays empty; other columns are carried along.
    """
    return docs.withColumn("fim", transformed(F.col(id_col), F.col(text_col), recipe))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = docs.withColumn("restored", restored(F.col("fim.output"), F.col("fim.form")))
    return back.select("doc_id", *(F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256")), F.col("restored.sha256").alias("restored_sha256"))


_DRAW = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{LINES}') AS us, {", ".join(f"{_DRAW(k)} AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS x, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS y FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || y || '<P>' || x || '<M>' || m ELSE '<P>' || x || '<S>' || y || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
