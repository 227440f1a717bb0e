"""Every registered query with its SQL twin, grouped as the operators are."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import graph as G
from stratalens.operators import maintain as M
from stratalens.operators import measure as A
from stratalens.operators import postings as Postings
from stratalens.operators import render as R
from stratalens.operators import search as X
from stratalens.operators import transcript as C
from stratalens.plans import model
from stratalens.session import spread
from stratalens.sources import repo as S
from stratalens.sources.versions import kept, shared_dir
from stratalens.streaming import watch as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("WITH MODEL", f"WITH {model.SQL}")
        return f

    return add


def _resolved(spark, sf) -> DataFrame:
    return model.resolved(spark, sf)


# --- call graph ---


@query("""WITH MODEL SELECT from_path, to_path, count(*) AS n_calls,
  string_agg(line || ':' || from_name || '>' || to_name, ',' ORDER BY line, from_name, to_name) AS calls
FROM resolved WHERE kind = 'call' AND to_path IS NOT NULL AND from_path <> to_path GROUP BY 1, 2""")
def file_graph(spark, sf):
    return G.file_graph(_resolved(spark, sf))


@query("WITH MODEL SELECT from_path, from_name, to_name, kind, line, to_path FROM resolved")
def resolve_edges(spark, sf):
    return G.resolve(model.edges(spark, sf), model.symbols(spark, sf)).select("from_path", "from_name", "to_name", "kind", "line", "to_path")


@query("WITH MODEL SELECT path, name, arg_min(kind, line) AS kind, min(line) AS line FROM emitted GROUP BY 1, 2")
def dedupe_first_wins(spark, sf):
    return G.first_wins(model.symbols_emitted(spark, sf).drop("line"), ["path", "name"], "seq").withColumnRenamed("seq", "line")


@query("WITH MODEL SELECT name, kind, line FROM symbols WHERE path = 7")
def symbols_of_path(spark, sf):
    return model.symbols(spark, sf).where("path = 7").select("name", "kind", "line").orderBy("line", "name")


@query("WITH MODEL SELECT DISTINCT from_path, to_name, to_path FROM resolved WHERE kind = 'call' AND to_path IS NOT NULL")
def callees(spark, sf):
    return G.callees(_resolved(spark, sf))


@query("""WITH MODEL, a AS MATERIALIZED (SELECT DISTINCT name FROM symbols), c AS MATERIALIZED (SELECT DISTINCT to_name, from_path, from_name FROM edges WHERE kind = 'call'),
x AS MATERIALIZED (SELECT name AS symbol, from_path, from_name FROM a JOIN c ON name = to_name)
SELECT *, 'exact' AS how FROM x UNION ALL
SELECT name, from_path, from_name, 'leaf' FROM (SELECT name, from_path, from_name FROM a JOIN c ON split_part(name, '.', 2) = to_name WHERE name LIKE '%.%' EXCEPT SELECT symbol, from_path, from_name FROM x)""")
def callers_exact_and_leaf(spark, sf):
    return G.callers_in(model.calls(spark, sf), model.symbols(spark, sf))


GATED = """own AS (SELECT path, name, split_part(name, '.', -1) AS l, CASE WHEN name LIKE '%.%' THEN split_part(name, '.', 1) END AS c, 'mod' || path AS stem FROM symbols),
c AS (SELECT DISTINCT from_path, to_name FROM edges WHERE kind = 'call'), i AS (SELECT DISTINCT from_path, lower(to_name) AS t FROM edges WHERE kind = 'import'),
seg AS (SELECT DISTINCT from_path, unnest(string_split(t, '.')) AS s FROM i), las AS (SELECT DISTINCT from_path, split_part(t, '.', -1) AS s FROM i),
gated AS (SELECT path, name, c.from_path FROM own JOIN c ON l = to_name WHERE c.from_path <> path AND ((c.from_path, stem) IN (SELECT from_path, s FROM seg) OR (c.from_path, lower(own.c)) IN (SELECT from_path, s FROM las))
  UNION SELECT path, name, c.from_path FROM own JOIN c ON name = to_name WHERE own.c IS NOT NULL AND c.from_path <> path)"""


def _gate(spark, sf):
    """(symbols, edges, stems) for the import gate."""
    s = model.symbols(spark, sf)
    return s, model.edges(spark, sf), s.select("path", F.concat(F.lit("mod"), F.col("path").cast("string")).alias("stem")).distinct()


@query(f"WITH MODEL, {GATED} SELECT * FROM gated")
def import_gated_callers(spark, sf):
    return G.gated_callers(*_gate(spark, sf))


@query(f"""WITH MODEL, {GATED} SELECT path, name, count(*) AS n_callers, file_total FROM gated
JOIN (SELECT path, count(DISTINCT from_path) AS file_total FROM gated GROUP BY 1) USING (path) GROUP BY ALL""")
def impact(spark, sf):
    return G.impact_counts(*_gate(spark, sf))


@query("""WITH MODEL, h AS (SELECT s.path, count(DISTINCT from_path) AS n FROM symbols s JOIN edges e ON e.to_name = s.name AND e.kind = 'call' AND from_path <> s.path GROUP BY 1)
SELECT p.path, coalesce(n, 0) AS called_by FROM (SELECT DISTINCT path FROM symbols) p LEFT JOIN h USING (path)""")
def centrality_by_name(spark, sf):
    s = model.symbols(spark, sf)
    return G.centrality_by_name(s, s, model.edges(spark, sf))


@query("WITH MODEL SELECT to_path AS path, count(DISTINCT from_path) AS called_by FROM resolved WHERE kind = 'call' AND to_path IS NOT NULL GROUP BY 1")
def centrality_resolved(spark, sf):
    return G.centrality_resolved(_resolved(spark, sf))


@query("""WITH MODEL, a AS (SELECT DISTINCT path, split_part(name, '.', -1) AS asked FROM symbols UNION SELECT DISTINCT path, 'nowhere' FROM symbols),
b AS (SELECT path, name, name AS asked, 1 AS e FROM symbols UNION ALL SELECT path, name, split_part(name, '.', 2), 0 FROM symbols WHERE name LIKE '%.%'),
g AS (SELECT a.path, a.asked, max(CASE WHEN e = 1 THEN name END) AS e, count(name) AS n, min(name) AS one, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM a LEFT JOIN b USING (path, asked) GROUP BY 1, 2)
SELECT path, asked, CASE WHEN e IS NOT NULL OR n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS status, coalesce(e, CASE WHEN n = 1 THEN one END) AS found, CASE WHEN e IS NULL AND n > 1 THEN names END AS candidates FROM g""")
def symbol_detail(spark, sf):
    s = model.symbols(spark, sf)
    asked = s.select("path", T.leaf(F.col("name")).alias("asked")).union(s.select("path", F.lit("nowhere")))
    return G.symbol_detail(s, asked, s.count())


@query("WITH MODEL SELECT DISTINCT from_path AS path FROM resolved WHERE from_path <> to_path AND to_path IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01')")
def dependents_cascade(spark, sf):
    changed = model.read(spark, sf, "orders").where("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("path"))
    return G.dependents(_resolved(spark, sf), changed)


@query("""WITH MODEL, k AS (SELECT 'pkg.mod' || path AS key, path FROM (SELECT DISTINCT path FROM symbols) UNION ALL SELECT 'pkg', -1),
i AS (SELECT DISTINCT to_name FROM edges WHERE kind = 'import')
SELECT to_name, arg_max(path, length(key)) AS path FROM i JOIN k ON to_name = key OR starts_with(to_name, key || '.') GROUP BY 1""")
def import_longest_prefix(spark, sf):
    s = model.symbols(spark, sf).select(F.concat(F.lit("pkg.mod"), F.col("path").cast("string")).alias("key"), "path").distinct()
    mods = s.union(spark.createDataFrame([("pkg", -1)], "key string, path bigint"))
    return G.longest_prefix(model.edges(spark, sf).where("kind = 'import'"), mods)


@query("WITH MODEL SELECT from_path, to_name, CASE WHEN count(DISTINCT to_path) = 1 THEN min(to_path) END AS to_path FROM resolved WHERE kind = 'call' AND to_path IS NOT NULL GROUP BY 1, 2")
def ambiguous_targets(spark, sf):
    return G.targets_or_null(_resolved(spark, sf))


@query("""WITH t AS (SELECT DISTINCT name, unnest(list_filter(string_split_regex(split_part(name, '.', 1), '[_\\-.]+'), lambda x: length(x) >= 3)) AS t
  FROM (SELECT replace(p_name, ' ', '_') || '-' || p_brand || '_' || p_type || '.py' AS name FROM part))
SELECT x.name AS a, y.name AS b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.name < y.name GROUP BY 1, 2 HAVING count(*) >= 2""")
def name_overlap(spark, sf):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), "p_brand", F.lit("_"), "p_type", F.lit(".py"))
    return G.shared_names(model.read(spark, sf, "part").select(name.alias("name")), T.name_tokens)


NAMES = """nm AS (SELECT DISTINCT replace(p_name, ' ', '_') || '-' || p_brand || '_' || p_type || '.py' AS name FROM part),
ts AS (SELECT name, list_sort(list_distinct(list_filter(string_split_regex(split_part(name, '.', 1), '[_\\-.]+'), lambda x: length(x) >= 3))) AS s FROM nm),
cl AS (SELECT name, min(name) OVER (PARTITION BY s) AS class, s FROM ts)"""


def _name_classes(spark, sf) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), "p_brand", F.lit("_"), "p_type", F.lit(".py"))
    return G.name_classes(model.read(spark, sf, "part").select(name.alias("name")), T.name_tokens)


@query(f"""WITH {NAMES}, t AS (SELECT name, unnest(s) AS t FROM ts), p AS (SELECT x.name FROM t x JOIN t y ON x.t = y.t AND x.name <> y.name GROUP BY x.name, y.name HAVING count(*) >= 2)
SELECT cl.name, class, count(p.name) AS n_links FROM cl LEFT JOIN p ON p.name = cl.name GROUP BY 1, 2""")
def name_links(spark, sf):
    """How many other names share two tokens with each name, without a row for any pair."""
    return G.name_links(_name_classes(spark, sf))


@query(f"""WITH {NAMES}, c AS (SELECT DISTINCT class, s FROM cl), t AS (SELECT class, unnest(s) AS t FROM c)
SELECT x.class AS a, y.class AS b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.class < y.class GROUP BY 1, 2 HAVING count(*) >= 3""")
def name_class_pairs(spark, sf):
    """Pairs of classes with three common tokens."""
    return G.class_pairs(_name_classes(spark, sf), 3)


@query("""WITH MODEL SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM resolved) AS edges,
  (SELECT count(to_path) FROM resolved) AS resolved_edges, (SELECT count(*) FROM labels) AS sidecars""")
def index_stats(spark, sf):
    return G.stats(model.files(spark, sf), model.symbols(spark, sf), _resolved(spark, sf), model.read(spark, sf, "labels"))


# --- files, caches, maintenance ---


@query("WITH MODEL SELECT path, lang, sha256, line_count FROM files")
def files_scan(spark, sf):
    return model.files(spark, sf).drop("text")


#: Documents as paths of a source tree: every suffix of a kind comes up.
SUFFIXES = (".py", ".go", ".md", ".rs", ".mjs", ".hh", ".key.md", ".clj", ".docx", ".sh", "")
TREE = f"tree AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '/r/node_modules/' ELSE '/r/' || source || '/' END || 'f' || doc_id || {list(SUFFIXES)}[(doc_id % {len(SUFFIXES)} + 1)::INT] AS path FROM documents)"


def _tree(spark, sf):
    folder = F.when(F.col("doc_id") % 13 == 0, F.lit("/r/node_modules/")).otherwise(F.concat(F.lit("/r/"), "source", F.lit("/")))
    return model.read(spark, sf, "documents").select("doc_id", F.concat(folder, F.lit("f"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))).alias("path"))


@query(f"""WITH {TREE} SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix, count(*) AS count FROM tree
WHERE regexp_extract(path, '(\\.[^./]+)$', 1) IN ('.go', '.rs', '.rb', '.php', '.swift', '.kt', '.scala', '.cs', '.lua', '.dart', '.ex', '.exs', '.clj', '.m') AND NOT contains(path, '/node_modules/') GROUP BY 1""")
def skipped_suffixes(spark, sf):
    return S.unsupported(_tree(spark, sf))


@query(f"""WITH {TREE}, x AS (SELECT doc_id, path, regexp_extract(path, '(\\.[^./]+)$', 1) AS s FROM tree)
SELECT doc_id, path, CASE s WHEN '.py' THEN 'python' WHEN '.mjs' THEN 'javascript' WHEN '.hh' THEN 'cpp' WHEN '.md' THEN 'markdown' WHEN '.docx' THEN 'docx' WHEN '' THEN '?' ELSE s[2:] END AS lang,
  s IN ('.py', '.md', '.mjs', '.hh', '.docx') AND NOT ends_with(path, '.key.md') AS is_source, ends_with(path, '.key.md') AS is_sidecar, contains(path, '/node_modules/') AS is_excluded,
  (s IN ('.py', '.md', '.mjs', '.hh', '.docx') OR ends_with(path, '.key.md')) AND NOT contains(path, '/node_modules/') AS is_watched FROM x""")
def classify_paths(spark, sf):
    t, path = _tree(spark, sf), F.col("path")
    is_sidecar = path.endswith(S.SIDECAR)
    return t.select("doc_id", "path", S.language(path).alias("lang"), (S.parsed_suffix(path) & ~is_sidecar).alias("is_source"), is_sidecar.alias("is_sidecar"), T.excluded(path, S.EXCLUDES).alias("is_excluded"), S.relevant(path).alias("is_watched"))


@query("WITH MODEL SELECT path, line_count FROM files WHERE line_count > 5 AND path NOT IN (SELECT doc_id FROM labels) ORDER BY line_count DESC, path LIMIT 30")
def missing_summaries(spark, sf):
    return M.missing(model.files(spark, sf), model.read(spark, sf, "labels").withColumnRenamed("doc_id", "path"), least=5)


def _cache(spark, sf):
    """What was summarized before: labelled documents, those of quality 0 under an older digest."""
    f = model.files(spark, sf).select("path", "sha256")
    lab = model.read(spark, sf, "labels").select(F.col("doc_id").alias("path"), "quality")
    return f.join(lab, "path").select("path", F.when(F.col("quality") == 1, F.col("sha256")).otherwise(F.lit("old")).alias("sha256"), F.concat(F.lit("s"), F.col("path").cast("string")).alias("summary"))


@query("WITH MODEL SELECT f.path, f.sha256, 's' || f.path AS summary FROM files f JOIN labels l ON f.path = l.doc_id WHERE quality = 1")
def cache_carry_over(spark, sf):
    return M.carry_over(_cache(spark, sf), model.files(spark, sf)).select("path", "sha256", "summary")


@query("WITH MODEL SELECT path, sha256, line_count FROM files WHERE line_count > 20 AND path NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def summarize_queue(spark, sf):
    return M.queue(model.files(spark, sf), _cache(spark, sf), 20).select("path", "sha256", "line_count").orderBy("path")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= '1998-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert_merge(spark, sf):
    o = model.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    new = o.where("o_orderdate >= '1998-01-01'").withColumn("o_orderstatus", F.lit("X")).drop("o_orderdate")
    return M.upsert(o.drop("o_orderdate"), new, ["o_orderkey"])


@query("""WITH MODEL, p AS (SELECT o_custkey AS path, cls || '.' || leaf AS name, leaf, cls FROM n JOIN orders USING (o_orderkey, o_custkey) WHERE o_orderdate < '1997-01-01'),
q AS (SELECT o_custkey AS path, cls || '.' || leaf AS name, leaf, cls FROM n JOIN orders USING (o_orderkey, o_custkey) WHERE o_orderdate >= '1997-01-01')
(SELECT path, name FROM p UNION SELECT path, leaf FROM p) EXCEPT (SELECT path, name FROM q UNION SELECT path, leaf FROM q)""")
def lost_symbols(spark, sf):
    cut = F.substring(T.leaf(F.col("name")), 2, 8) < "19970101"
    s = model.symbols(spark, sf).where("kind = 'method'")
    return M.lost(s.where(cut), s.where(~cut), model.symbols(spark, sf).count())


# --- text ---


#: The secret shapes as DuckDB reads them: no look-ahead, and letters of all languages spelled out. No text here has a redacted assignment.
SHAPES_SQL = "|".join(T.SECRET_SHAPES).replace("(?!<[a-z]+>)", "").replace("[\\w.+-]", "[\\p{L}\\p{N}_.+-]").replace("'", "''")
#: A secret of every shape, one for each document in turn.
SECRETS = ("sk-abcdefghijklmnop1234", "rk_live_12345678", "ghp_0123456789abcdefghij", "AKIAABCDEFGHIJKL", "xoxb-12345678-abc", "https://user:pw@host/x", "password = hunter22", "Bearer abcdefgh.12", "eyJabcdefg.hijklmn.o", "-----BEGIN RSA PRIVATE KEY-----", "api-key: abcd1234", "nothing here")


@query(f"""WITH s AS (SELECT doc_id AS path, coalesce(text, '') || ' ' || {list(SECRETS)}[(doc_id % {len(SECRETS)} + 1)::INT] || ' end' AS text FROM documents)
SELECT path, regexp_replace(regexp_replace(text, '{SHAPES_SQL}', '<redacted>', 'g'), '{T.OPAQUE}', '<redacted>', 'g') AS text, regexp_replace(text, '{SHAPES_SQL}', '<redacted>', 'g') AS prose FROM s""")
def redact(spark, sf):
    secret = F.element_at(F.array(*map(F.lit, SECRETS)), (F.col("doc_id") % len(SECRETS) + 1).cast("int"))
    d = spread(model.read(spark, sf, "documents")).select(F.col("doc_id").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), secret, F.lit(" end")).alias("text"))
    return d.select("path", T.redact(F.col("text")).alias("text"), T.redact(F.col("text"), opaque=False).alias("prose"))


@query("WITH MODEL SELECT path, line_count, CASE WHEN text = '' THEN 0 WHEN right(text, 1) = chr(10) THEN line_count - 1 ELSE line_count END AS prose_lines FROM files")
def line_count(spark, sf):
    return model.files(spark, sf).select("path", T.code_lines(F.col("text")).alias("line_count"), T.prose_lines(F.col("text")).alias("prose_lines"))


@query("""WITH MODEL, l AS (SELECT path, string_split(text, chr(10)) AS l FROM files)
SELECT path, CASE WHEN len(l) < 2 THEN '(EOF: ' || len(l) || ' lines)' ELSE array_to_string(l[2:least(4, len(l))], chr(10)) END AS part FROM l""")
def read_range(spark, sf):
    return model.files(spark, sf).select("path", T.read_range(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


TOKENS = """tok AS (SELECT path, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}\\p{Co}]+') AS tokens FROM files),
pad AS (SELECT path, tokens, ' ' || array_to_string(tokens, ' ') || ' ' AS padded FROM tok)"""


def _index(spark, sf, what: str = "files") -> Postings.Index:
    """The positional index of the files, or of their rendered summaries: built once in a session, then kept."""
    folder = f"{shared_dir(spark)}/text-index-{what}-{spark.sparkContext.applicationId}-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    docs = lambda: spread(model.files(spark, sf).select("path", "text")) if what == "files" else summary_render(spark, sf)
    return Postings.Index.open(spark, folder) or Postings.Index.create(docs(), folder, "path", "text")


@query(f"WITH MODEL, {TOKENS} SELECT token, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT path, unnest(tokens) AS token FROM tok) GROUP BY 1")
def fts_tokens(spark, sf):
    return _index(spark, sf).counts()


def _fts(name: str, text: str, where: str):
    def run(spark, sf):
        return _index(spark, sf).found(text).select(F.col("doc").alias("path"))

    run.__name__ = name
    query(f"WITH MODEL, {TOKENS} SELECT path FROM pad WHERE {where}")(run)


_fts("fts_and", "the onst", "list_contains(tokens, 'the') AND list_contains(tokens, 'onst')")
_fts("fts_or", "onst OR thsh", "list_contains(tokens, 'onst') OR list_contains(tokens, 'thsh')")
_fts("fts_not", "the NOT and", "list_contains(tokens, 'the') AND NOT list_contains(tokens, 'and')")
_fts("fts_prefix", "onst*", "contains(padded, ' onst')")
_fts("fts_phrase", '"of the"', "contains(padded, ' of the ')")
_fts("fts_initial", "^the", "starts_with(padded, ' the ')")
_fts("fts_fallback", "of:the", "contains(padded, ' of the ')")
_fts("fts_phrase_prefix", '"of the" + o*', "contains(padded, ' of the o')")
_fts("fts_mixed", '(onst OR "of the") NOT (^the OR th*)', "(list_contains(tokens, 'onst') OR contains(padded, ' of the ')) AND NOT (starts_with(padded, ' the ') OR contains(padded, ' th'))")
_fts("fts_near", "NEAR(the onst, 2)", "len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = 'the' AND len(list_filter(range(greatest(i - 3, 1), least(i + 3, len(tokens)) + 1), lambda k: tokens[k] = 'onst')) > 0)) > 0")


@query(f"""WITH MODEL, {TOKENS}, h AS (SELECT s.path, count(DISTINCT from_path) AS n FROM symbols s JOIN edges e ON e.to_name = s.name AND e.kind = 'call' AND from_path <> s.path GROUP BY 1)
SELECT path, coalesce(n, 0) AS called_by FROM (SELECT * FROM pad WHERE list_contains(tokens, 'the') ORDER BY path LIMIT 60) LEFT JOIN h USING (path) ORDER BY 2 DESC, path LIMIT 15""")
def search_ranked(spark, sf):
    s, e = model.symbols(spark, sf), model.edges(spark, sf)
    return X.search(_index(spark, sf), "the", lambda pool: G.centrality_of(pool, s, e)).select("path", "called_by")


# --- sections and summaries ---

HEADS = """hd AS (SELECT page_id AS path, i::INT AS idx, CASE WHEN starts_with(m[i], '<h1') THEN 1 WHEN starts_with(m[i], '<h2') THEN 2 ELSE 3 END::INT AS level, regexp_replace(m[i], '<[^>]*>', '', 'g') AS label, i::BIGINT AS line, n
FROM (SELECT page_id, m, len(m)::BIGINT AS n, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|h2|p)>[^<]*') AS m FROM pages)))"""


def _heads(spark, sf):
    p = model.read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.regexp_extract_all("html", F.lit("<(?:h1|h2|p)>[^<]*"), F.lit(0)).alias("m"))
    x = p.select("path", F.size("m").cast("bigint").alias("n"), F.posexplode("m").alias("i", "t"))
    return x.select("path", (F.col("i") + 1).alias("idx"), F.when(F.col("t").startswith("<h1"), 1).when(F.col("t").startswith("<h2"), 2).otherwise(3).alias("level"), F.regexp_replace("t", "<[^>]*>", "").alias("label"), (F.col("i") + 1).cast("bigint").alias("line"), "n")


@query(f"""WITH {HEADS} SELECT h.path, h.idx, h.level, h.label, h.line, CASE WHEN min(o.line) IS NULL THEN h.n ELSE greatest(h.line, min(o.line) - 1) END AS end_line FROM hd h LEFT JOIN hd o ON o.path = h.path AND o.idx > h.idx AND o.level <= h.level GROUP BY ALL, h.n""".replace("GROUP BY ALL, h.n", "GROUP BY h.path, h.idx, h.level, h.label, h.line, h.n"))
def sections_span(spark, sf):
    return R.section_ends(_heads(spark, sf), F.col("n"))


@query(f"""WITH {HEADS}, b AS (SELECT path, idx, CASE WHEN label = '' THEN 'section-' || line ELSE label END AS base FROM hd), k AS (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY idx) AS k FROM b)
SELECT path, idx, CASE WHEN k = 1 THEN base ELSE base || ' #' || k END AS name FROM k""")
def section_names(spark, sf):
    return R.unique_names(_heads(spark, sf))


@query(f"""WITH {HEADS}, e AS (SELECT h.path, h.idx, h.level, h.label, h.line, CASE WHEN min(o.line) IS NULL THEN h.n ELSE greatest(h.line, min(o.line) - 1) END AS e FROM hd h LEFT JOIN hd o ON o.path = h.path AND o.idx > h.idx AND o.level <= h.level GROUP BY h.path, h.idx, h.level, h.label, h.line, h.n),
b AS (SELECT path, string_agg(repeat('  ', level) || trim(label) || '  # L' || line || CASE WHEN e = line THEN '' ELSE '-' || e END, chr(10) ORDER BY line, idx) AS body FROM e GROUP BY 1)
SELECT page_id AS path, '# ' || page_id || '  [html · ' || (length(html) - length(replace(html, chr(10), '')) + 1) || ' lines · sha:' || left(sha256(html), 8) || ']' || chr(10) || 'sections (L-spans include nested sub-sections):' || chr(10) || coalesce(body, '  (no headings)') AS text
FROM pages LEFT JOIN b ON path = page_id""")
def toc_render(spark, sf):
    pages = model.read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.lit("html").alias("lang"), T.code_lines(F.col("html")).alias("line_count"), F.sha2("html", 256).alias("sha256"))
    s = R.section_ends(_heads(spark, sf), F.col("n")).withColumn("signature", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.regexp_replace("label", "^#+", "")))
    return R.toc(pages, s)


@query(f"""WITH MODEL, {GATED}, f AS (SELECT path, sha256, lang, line_count FROM files WHERE path IN (SELECT path FROM symbols)),
api AS (SELECT s.path, string_agg(repeat('  ', CASE WHEN s.name LIKE '%.%' THEN 2 ELSE 1 END) || s.name || CASE WHEN s.line = 0 THEN '' ELSE '  # L' || s.line END, chr(10) ORDER BY t.line, t.name, s.name LIKE '%.%', s.line, s.name) AS api FROM symbols s JOIN symbols t ON s.path = t.path AND t.name = split_part(s.name, '.', 1) GROUP BY 1),
im AS (SELECT from_path AS path, string_agg(to_name, ', ' ORDER BY to_name) AS deps FROM (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY to_name) AS r FROM (SELECT DISTINCT from_path, to_name FROM edges WHERE kind = 'import')) WHERE r <= 10 GROUP BY 1),
ca AS (SELECT from_path AS path, string_agg(to_name, ', ' ORDER BY to_name) FILTER (r <= 15) || CASE WHEN count(*) > 15 THEN ' (+' || (count(*) - 15) || ' more)' ELSE '' END AS calls FROM (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY to_name) AS r FROM (SELECT DISTINCT from_path, to_name FROM resolved WHERE kind = 'call' AND to_path IS NOT NULL AND to_path <> from_path)) GROUP BY 1),
cb AS (SELECT path, string_agg('  ' || name || ' ← ' || s || CASE WHEN n > 5 THEN ' (+' || (n - 5) || ' more)' ELSE '' END, chr(10) ORDER BY name) AS called FROM (SELECT path, name, string_agg(from_path::VARCHAR, ', ' ORDER BY from_path) FILTER (r <= 5) AS s, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY from_path) AS r FROM gated) GROUP BY 1, 2) GROUP BY 1)
SELECT f.path, '# ' || f.path || '  [' || lang || ' · ' || line_count || ' loc · sha:' || left(sha256, 8) || ']' || chr(10) || 'api:' || chr(10) || coalesce(api, '  (none)') || chr(10) || 'deps: ' || coalesce(deps, '(none)') || chr(10) || 'calls: ' || coalesce(calls, '(none)') || chr(10) || 'called_by:' || chr(10) || coalesce(called, '  (none)') AS text
FROM f LEFT JOIN api USING (path) LEFT JOIN im USING (path) LEFT JOIN ca USING (path) LEFT JOIN cb USING (path)""")
def summary_render(spark, sf):
    s, e, stems = _gate(spark, sf)
    f = model.files(spark, sf).join(stems, "path", "left_semi")
    # only what is a file is looked at: its symbols, what it calls and imports, and the first callers of each symbol
    paths = kept(f.select("path").distinct(), "file-paths")
    mine, its = s.join(paths, "path", "left_semi"), _resolved(spark, sf).join(paths.withColumnRenamed("path", "from_path"), "from_path", "left_semi")
    return R.summaries(f, mine, its, G.first_callers(mine, e, stems.join(paths, "path", "left_semi"), R.MAX_CALLERS))


# --- transcripts ---


def _calls(spark, sf):
    """Each user turn calls read, grep or list on a document by its conversation and turn; one id in seven is used twice."""
    t = model.read(spark, sf, "conversations")
    i = F.col("conv_id") * 8 + F.col("turn")
    name = F.element_at(F.array(*map(F.lit, ("Read", "grep", "ls", "index_search"))), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    return t.select("conv_id", "turn", F.when(F.pmod(i, F.lit(7)) == 0, "dup").otherwise(F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("id"), name.alias("name"), F.create_map(F.lit("path"), F.pmod(i, F.lit(1000)).cast("string")).alias("input"))


CALLS = """calls AS (SELECT conv_id, turn, CASE WHEN (conv_id * 8 + turn) % 7 = 0 THEN 'dup' ELSE 'c' || turn END AS id, ['Read', 'grep', 'ls', 'index_search'][((conv_id * 8 + turn) % 4 + 1)::INT] AS name, ((conv_id * 8 + turn) % 1000)::VARCHAR AS path FROM conversations)"""


@query(f"""WITH MODEL, {CALLS}, seen AS (SELECT DISTINCT conv_id, path FROM calls WHERE turn = 0 AND name = 'Read')
SELECT c.conv_id, turn, id, name, CASE WHEN starts_with(name, 'index_') THEN 'virtual' WHEN name = 'Read' AND f.path IS NOT NULL AND s.path IS NULL THEN 'gated' ELSE 'host' END AS kind,
  CASE WHEN name = 'Read' AND f.path IS NOT NULL AND s.path IS NULL THEN c.path END AS path
FROM calls c LEFT JOIN (SELECT path::VARCHAR AS path FROM files WHERE line_count > 5) f ON f.path = c.path LEFT JOIN seen s ON s.conv_id = c.conv_id AND s.path = c.path""")
def gate_decision(spark, sf):
    calls = _calls(spark, sf)
    f = model.files(spark, sf).select(F.col("path").cast("string").alias("path"), "line_count")
    seen = calls.where("turn = 0 and name = 'Read'").select("conv_id", F.col("input")["path"].alias("path"))
    return C.classify(calls, f, seen, 5).drop("input")


@query(f"""WITH {CALLS}, g AS (SELECT conv_id, id, CASE WHEN count(DISTINCT name) = 1 THEN min(name) ELSE '' END AS name FROM calls GROUP BY 1, 2)
SELECT conv_id, turn, 'c' || turn AS id, coalesce(name, '') AS name FROM conversations LEFT JOIN g USING (conv_id) WHERE false
UNION ALL SELECT c.conv_id, c.turn, 'c' || c.turn, coalesce(g.name, '') FROM conversations c LEFT JOIN g ON g.conv_id = c.conv_id AND g.id = 'c' || c.turn""")
def tool_result_correlation(spark, sf):
    results = model.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"))
    return C.with_names(results, _calls(spark, sf)).select("conv_id", "turn", "id", "name")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 AS is_fresh FROM conversations")
def fresh_window(spark, sf):
    r = model.read(spark, sf, "conversations").select("conv_id", "turn", F.lit(0).alias("idx"))
    return C.fresh(r, 2).drop("idx")


@query("""WITH l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT doc_id, 'f' || (k % 3) AS p, k, trim(l) AS r FROM l WHERE NOT (k = n AND l = '' AND n > 1) ),
g AS (SELECT doc_id, p, min(k) AS first, count(*) AS n, string_agg('  ' || k || ': ' || r, chr(10) ORDER BY k) FILTER (rn <= 8) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY k) AS rn FROM h) GROUP BY 1, 2)
SELECT doc_id, 'grep: ' || sum(n)::BIGINT || ' matches in ' || count(*) || ' files' || chr(10) || string_agg(p || chr(10) || t || CASE WHEN n > 8 THEN chr(10) || '  (+' || (n - 8) || ' more matches in this file)' ELSE '' END, chr(10) ORDER BY first) AS bounded FROM g GROUP BY 1""")
def bound_grep(spark, sf):
    d = model.read(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("f"), F.pmod(i + 1, F.lit(3)).cast("string"), F.lit(":"), (i + 1).cast("string"), F.lit(":"), x))
    n = F.size(F.split("text", "\n", -1))
    shown = F.when((F.element_at(F.split("text", "\n", -1), -1) == "") & (n > 1), F.slice(lines, F.lit(1), n - 1)).otherwise(lines)
    return d.select("doc_id", C.bound_grep(F.array_join(shown, "\n")).alias("bounded"))


@query("""WITH p AS (SELECT page_id % 20 AS rid, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS pos FROM pages),
c AS (SELECT regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path, count(*) AS called_by FROM pages GROUP BY 1),
k AS (SELECT p.*, called_by, row_number() OVER (PARTITION BY rid ORDER BY called_by DESC, path, pos) AS rn, count(*) OVER (PARTITION BY rid) AS n FROM p JOIN c USING (path) WHERE regexp_full_match(path, '[\\w ./\\\\-]+')),
s AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM k WHERE rn <= 60),
b AS (SELECT rid, n, dir, min(rn) AS first, dir || '/  (' || count(*) || ')' || chr(10) || string_agg('  ' || split_part(path, '/', -1) || '  ·' || called_by || ' callers', chr(10) ORDER BY rn) AS b FROM s GROUP BY 1, 2, 3)
SELECT rid, 'listing: ' || n || ' paths, ' || count(*) || ' dirs (most-central first)' || chr(10) || string_agg(b, chr(10) ORDER BY first) || CASE WHEN n > 60 THEN chr(10) || '(+' || (n - 60) || ' more paths)' ELSE '' END AS bounded FROM b GROUP BY rid, n""")
def bound_listing(spark, sf):
    p = model.read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://|[?#].*$", "").alias("path"))
    text = p.groupBy(F.pmod("page_id", F.lit(20)).alias("rid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "path"))), lambda x: x["path"]), "\n").alias("text"))
    return C.bound_listings(text, p.groupBy("path").agg(F.count(F.lit(1)).alias("called_by")))


@query("""SELECT DISTINCT conv_id, 'p' || (turn % 3) AS path FROM conversations""")
def marker_extract(spark, sf):
    t = model.read(spark, sf, "conversations").select("conv_id", F.concat("text", F.lit(f" {C.SUMMARY_MARK}p"), F.pmod("turn", F.lit(3)).cast("string"), F.lit("⟫ body")).alias("text"))
    return t.select("conv_id", F.explode(C.marked_paths(F.col("text"))).alias("path")).distinct()


# --- measures ---


@query("""SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens, (sum(greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS billed FROM conversations""")
def replay_running_tokens(spark, sf):
    return A.running_tokens(model.read(spark, sf, "conversations"))


@query("""WITH t AS (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS a, greatest(1, least(length(coalesce(text, '')), 200) // 4) AS b FROM conversations),
s AS (SELECT conv_id, sum(a) OVER w AS a, sum(b) OVER w AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, sum(a)::BIGINT AS raw, sum(b)::BIGINT AS short, round(100 * (sum(a) - sum(b))::DOUBLE / greatest(sum(a), 1), 2) AS short_cut FROM s GROUP BY 1""")
def replay_variants(spark, sf):
    return A.replay(model.read(spark, sf, "conversations"), {"short": lambda t: F.left(t, F.lit(200))})


FILE_TOKENS = "ft AS (SELECT *, greatest(1, length(text) // 4)::BIGINT AS full_tokens, greatest(1, least(length(text), 400) // 4)::BIGINT AS short_tokens, (path % 4) AS bucket FROM files)"


def _file_tokens(spark, sf):
    return model.files(spark, sf).withColumns({"full_tokens": T.token_estimate(F.col("text")), "short_tokens": T.token_estimate(F.left("text", F.lit(400))), "bucket": F.pmod("path", F.lit(4)), "n_chars": F.length("text").cast("bigint")})


@query(f"""WITH MODEL, {FILE_TOKENS} SELECT lang, bucket, sum(full_tokens)::BIGINT AS full_tokens, sum(short_tokens)::BIGINT AS short_tokens, round(100.0::DOUBLE * (sum(full_tokens) - sum(short_tokens)) / sum(full_tokens), 4) AS cut
FROM ft GROUP BY GROUPING SETS ((lang), (bucket), ())""")
def token_savings_by_group(spark, sf):
    return A.savings(_file_tokens(spark, sf), "full_tokens", "short_tokens", "lang", "bucket")


@query(f"WITH MODEL, {FILE_TOKENS} SELECT t::BIGINT AS threshold, sum(CASE WHEN line_count > t THEN short_tokens ELSE full_tokens END)::BIGINT AS tokens FROM ft, unnest([0, 50, 75, 150, 400]) u(t) GROUP BY 1")
def gate_threshold_sweep(spark, sf):
    return A.gate_sweep(_file_tokens(spark, sf))


@query(f"WITH MODEL, {FILE_TOKENS} SELECT f::DOUBLE AS fallback, sum(short_tokens)::DOUBLE + f::DOUBLE * sum(full_tokens) AS tokens FROM ft, unnest([0.0, 0.25, 0.5]) u(f) GROUP BY f")
def fallback_sweep(spark, sf):
    return A.fallback_sweep(_file_tokens(spark, sf))


@query("""SELECT * FROM (SELECT conv_id, turn AS turn_id, greatest(1, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4)::BIGINT AS tokens_in_est, greatest(1, length(text) // 4)::BIGINT AS tokens_out, role FROM conversations) WHERE role = 'assistant'""".replace("SELECT * FROM", "SELECT conv_id, turn_id, tokens_in_est, tokens_out FROM"))
def token_ledger(spark, sf):
    return A.ledger(model.read(spark, sf, "conversations"))


@query("""WITH g AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS "both", count(*) FILTER (quality = 1 AND toxic = 0) AS only_control, count(*) FILTER (quality = 0 AND toxic = 1) AS only_treatment, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels)
SELECT *, round(CASE WHEN only_control + only_treatment = 0 THEN 0 ELSE greatest(abs(only_control - only_treatment) - 1, 0)::DOUBLE ** 2 / (only_control + only_treatment) END, 6) AS statistic,
  round(("both" + only_control) / ("both" + only_control + only_treatment + neither), 4) AS control_rate, round(("both" + only_treatment) / ("both" + only_control + only_treatment + neither), 4) AS treatment_rate FROM g""")
def mcnemar(spark, sf):
    return A.contingency(model.read(spark, sf, "labels").select((F.col("quality") == 1).alias("control"), (F.col("toxic") == 1).alias("treatment")))


@query(f"""WITH g AS ({ORACLES['mcnemar']}), t AS (SELECT statistic, statistic / 2 AS z2, n FROM g, range(0, 200) r(n))
SELECT any_value(statistic)::DOUBLE AS statistic, round(CASE WHEN any_value(statistic) <= 0 THEN 1 WHEN any_value(statistic) > 60 THEN 0
  ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-any_value(z2)) * sum(exp(0.5 * ln(z2) + n * ln(2 * z2) - (lgamma(2 * n + 3) - (n + 1) * ln(2) - lgamma(n + 2))) )) END, 6)::DOUBLE AS p_value FROM (SELECT statistic, greatest(z2, 1e-300) AS z2, n FROM t)""")
def mcnemar_p(spark, sf):
    return A.with_p_value(mcnemar(spark, sf))


@query("""WITH MODEL SELECT sum(length(text))::BIGINT AS chars, sum(line_count)::BIGINT AS lines, arg_max(path, (length(text), -path)) AS spotlight, max(length(text))::BIGINT AS spotlight_chars FROM files""")
def top_spotlight(spark, sf):
    return A.spotlight(_file_tokens(spark, sf))


# --- change streams ---


@query("""WITH s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events))
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s""")
def debounce_sessions(spark, sf):
    e = model.read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    out = W.sessions(e, "user_id", "t", 1800)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("""WITH s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events))
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def debounce_stream(spark, sf):
    """The stream's closed sessions, written by a finished stream and read back: all but those open at the last event."""
    out = f"{shared_dir(spark)}/debounced-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("user_id", F.col("ts").cast("timestamp").alias("t"))
    q = W.debounced(events, "user_id", "t", "30 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("user_id bigint, first_ts timestamp, last_ts timestamp, n bigint").parquet(out)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("""SELECT user_id::VARCHAR AS path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, 1::INT AS attempt FROM events GROUP BY 1""")
def debounce_timers(spark, sf):
    """A stream by timers whose first update fails: every user comes out once, at the second attempt, with no further event."""
    folder, first = f"{shared_dir(spark)}/timers-{uuid.uuid4().hex}", []
    schema = spark.read.parquet(f"{sf}/events.parquet").schema

    def update(batch: DataFrame, epoch: int) -> None:
        if not first:
            first.append(epoch)
            raise RuntimeError("the first update fails")
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(F.col("user_id").alias("path"), "ts")
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    out = lambda: spark.read.schema(W.CHANGED).parquet(f"{folder}/out")
    q = W.follow(events, update, folder)
    try:
        W.wait_for(q, lambda: W.exists(spark, f"{folder}/out") and (out().agg(F.sum("n")).first()[0] or 0) >= total)
    finally:
        q.stop()
    return out().drop("epoch").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


__all__ = ["ORACLES", "QUERIES", "Window"]
