"""Queries about links and names, over notes derived from ``documents``: odd names, many moves at once,
many names at once, places in one order, alignment scores. Each has its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NOTES_SQL, notes_from_documents
from ..operators import links, moves, resolve, search
from ..session import on_workers

#: What the names of notes end in, by id: names that hold the characters which open and close links.
ODD_ENDS = ("", " [x]", "#h", "|p", " (v)", "]]", "[[(", "](q", "[[#|]](a)")


def documents(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def notes(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return notes_from_documents(docs, docs.count())


_WITH = f"WITH {NOTES_SQL}"


def odd_notes(spark, sf_dir: str) -> DataFrame:
    """A note per document, of names with odd characters, and links to three others in each."""
    docs = documents(spark, sf_dir)
    n = F.lit(docs.count())
    name = lambda d: F.concat(F.lit("Doc_"), d.cast("string"), F.element_at(F.array(*map(F.lit, ODD_ENDS)), F.pmod(d, F.lit(len(ODD_ENDS))).cast("int") + 1))
    d = F.col("doc_id")
    stem = F.concat_ws("/", "source", F.concat("lang", F.when(d % 5 == 0, " (l)").otherwise("")), name(d))
    one, two, three = (F.pmod(d * a + b, n) for a, b in ((7, 3), (13, 1), (11, 5)))
    other = docs.select(d.alias("__id"), stem.alias("__stem"))
    content = F.concat_ws(
        "\n", "text", F.concat(F.lit("See [[["), name(one), F.lit("]] and [["), F.lower(name(two)), F.lit("|alias]](")), F.concat(F.lit("md ]("), "__stem", F.lit(".md) ](./"), "__stem", F.lit(") [["), "__stem", F.lit("#s]]")),
    )
    out = docs.withColumn("__three", three).join(other, F.col("__three") == F.col("__id"))
    return out.select(
        F.concat(stem, F.lit(".md")).alias("path"), F.octet_length(content).cast("long").alias("size"), F.pmod("doc_id", F.lit(97)).cast("long").alias("mtime_ns"),
        F.lit(0o644).alias("mode"), content.alias("content"),
    )


_NAME = "('Doc_' || {0} || [" + ", ".join(f"'{e}'" for e in ODD_ENDS) + f"][{{0}} % {len(ODD_ENDS)} + 1])"
_ODD_SQL = f"""
n AS (SELECT count(*) AS n FROM documents),
base AS (SELECT doc_id, text, n, source || '/' || lang || CASE WHEN doc_id % 5 = 0 THEN ' (l)' ELSE '' END || '/' || {_NAME.format("doc_id")} AS stem FROM documents, n),
notes AS (
  SELECT b.stem || '.md' AS path, b.stem, b.text || chr(10)
    || 'See [[[' || {_NAME.format("((b.doc_id * 7 + 3) % b.n)")} || ']] and [[' || lower({_NAME.format("((b.doc_id * 13 + 1) % b.n)")}) || '|alias]](' || chr(10)
    || 'md ](' || t.stem || '.md) ](./' || t.stem || ') [[' || t.stem || '#s]]' AS content
  FROM base b JOIN base t ON t.doc_id = (b.doc_id * 11 + 5) % b.n
)
"""


def q_backlinks_odd_names(spark, sf_dir):
    """Backlinks of all notes where names hold all characters that open or close links."""
    found = links.all_backlinks(odd_notes(spark, sf_dir))
    return found.select("target_path", "file_path", F.col("line_number").cast("long").alias("line_number"), "match_line")


#: Every pattern of every note is tested on every line.
BACKLINKS_ODD = f"""
WITH {_ODD_SQL},
l AS (SELECT path, pos, line, lower(line) AS low FROM (SELECT path, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT path, string_split(content, chr(10)) AS a FROM notes)) WHERE contains(line, '[[') OR contains(line, '](')),
k AS (SELECT path, lower(stem) AS s, lower(string_split(stem, '/')[-1]) AS b FROM notes),
p AS (SELECT DISTINCT path, unnest(['[[' || b || ']]', '[[' || b || '|', '[[' || b || '#', '[[' || s || ']]', '[[' || s || '|', '[[' || s || '#', '](' || s || '.md)', '](' || s || ')', '](./' || s || '.md)', '](./' || s || ')']) AS p FROM k)
SELECT DISTINCT p.path AS target_path, l.path AS file_path, CAST(pos AS BIGINT) AS line_number, trim(line) AS match_line
FROM l JOIN p ON contains(low, p) WHERE l.path <> p.path
"""


def _moves(spark, sf_dir: str) -> DataFrame:
    """Of four documents each the first two swap their places, the third goes to the archive."""
    docs = documents(spark, sf_dir)
    n = docs.count()
    d = F.col("doc_id")
    to = F.when((d % 4 == 0) & (d + 1 < n), d + 1).when(d % 4 == 1, d - 1)
    stem = lambda c: F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), c.cast("string")))
    at = docs.select(d.alias("__id"), stem(d).alias("__stem"))
    out = docs.select("doc_id", stem(d).alias("old"), to.alias("to")).join(at, F.col("to") == F.col("__id"), "left")
    return out.where("doc_id % 4 < 3").select("old", F.coalesce("__stem", F.when(d % 4 == 2, F.concat(F.lit("archive/x"), d.cast("string")))).alias("new"))


_MOVED_SQL = """
m AS (SELECT b.doc_id, coalesce(t.stem, CASE WHEN b.doc_id % 4 = 2 THEN 'archive/x' || b.doc_id END, b.stem) AS new FROM base b
  LEFT JOIN base t ON t.doc_id = CASE b.doc_id % 4 WHEN 0 THEN b.doc_id + 1 WHEN 1 THEN b.doc_id - 1 END),
moved AS (
  SELECT b.stem || '.md' AS path, m.new || '.md' AS new_path, content,
    '---' || chr(10) || 'title: doc_' || b.doc_id || chr(10) || 'lang: ' || b.lang || chr(10) || '---' || chr(10) || b.text || chr(10)
    || 'See [[' || string_split(m1.new, '/')[-1] || ']] and [[' || string_split(m2.new, '/')[-1] || '|alias]]' || chr(10) || 'md [x](' || m3.new || '.md)' AS new_content
  FROM base b JOIN m USING (doc_id) JOIN notes ON notes.path = b.stem || '.md' JOIN m m1 ON m1.doc_id = (b.doc_id * 7 + 3) % b.n JOIN m m2 ON m2.doc_id = (b.doc_id * 13 + 1) % b.n JOIN m m3 ON m3.doc_id = (b.doc_id * 11 + 5) % b.n)
"""


def q_move_many(spark, sf_dir):
    """All notes after swaps and moves of three of four of them."""
    return moves.moved_all(notes(spark, sf_dir), _moves(spark, sf_dir)).select("path", F.md5("content").alias("content_md5"))


def q_rewrite_many_changed(spark, sf_dir):
    """The notes that those moves rewrite, under their old paths."""
    return moves.rewritten_all(notes(spark, sf_dir), _moves(spark, sf_dir)).select("path", F.md5("content").alias("content_md5"))


def crowded(spark, sf_dir: str) -> DataFrame:
    """Few names in many folders, some inside others, so that most names have several candidates."""
    d = F.col("doc_id")
    folder = F.concat(F.lit("s"), (d % 7).cast("string"), F.when(d % 3 > 0, F.concat(F.lit("/"), "lang")).otherwise(""), F.when(d % 3 == 2, "/deep").otherwise(""))
    path = F.when(d % 11 == 0, F.concat(F.lit("n"), (d % 40).cast("string"))).otherwise(F.concat(folder, F.lit("/n"), (d % 40).cast("string")))
    return documents(spark, sf_dir).select(F.concat(path, F.lit(".md")).alias("path")).distinct()


def q_resolve_all(spark, sf_dir):
    """Base names, with and without suffix, full paths, and names of no note, each to its note."""
    own = crowded(spark, sf_dir)
    base = F.substring_index("path", "/", -1)
    names = own.select(F.explode(F.array("path", base, F.regexp_replace(base, r"\.md\z", ""), F.concat(F.lit("no/"), base))).alias("name"))
    return resolve.resolve_all(own, names)


RESOLVE_ALL = """
WITH crowd AS (
  SELECT DISTINCT CASE WHEN doc_id % 11 = 0 THEN 'n' || (doc_id % 40) ELSE 's' || (doc_id % 7) || CASE WHEN doc_id % 3 > 0 THEN '/' || lang ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN '/deep' ELSE '' END || '/n' || (doc_id % 40) END || '.md' AS path FROM documents
), names AS (
  SELECT DISTINCT unnest([path, string_split(path, '/')[-1], regexp_replace(string_split(path, '/')[-1], '\\.md$', ''), 'no/' || string_split(path, '/')[-1]]) AS name FROM crowd
), c AS (
  SELECT name, path, string_split(path, '/') AS k, string_split(path, '/')[:-2] AS dir FROM names JOIN crowd
  ON path = CASE WHEN name LIKE '%.md' THEN name ELSE name || '.md' END OR string_split(path, '/')[-1] = CASE WHEN name LIKE '%.md' THEN name ELSE name || '.md' END
), r AS (
  SELECT name, arg_max(path, k) AS path FROM c WHERE NOT EXISTS (SELECT 1 FROM c m WHERE m.name = c.name AND len(m.dir) < len(c.dir) AND c.dir[:len(m.dir)] = m.dir AND m.k < c.k) GROUP BY name
)
SELECT name, path FROM names LEFT JOIN r USING (name)
"""


def q_list_notes_ranked(spark, sf_dir):
    """Each note's place among all notes, in walk order."""
    return resolve.ranked_notes(notes(spark, sf_dir)).select("path", "place")


FUZZY_QUERY = "sen7"


def q_fuzzy_scores(spark, sf_dir):
    """The alignment score of every note's path on which the query can be placed."""
    own = notes(spark, sf_dir).select("path", search.alignment_score(F.col("path"), FUZZY_QUERY).cast("long").alias("score"))
    return own.where("score is not null")


def q_fuzzy_ranked(spark, sf_dir):
    return search.fuzzy_ranked(notes(spark, sf_dir), FUZZY_QUERY, 10).select("path", F.col("score").cast("long").alias("score"))


def _fuzzy_sql(query: str) -> str:
    """A recursive table: a step a character, with the scores of each prefix of the query."""
    n = len(query)
    start = f"CASE WHEN i = 0 OR NOT regexp_matches(s[i], '[\\p{{L}}\\p{{N}}]') THEN {search.START} ELSE 0 END"
    hits = [f"CASE WHEN s[i + 1] = '{ch}' THEN {search.MATCH} + {start}{f' + greatest(h{j - 1} + {search.RUN}, p{j - 1})' if j else ''} END AS h{j}" for j, ch in enumerate(query)]
    past = [f"greatest(h{j} - {search.GAP + search.SKIP}, p{j} - {search.SKIP}) AS p{j}" for j in range(n)]
    best = hits[-1].rsplit(" AS ", 1)[0]
    nulls = ", ".join(f"CAST(NULL AS INTEGER) AS {x}{j}" for x in "hp" for j in range(n))
    return f"""WITH RECURSIVE {NOTES_SQL}, f AS (
  SELECT path, lower(path) AS s, 0 AS i, {nulls}, CAST(NULL AS INTEGER) AS best FROM notes
  UNION ALL SELECT path, s, i + 1, {", ".join(hits)}, {", ".join(past)}, greatest(best, {best}) FROM f WHERE i < length(s)
) SELECT path, CAST(best AS BIGINT) AS score FROM f WHERE i = length(s) AND best IS NOT NULL"""


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}

SQL = {
    "backlinks_odd_names": BACKLINKS_ODD,
    "move_many": f"{_WITH}, {_MOVED_SQL} SELECT new_path AS path, md5(new_content) AS content_md5 FROM moved",
    "rewrite_many_changed": f"{_WITH}, {_MOVED_SQL} SELECT path, md5(new_content) AS content_md5 FROM moved WHERE content <> new_content",
    "resolve_all": RESOLVE_ALL,
    "list_notes_ranked": f"{_WITH} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM notes",
    "fuzzy_scores": _fuzzy_sql(FUZZY_QUERY),
    "fuzzy_ranked": f"SELECT path, score FROM ({_fuzzy_sql(FUZZY_QUERY)}) ORDER BY score DESC, length(path), string_split(path, '/') LIMIT 10",
}
