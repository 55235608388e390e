"""Queries over the test tables, one per operator, each with the same query for DuckDB.

Link and header queries run over the notes view that :mod:`marginalia.model` derives from
``documents``. Each runs over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import paths, text
from ..model import NOTES_SQL, SEARCH_CAP, notes_from_documents
from ..operators import dml, links, resolve, search
from ..scratch import shared_dir
from ..session import on_workers
from ..sources import registry
from . import linking, vaults

TERM, TARGET_ID, NEW = "the", 10, "archive/renamed"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return notes_from_documents(docs, docs.count())  # the count comes from the files' footers


def target(spark: SparkSession, sf_dir: str) -> str:
    """The path of one note, which single-note queries are about."""
    d = documents(spark, sf_dir).where(F.col("doc_id") == TARGET_ID).select("source", "lang").first()
    return f"{d.source}/{d.lang}/doc_{TARGET_ID}.md"


_TARGET_SQL = f"(SELECT stem FROM base WHERE doc_id = {TARGET_ID})"
_WITH = f"WITH {NOTES_SQL}"
_LINES = "SELECT path, mtime_ns, generate_subscripts(a, 1) AS line_number, unnest(a) AS line FROM (SELECT path, mtime_ns, string_split(content, chr(10)) AS a FROM notes)"


def q_search_content(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    return search.search_lines(docs, TERM).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "line")


SEARCH_CONTENT = f"""
SELECT doc_id, CAST(pos AS BIGINT) AS line_number, line
FROM (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
WHERE contains(lower(line), '{TERM}')
"""


def _search_sql(query: str, text_of_match: str) -> str:
    return f"""
l AS ({_LINES}), hit AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS m FROM l WHERE contains(lower(line), '{query}')),
named AS (SELECT path, 0 AS line_number, '(filename match: ' || string_split(path, '/')[-1] || ')' AS m FROM notes WHERE contains(lower(path), '{query}') AND path NOT IN (SELECT path FROM hit)),
found AS (SELECT path AS file_path, line_number, {text_of_match} AS t FROM hit UNION ALL SELECT path, line_number, {'hex(m)' if 'hex' in text_of_match else 'm'} FROM named)
"""


_SNIP = (
    "CASE WHEN strlen(m) <= 80 THEN hex(m) ELSE (SELECT CASE WHEN s > 0 THEN '2E2E2E' ELSE '' END || substr(hex(m), 2 * s + 1, 2 * (e - s - CASE WHEN s > 0 AND e < n THEN 3 ELSE 0 END))"
    " || CASE WHEN e < n THEN '2E2E2E' ELSE '' END FROM (SELECT greatest(p - 20, 0) AS s, least(p + {k} + 20, strlen(m)) AS e, strlen(m) AS n"
    " FROM (SELECT strlen(split_part(lower(m), '{q}', 1)) AS p))) END"
)


def q_search_snippet(spark, sf_dir):
    return search.search_notes(notes(spark, sf_dir), TERM, as_bytes=True).select("file_path", F.col("line_number").cast("long").alias("line_number"), F.hex("match_line").alias("match_hex"))


SEARCH_SNIPPET = f"{_WITH}, {_search_sql(TERM, _SNIP.format(q=TERM, k=len(TERM)))} SELECT file_path, CAST(line_number AS BIGINT) AS line_number, t AS match_hex FROM found"

FOLDER = "src7/"


def q_search_filename_fallback(spark, sf_dir):
    return search.search_notes(notes(spark, sf_dir), FOLDER).select("file_path", F.col("line_number").cast("long").alias("line_number"), "match_line")


SEARCH_FALLBACK = f"{_WITH}, {_search_sql(FOLDER, 'm')} SELECT file_path, CAST(line_number AS BIGINT) AS line_number, t AS match_line FROM found"


def q_search_display(spark, sf_dir):
    return search.display(search.search_notes(notes(spark, sf_dir), FOLDER)).select("display")


SEARCH_DISPLAY = f"""{_WITH}, {_search_sql(FOLDER, 'm')}
SELECT rpad(p, (SELECT max(strlen(CASE WHEN line_number > 0 THEN file_path || ':' || line_number ELSE file_path END)) FROM found)::INTEGER, ' ') || ' | ' || t AS display
FROM (SELECT CASE WHEN line_number > 0 THEN file_path || ':' || line_number ELSE file_path END AS p, t FROM found)
"""


def q_list_notes(spark, sf_dir):
    return resolve.list_notes(notes(spark, sf_dir))


def q_read_note(spark, sf_dir):
    return resolve.read_note(notes(spark, sf_dir), f"doc_{TARGET_ID}").select("path", F.md5("content").alias("content_md5"))


def q_resolve_note(spark, sf_dir):
    return resolve.resolve(notes(spark, sf_dir), f"doc_{TARGET_ID}")


RESOLVE = f"""{_WITH}, c AS (SELECT path, string_split(path, '/') AS k, string_split(path, '/')[:-2] AS dir FROM notes WHERE path = 'doc_{TARGET_ID}.md' OR string_split(path, '/')[-1] = 'doc_{TARGET_ID}.md')
SELECT arg_max(path, k) AS path FROM c WHERE NOT EXISTS (SELECT 1 FROM c m WHERE len(m.dir) < len(c.dir) AND c.dir[:len(m.dir)] = m.dir AND m.k < c.k) HAVING count(*) > 0
"""


def q_backlinks_one(spark, sf_dir):
    found = links.backlinks(notes(spark, sf_dir), target(spark, sf_dir))
    return found.select("file_path", F.col("line_number").cast("long").alias("line_number"), "match_line", "mtime_ns")


_BACK = f"""
t AS (SELECT lower(stem) AS stem, 'doc_{TARGET_ID}' AS b FROM base WHERE doc_id = {TARGET_ID}),
p AS (SELECT unnest(['[[' || b || ']]', '[[' || b || '|', '[[' || b || '#', '[[' || stem || ']]', '[[' || stem || '|', '[[' || stem || '#',
  '](' || stem || '.md)', '](' || stem || ')', '](./' || stem || '.md)', '](./' || stem || ')']) AS p FROM t),
back AS (SELECT path AS file_path, line_number, trim(line) AS match_line, mtime_ns FROM ({_LINES}) WHERE path <> {_TARGET_SQL} || '.md' AND EXISTS (SELECT 1 FROM p WHERE contains(lower(line), p)))
"""
BACKLINKS_ONE = f"{_WITH}, {_BACK} SELECT file_path, CAST(line_number AS BIGINT) AS line_number, match_line, mtime_ns FROM back"


def q_mentions_section(spark, sf_dir):
    return links.mentions(links.backlinks(notes(spark, sf_dir), target(spark, sf_dir)))


MENTIONS = f"""{_WITH}, {_BACK}, f AS (
  SELECT file_path, mtime_ns, chr(10) || '**[[' || regexp_replace(file_path, '\\.md$', '') || ']]**' || chr(10) || string_agg('- ' || match_line || chr(10), '' ORDER BY line_number) AS b FROM back GROUP BY file_path, mtime_ns
) SELECT chr(10) || chr(10) || '## Linked Mentions' || chr(10) || string_agg(b, '' ORDER BY mtime_ns DESC, string_split(file_path, '/')) AS section FROM f HAVING count(*) > 0
"""


def q_backlinks_all(spark, sf_dir):
    return links.all_backlinks(notes(spark, sf_dir)).select("target_path", "file_path", F.col("line_number").cast("long").alias("line_number"), "match_line")


_EDGES = f"""
e AS (SELECT DISTINCT path AS src_path, line_number, line, kind, target FROM (
  SELECT path, line_number, line, 'wiki' AS kind, unnest([lower(x) FOR x IN regexp_extract_all(line, '\\[\\[([^\\]|#\\[]+)(?:\\]\\]|\\||#)', 1)]) AS target FROM ({_LINES})
  UNION ALL SELECT path, line_number, line, 'md', unnest([regexp_replace(lower(x), '\\.md$', '') FOR x IN regexp_extract_all(line, '\\]\\((?:\\./)?([^)]*)\\)', 1)]) FROM ({_LINES}))),
names AS (SELECT DISTINCT path, kind, target FROM (SELECT path, unnest([{{'kind': 'wiki', 'target': lower(regexp_replace(string_split(path, '/')[-1], '\\.md$', ''))}}, {{'kind': 'wiki', 'target': lower(regexp_replace(path, '\\.md$', ''))}}, {{'kind': 'md', 'target': lower(regexp_replace(path, '\\.md$', ''))}}], recursive := true) FROM notes)),
pairs AS (SELECT DISTINCT n.path AS target_path, e.src_path AS file_path, e.line_number, e.line FROM e JOIN names n USING (kind, target) WHERE n.path <> e.src_path)
"""
BACKLINKS_ALL = f"{_WITH}, {_EDGES} SELECT target_path, file_path, CAST(line_number AS BIGINT) AS line_number, trim(line) AS match_line FROM pairs"


def q_link_indegree(spark, sf_dir):
    return links.in_degree(notes(spark, sf_dir))


def q_link_outdegree(spark, sf_dir):
    return links.out_degree(notes(spark, sf_dir))


def q_orphan_notes(spark, sf_dir):
    return links.orphans(notes(spark, sf_dir))


def q_dangling_links(spark, sf_dir):
    """What deleting one note leaves dangling."""
    left = dml.deleted(notes(spark, sf_dir), target(spark, sf_dir))
    return links.dangling(left).withColumn("line_number", F.col("line_number").cast("long"))


def q_backlink_patterns(spark, sf_dir):
    return notes(spark, sf_dir).select("path", F.explode(links.link_shapes(F.col("path"))).alias("pattern"))


PATTERNS = f"""{_WITH}, s AS (SELECT path, regexp_replace(path, '\\.md$', '') AS p, regexp_replace(string_split(path, '/')[-1], '\\.md$', '') AS b FROM notes)
SELECT path, unnest(['[[' || b || ']]', '[[' || b || '|', '[[' || b || '#', '[[' || p || ']]', '[[' || p || '|', '[[' || p || '#', '](' || p || '.md)', '](' || p || ')', '](./' || p || '.md)', '](./' || p || ')']) AS pattern FROM s
"""


def q_rewrite_links_changed(spark, sf_dir):
    return links.rewritten(notes(spark, sf_dir), target(spark, sf_dir), NEW).select("path", F.md5("content").alias("content_md5"))


def _rewrite_sql(content: str) -> str:
    s, b = _TARGET_SQL, f"'doc_{TARGET_ID}'"
    new_b = NEW.rsplit("/", 1)[-1]
    for end in ("]]", "|", "#"):
        content = f"replace({content}, '[[' || {b} || '{end}', '[[{new_b}{end}')"
    for end in ("]]", "|", "#"):
        content = f"replace({content}, '[[' || {s} || '{end}', '[[{NEW}{end}')"
    for lead in ("](", "](./"):
        content = f"replace(replace({content}, '{lead}' || {s} || '.md)', '{lead}{NEW}.md)'), '{lead}' || {s} || ')', '{lead}{NEW})')"
    return content


REWRITE = f"{_WITH}, r AS (SELECT path, content, {_rewrite_sql('content')} AS new FROM notes WHERE NOT starts_with(string_split(path, '/')[-1], '.')) SELECT path, md5(new) AS content_md5 FROM r WHERE new <> content"


def q_move_note_plan(spark, sf_dir):
    return dml.move_plan(notes(spark, sf_dir), target(spark, sf_dir), NEW)


MOVE_PLAN = f"""{_WITH}, r AS (SELECT path, content, {_rewrite_sql('content')} AS new FROM notes)
SELECT 'rename' AS action, path, '{NEW}.md' AS new_path FROM notes WHERE path = {_TARGET_SQL} || '.md'
UNION ALL SELECT 'rewrite', CASE WHEN path = {_TARGET_SQL} || '.md' THEN '{NEW}.md' ELSE path END, NULL FROM r WHERE new <> content
"""


def q_move_note(spark, sf_dir):
    return dml.moved(notes(spark, sf_dir), target(spark, sf_dir), NEW).select("path", F.md5("content").alias("content_md5"))


MOVED = f"{_WITH} SELECT CASE WHEN path = {_TARGET_SQL} || '.md' THEN '{NEW}.md' ELSE path END AS path, md5({_rewrite_sql('content')}) AS content_md5 FROM notes"


def q_delete_note_plan(spark, sf_dir):
    return dml.deleted(notes(spark, sf_dir), target(spark, sf_dir)).select("path")


def q_overwrite_note(spark, sf_dir):
    return dml.with_content(notes(spark, sf_dir), target(spark, sf_dir), "new text\n").select("path", F.md5("content").alias("content_md5"))


def _changes(spark, sf_dir):
    """A change per English document to its own note, and a new note per French one."""
    d = documents(spark, sf_dir)
    stem = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    old = d.where("lang = 'en'").select(F.concat(stem, F.lit(".md")).alias("path"), F.concat(F.lit("\nseen in "), "source").alias("content"))
    new = d.where("lang = 'fr'").select(F.concat(F.lit("new/"), stem, F.lit(".md")).alias("path"), F.col("source").alias("content"))
    return old.unionByName(new)


def q_upsert_append(spark, sf_dir):
    return dml.upserted(notes(spark, sf_dir), _changes(spark, sf_dir), append=True).select("path", F.md5("content").alias("content_md5"))


def q_upsert_overwrite(spark, sf_dir):
    return dml.upserted(notes(spark, sf_dir), _changes(spark, sf_dir), overwrite=True).select("path", F.md5("content").alias("content_md5"))


def q_upsert_new(spark, sf_dir):
    return dml.upserted(notes(spark, sf_dir), _changes(spark, sf_dir)).select("path", F.md5("content").alias("content_md5"))


_CHANGES_SQL = "c AS (SELECT stem || '.md' AS path, chr(10) || 'seen in ' || source AS content FROM base WHERE lang = 'en' UNION ALL SELECT 'new/' || stem || '.md', source FROM base WHERE lang = 'fr')"
UPSERT = f"{_WITH}, {_CHANGES_SQL} SELECT coalesce(n.path, c.path) AS path, md5({{}}) AS content_md5 FROM notes n FULL JOIN c ON n.path = c.path"
UPSERT_NEW = f"""{_WITH}, {_CHANGES_SQL} SELECT path, md5(content) AS content_md5 FROM notes
UNION ALL SELECT CASE WHEN c.path IN (SELECT path FROM notes) THEN regexp_replace(c.path, '\\.md$', '') || ' 1.md' ELSE c.path END, md5(content) FROM c"""


def q_has_frontmatter(spark, sf_dir):
    return notes(spark, sf_dir).select("path", fm.has_header(F.col("content")).alias("has_header"))


def q_frontmatter_keys(spark, sf_dir):
    return notes(spark, sf_dir).select("path", F.array_join(fm.keys(F.col("content")), ",").alias("keys"))


def q_frontmatter_values(spark, sf_dir):
    p = fm.parse(F.col("content"))
    one = notes(spark, sf_dir).select("path", p.alias("p"))
    return one.select("path", F.variant_get("p.values", "$.title", "string").alias("title"), F.variant_get("p.values", "$.lang", "string").alias("lang"), F.md5("p.body").alias("body_md5"))


_BODY_SQL = "regexp_replace(content, '^---\\ntitle: [^\\n]*\\nlang: [^\\n]*\\n---\\n', '')"
_TITLE, _LANG = (f"regexp_extract(content, '^---\\n(?:[^\\n]*\\n)??{k}: ([^\\n]*)', 1)" for k in ("title", "lang"))


def q_frontmatter_set(spark, sf_dir):
    return notes(spark, sf_dir).select("path", fm.set_key(F.col("content"), "status", "[one, two]").alias("r")).select("path", F.md5("r.content").alias("content_md5"))


def q_frontmatter_delete(spark, sf_dir):
    return notes(spark, sf_dir).select("path", fm.delete_key(F.col("content"), "lang").alias("r")).select("path", F.md5("r.content").alias("content_md5"))


def q_frontmatter_value(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", text.value_json(F.concat(F.lit("["), "lang", F.lit(" , "), "source", F.lit("]"))).alias("list_json"), text.value_json(F.col("n_chars").cast("string")).alias("number_json"), text.value_json((F.col("n_chars") > 500).cast("string")).alias("bool_json"))


def q_unescape_content(spark, sf_dir):
    """Escape every newline, then undo it."""
    escaped = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return documents(spark, sf_dir).select("doc_id", F.md5(text.unescape(escaped)).alias("text_md5"))


_PATHS = "CASE doc_id % 5 WHEN 0 THEN source || '/' || lang WHEN 1 THEN '../' || source WHEN 2 THEN source || '/../..' WHEN 3 THEN '/' || source ELSE './' || source || '/../' || lang END"


def q_validate_paths(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.expr(_PATHS).alias("path"))
    return d.select("doc_id", "path", paths.stays_inside(F.col("path")).alias("inside"))


VALIDATE = f"""
SELECT doc_id, path, NOT starts_with(path, '/') AND list_min([list_sum([CASE x WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END FOR x IN s[:i]]) FOR i IN range(1, len(s) + 1)]) >= 0 AS inside
FROM (SELECT doc_id, path, string_split(path, '/') AS s FROM (SELECT doc_id, {_PATHS} AS path FROM documents))
"""


def q_uri_construct(spark, sf_dir):
    u = text.uri("notes://open", vault=F.concat("source", F.lit(" a+b&c")), file=F.col("path"), silent=False, heading="")
    return notes(spark, sf_dir).withColumn("source", F.substring_index("path", "/", 1)).select("path", u.alias("uri"))


def q_fuzzy_topk(spark, sf_dir):
    return search.fuzzy_search(notes(spark, sf_dir), "sen7", 10).select("path", F.col("score").cast("long").alias("score"))


FUZZY = f"""{_WITH} SELECT path, CAST(levenshtein(lower(string_split(path, '/')[-1]), 'sen7') AS BIGINT) AS score FROM notes
WHERE regexp_matches(lower(path), 's.*e.*n.*7') ORDER BY score, length(path), string_split(path, '/') LIMIT 10"""


def q_page_href_links(spark, sf_dir):
    on_workers(spark)
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href")).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "href")


def _sized(spark, sf_dir):
    """Notes of sizes below, at and above the bound of search and backlinks."""
    return notes(spark, sf_dir).withColumn("size", (F.lit(SEARCH_CAP - 1) + F.col("mtime_ns") % 3).cast("long"))


def q_search_size_cap(spark, sf_dir):
    """At the bound and above, only the path is searched."""
    return search.search_notes(_sized(spark, sf_dir), "src").select("file_path", F.col("line_number").cast("long").alias("line_number"), F.md5("match_line").alias("match_md5"))


SEARCH_CAPPED = f"""{_WITH}, hit AS (
  SELECT path, line_number, trim(line) AS m FROM ({_LINES}) WHERE mtime_ns % 3 = 0 AND contains(lower(line), 'src'))
SELECT path AS file_path, CAST(line_number AS BIGINT) AS line_number,
  md5(CASE WHEN strlen(m) <= 80 THEN m ELSE (SELECT CASE WHEN s > 0 THEN '...' ELSE '' END || substr(m, s + 1, e - s - CASE WHEN s > 0 AND e < strlen(m) THEN 3 ELSE 0 END) || CASE WHEN e < strlen(m) THEN '...' ELSE '' END
    FROM (SELECT greatest(p - 20, 0) AS s, least(p + 23, strlen(m)) AS e FROM (SELECT strlen(split_part(lower(m), 'src', 1)) AS p))) END) AS match_md5 FROM hit
UNION ALL SELECT path, 0, md5('(filename match: ' || string_split(path, '/')[-1] || ')') FROM notes WHERE path NOT IN (SELECT path FROM hit) AND contains(lower(path), 'src')
"""


def q_backlinks_size_cap(spark, sf_dir):
    """Above the bound no links are looked for."""
    found = links.all_backlinks(_sized(spark, sf_dir))
    return found.select("target_path", "file_path", F.col("line_number").cast("long").alias("line_number"))


def q_backlinks_too_large(spark, sf_dir):
    return links.too_large(_sized(spark, sf_dir))


def q_backlinks_ranked(spark, sf_dir):
    """Each note's three newest backlinks, in order."""
    found = links.ranked_backlinks(notes(spark, sf_dir), 3)
    return found.select("target_path", F.col("rank").cast("long").alias("rank"), "file_path", F.col("line_number").cast("long").alias("line_number"))


def q_list_notes_in_folders(spark, sf_dir):
    """The walk order, as each note's place among those of its first folder."""
    w = Window.partitionBy("folder").orderBy(paths.walk_key(F.col("path")))
    own = resolve.list_notes(notes(spark, sf_dir)).withColumn("folder", F.substring_index("path", "/", 1))
    return own.select("path", F.row_number().over(w).cast("long").alias("place"))


def q_frontmatter_print(spark, sf_dir):
    return notes(spark, sf_dir).select("path", fm.printed(F.col("content")).alias("r")).select("path", F.col("r.text").alias("header"))


def _registry(spark, sf_dir):
    """Registries of vaults, one vault for each nation and one file for each region, written and read by a scan."""
    on_workers(spark)
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", F.col("n_nationkey").cast("string").alias("k"), F.struct(F.concat(F.lit("/vaults/"), "n_name").alias("path")).alias("v"))
    files = own.groupBy("n_regionkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("vaults"))).alias("value"))
    path = f"{shared_dir(spark)}/registries"
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return registry.read_registry(spark, path)


def q_vault_registry(spark, sf_dir):
    return _registry(spark, sf_dir)


def q_vault_lookup(spark, sf_dir):
    return registry.find_vault(_registry(spark, sf_dir), "7")


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")} | linking.QUERIES | vaults.QUERIES

SQL = linking.SQL | vaults.SQL | {
    "search_content": SEARCH_CONTENT,
    "search_snippet": SEARCH_SNIPPET,
    "search_filename_fallback": SEARCH_FALLBACK,
    "search_display": SEARCH_DISPLAY,
    "list_notes": f"{_WITH} SELECT path FROM notes",
    "read_note": f"{_WITH} SELECT path, md5(content) AS content_md5 FROM notes WHERE path = {_TARGET_SQL} || '.md'",
    "resolve_note": RESOLVE,
    "backlinks_one": BACKLINKS_ONE,
    "mentions_section": MENTIONS,
    "backlinks_all": BACKLINKS_ALL,
    "link_indegree": f"{_WITH}, {_EDGES} SELECT target_path AS path, count(*) AS n_lines, count(DISTINCT file_path) AS n_notes FROM pairs GROUP BY target_path",
    "link_outdegree": f"{_WITH}, {_EDGES} SELECT src_path AS path, count(*) AS n_links, count(DISTINCT kind || ' ' || target) AS n_targets FROM e GROUP BY src_path",
    "orphan_notes": f"{_WITH}, {_EDGES} SELECT path FROM notes WHERE path NOT IN (SELECT target_path FROM pairs)",
    "dangling_links": f"{_WITH}, {_EDGES} SELECT src_path, CAST(line_number AS BIGINT) AS line_number, kind, target FROM e WHERE src_path <> {_TARGET_SQL} || '.md' AND (kind, target) NOT IN (SELECT (kind, target) FROM names WHERE path <> {_TARGET_SQL} || '.md')",
    "backlink_patterns": PATTERNS,
    "rewrite_links_changed": REWRITE,
    "move_note_plan": MOVE_PLAN,
    "move_note": MOVED,
    "delete_note_plan": f"{_WITH} SELECT path FROM notes WHERE path <> {_TARGET_SQL} || '.md'",
    "overwrite_note": f"{_WITH} SELECT path, md5(CASE WHEN path = {_TARGET_SQL} || '.md' THEN 'new text' || chr(10) ELSE content END) AS content_md5 FROM notes",
    "upsert_append": UPSERT.format("coalesce(n.content, '') || coalesce(c.content, '')"),
    "upsert_overwrite": UPSERT.format("coalesce(c.content, n.content)"),
    "upsert_new": UPSERT_NEW,
    "has_frontmatter": f"{_WITH} SELECT path, trim(string_split(content, chr(10))[1]) = '---' AS has_header FROM notes",
    "frontmatter_keys": f"{_WITH} SELECT path, array_to_string(list_sort(regexp_extract_all(regexp_extract(content, '^---\\n((?:[a-z]+: [^\\n]*\\n)*)---', 1), '(?m)^([a-z]+): ', 1)), ',') AS keys FROM notes",
    "frontmatter_values": f"{_WITH} SELECT path, {_TITLE} AS title, {_LANG} AS lang, md5({_BODY_SQL}) AS body_md5 FROM notes",
    "frontmatter_set": f"{_WITH} SELECT path, md5('---' || chr(10) || 'lang: ' || {_LANG} || chr(10) || 'status:' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || 'title: ' || {_TITLE} || chr(10) || '---' || chr(10) || {_BODY_SQL}) AS content_md5 FROM notes",
    "frontmatter_delete": f"{_WITH} SELECT path, md5('---' || chr(10) || 'title: ' || {_TITLE} || chr(10) || '---' || chr(10) || {_BODY_SQL}) AS content_md5 FROM notes",
    "frontmatter_value": """SELECT doc_id, '["' || lang || '","' || source || '"]' AS list_json, '"' || n_chars || '"' AS number_json, CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END AS bool_json FROM documents""",
    "unescape_content": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "validate_paths": VALIDATE,
    "uri_construct": f"{_WITH} SELECT path, 'notes://open?vault=' || string_split(path, '/')[1] || '%20a+b&c&file=' || replace(path, '/', '%2F') AS uri FROM notes",
    "fuzzy_topk": FUZZY,
    "search_size_cap": SEARCH_CAPPED,
    "backlinks_size_cap": f"{_WITH}, {_EDGES} SELECT target_path, file_path, CAST(line_number AS BIGINT) AS line_number FROM pairs WHERE file_path IN (SELECT path FROM notes WHERE mtime_ns % 3 < 2)",
    "backlinks_too_large": f"{_WITH} SELECT path, CAST({SEARCH_CAP} + 1 AS BIGINT) AS size FROM notes WHERE mtime_ns % 3 = 2",
    "backlinks_ranked": f"""{_WITH}, {_EDGES}, r AS (
  SELECT target_path, file_path, line_number, row_number() OVER (PARTITION BY target_path ORDER BY mtime_ns DESC, string_split(file_path, '/'), line_number) AS rank FROM pairs JOIN notes ON path = file_path)
SELECT target_path, rank, file_path, CAST(line_number AS BIGINT) AS line_number FROM r WHERE rank <= 3""",
    "list_notes_in_folders": f"{_WITH} SELECT path, row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY string_split(path, '/')) AS place FROM notes",
    "frontmatter_print": f"{_WITH} SELECT path, 'lang: ' || {_LANG} || chr(10) || 'title: ' || {_TITLE} || chr(10) AS header FROM notes",
    "vault_registry": "SELECT CAST(n_nationkey AS VARCHAR) AS id, '/vaults/' || n_name AS path FROM nation",
    "vault_lookup": "SELECT min('/vaults/' || n_name) AS path FROM nation WHERE n_name LIKE '%7' HAVING count(*) > 0",
    "page_href_links": """SELECT page_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS pos, unnest(a) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages)""",
}
