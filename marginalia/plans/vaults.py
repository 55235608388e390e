"""Queries over real files: notes derived from ``documents`` are written to a vault folder by tasks, then
listed, read, searched, changed as a transaction and read back. The folder lies in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..model import BACKLINK_CAP, NOTES_SQL, SEARCH_CAP, text_notes
from ..operators import links, moves, search
from ..scratch import mounted_dir
from ..sources import listing, sink
from .linking import _MOVED_SQL, _moves, notes

_WITH = f"WITH {NOTES_SQL}"
#: Every so many-th note is made as large as the bounds of search and backlinks, one byte less, or one more.
EVERY, TERM = 400, "the"


def vault_of(content: DataFrame) -> str:
    """A new vault folder with these notes (path, content)."""
    spark = content.sparkSession
    root = mounted_dir(spark)
    os.makedirs(root)
    sink.write_back(content.select("path", "content"), root)
    return root


def old_of(root: str) -> str:
    """Where the files go that a query replaces in its vault: beside it, to be deleted with it."""
    return f"{root}.old"


def q_vault_read_back(spark, sf_dir):
    """Files written, listed in rounds, read in bins of equal bytes."""
    root = vault_of(notes(spark, sf_dir))
    return listing.vault_notes(spark, root).select("path", "size", F.md5("content").alias("content_md5"))


def q_vault_moved_back(spark, sf_dir):
    """Swaps and moves of most notes as one transaction on files, read back."""
    root = vault_of(notes(spark, sf_dir))
    files = listing.list_vault(spark, root)
    new = moves.changes(files, _moves(spark, sf_dir), lambda f: listing.with_content(f, root))
    sink.write_back(new, root, old_of(root))
    return listing.vault_notes(spark, root).select("path", F.md5("content").alias("content_md5"))


def _raw(spark, sf_dir) -> DataFrame:
    """Notes whose bodies are no UTF-8 and hold bytes of zero."""
    tail = F.lit(bytearray(b"caf\xe9 \x00\xff tail"))
    return notes(spark, sf_dir).select("path", F.concat(F.col("content").cast("binary"), tail).alias("content"))


_RAW_SQL = "raw AS (SELECT path, content, '\\x63\\x61\\x66\\xE9\\x20\\x00\\xFF\\x20\\x74\\x61\\x69\\x6C'::BLOB AS tail FROM notes)"
_BODY = "regexp_replace(content, '^---\\ntitle: [^\\n]*\\nlang: [^\\n]*\\n---\\n', '')"
_TITLE, _LANG = (f"regexp_extract(content, '^---\\n(?:[^\\n]*\\n)??{k}: ([^\\n]*)', 1)" for k in ("title", "lang"))


def q_vault_headers_set(spark, sf_dir):
    """A key set in the header of every file, the other bytes as they were."""
    root = vault_of(_raw(spark, sf_dir))
    own = listing.vault_notes(spark, root)
    new = own.select("path", fm.set_key_bytes(F.col("content"), "status", "draft").alias("r"), "mode").select("path", "r.content", "mode")
    sink.write_back(new, root, old_of(root))
    return listing.vault_notes(spark, root).select("path", F.md5("content").alias("content_md5"))


def q_vault_headers_deleted(spark, sf_dir):
    """A key deleted from the header of every file, the other bytes as they were."""
    root = vault_of(_raw(spark, sf_dir))
    own = listing.vault_notes(spark, root)
    new = own.select("path", fm.delete_key_bytes(F.col("content"), "lang").alias("r"), "mode").select("path", "r.content", "mode")
    sink.write_back(new, root, old_of(root))
    return listing.vault_notes(spark, root).select("path", F.md5("content").alias("content_md5"))


def _sized(spark, sf_dir) -> str:
    """A vault in which some files really have the sizes around the bound."""
    own = notes(spark, sf_dir).withColumn("id", F.regexp_extract("path", r"doc_(\d+)\.md", 1).cast("long"))
    to = F.lit(SEARCH_CAP - 1) + (F.col("id") / EVERY).cast("long") % 3
    pad = F.when(F.col("id") % EVERY == 0, F.concat(F.lit("\n"), F.repeat(F.lit("x"), (to - F.col("size") - 1).cast("int")))).otherwise("")
    return vault_of(own.select("path", F.concat("content", pad).alias("content")))


def q_vault_search_sizes(spark, sf_dir):
    """Contents below the bound are searched, of larger files only the path."""
    root = _sized(spark, sf_dir)
    found = search.search_notes(text_notes(listing.vault_notes(spark, root, largest=SEARCH_CAP - 1)), TERM)
    return found.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"), F.sum("line_number").cast("long").alias("lines"))


def q_vault_backlinks_sizes(spark, sf_dir):
    """Links are looked for in contents up to and at the bound, and not above."""
    root = _sized(spark, sf_dir)
    files = listing.list_vault(spark, root)
    found = links.all_backlinks(text_notes(listing.with_content(files, root, BACKLINK_CAP)), files)
    return found.select("target_path", "file_path", F.col("line_number").cast("long").alias("line_number"))


def q_vault_too_large(spark, sf_dir):
    """The files that backlinks leave out, from the listing alone."""
    return links.too_large(listing.list_vault(spark, _sized(spark, sf_dir)))


_SIZE = f"s AS (SELECT path, doc_id % {EVERY} = 0 AS made, {SEARCH_CAP - 1} + doc_id // {EVERY} % 3 AS size FROM base JOIN notes ON path = stem || '.md')"
_LINES = "SELECT path, generate_subscripts(a, 1) AS line_number, unnest(a) AS line FROM (SELECT path, string_split(content, chr(10)) AS a FROM notes)"

QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}

SQL = {
    "vault_read_back": f"{_WITH} SELECT path, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS content_md5 FROM notes",
    "vault_moved_back": f"{_WITH}, {_MOVED_SQL} SELECT new_path AS path, md5(new_content) AS content_md5 FROM moved",
    "vault_headers_set": f"{_WITH}, {_RAW_SQL} SELECT path, md5(encode('---' || chr(10) || 'lang: ' || {_LANG} || chr(10) || 'status: draft' || chr(10) || 'title: ' || {_TITLE} || chr(10) || '---' || chr(10) || {_BODY}) || tail) AS content_md5 FROM raw",
    "vault_headers_deleted": f"{_WITH}, {_RAW_SQL} SELECT path, md5(encode('---' || chr(10) || 'title: ' || {_TITLE} || chr(10) || '---' || chr(10) || {_BODY}) || tail) AS content_md5 FROM raw",
    "vault_search_sizes": f"""{_WITH}, {_SIZE},
hit AS (SELECT path, line_number FROM ({_LINES}) JOIN s USING (path) WHERE contains(lower(line), '{TERM}') AND NOT (made AND size >= {SEARCH_CAP}))
SELECT path, count(*) AS n, CAST(sum(line_number) AS BIGINT) AS lines FROM (SELECT * FROM hit UNION ALL SELECT path, 0 FROM notes WHERE contains(lower(path), '{TERM}') AND path NOT IN (SELECT path FROM hit)) GROUP BY path""",
    "vault_backlinks_sizes": f"""{_WITH}, {_SIZE},
e AS (SELECT DISTINCT path, line_number, kind, target FROM (
  SELECT path, line_number, 'wiki' AS kind, unnest(regexp_extract_all(line, '\\[\\[(doc_[0-9]+)(?:\\]\\]|\\|)', 1)) AS target FROM ({_LINES})
  UNION ALL SELECT path, line_number, 'md', unnest(regexp_extract_all(line, '\\]\\(([^)]*)\\.md\\)', 1)) FROM ({_LINES})))
SELECT DISTINCT n.path AS target_path, e.path AS file_path, CAST(line_number AS BIGINT) AS line_number
FROM e JOIN s ON s.path = e.path JOIN notes n ON n.path = CASE kind WHEN 'md' THEN target || '.md' ELSE n.path END AND (kind = 'md' OR string_split(n.path, '/')[-1] = target || '.md')
WHERE n.path <> e.path AND NOT (made AND size > {BACKLINK_CAP})""",
    "vault_too_large": f"{_WITH}, {_SIZE} SELECT path, CAST(size AS BIGINT) AS size FROM s WHERE made AND size > {BACKLINK_CAP}",
}
