"""Links between notes: patterns, edges, backlinks (one target, or all), mentions, rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import add_md, basename, is_note, is_rewritable, remove_md, slashes, walk_key, with_md, without_md
from ..functions.text import lines, trim_ws
from ..model import BACKLINK_CAP


def wiki(name: str) -> list[str]:
    """The three ways in which a wikilink to a name may begin."""
    return [f"[[{name}]]", f"[[{name}|", f"[[{name}#"]


def shapes(note: str) -> list[str]:
    """All texts that link to a note: wikilinks by base name, and by path where that differs;
    Markdown links by path only, with or without ``.md`` and ``./``."""
    path = note.replace("\\", "/")
    stem, base = without_md(path), without_md(path.rsplit("/", 1)[-1])
    file = with_md(path)
    own = wiki(base) + (wiki(stem) if stem != base else [])
    return own + [f"]({file})", f"]({stem})", f"](./{file})", f"](./{stem})"]


def replacements(old: str, new: str) -> dict[str, str]:
    """Each link text of the old note to the same of the new one, in a fixed order."""
    a, b = (x.replace("\\", "/") for x in (old, new))
    stems, bases = [without_md(x) for x in (a, b)], [without_md(x.rsplit("/", 1)[-1]) for x in (a, b)]
    out = dict(zip(wiki(bases[0]), wiki(bases[1])))
    if stems[0] != bases[0]:
        out |= dict(zip(wiki(stems[0]), wiki(stems[1])))
    files = [with_md(x) for x in (a, b)]
    for lead in ("](", "](./"):
        out |= {f"{lead}{files[0]})": f"{lead}{files[1]})", f"{lead}{stems[0]})": f"{lead}{stems[1]})"}
    return out


def base_name(note: str) -> str:
    """A note's base name. Every text that links to the note holds it, so one test for it
    drops most notes before anything dearer is done."""
    return without_md(note.replace("\\", "/").rsplit("/", 1)[-1])


def any_of(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(c, F.lit(p)) for p in patterns])


def backlinks(notes: DataFrame, note: str) -> DataFrame:
    """Lines of other notes that link to ``note``: (file_path, line_number, match_line, mtime_ns),
    newest note first. A line counts once. The whole content is tested before it is split.

    The note itself is left out by the name as given: a bare base name of a note in a folder
    does not match its path, so that note's own lines stay.
    """
    name = without_md(note)
    patterns = [p.lower() for p in shapes(name)]
    own = notes.where(is_note(F.col("path")) & (F.col("size") <= BACKLINK_CAP) & (remove_md(slashes(F.col("path"))) != name))
    base = base_name(name).lower()
    hit = own.where(F.contains(F.lower("content"), F.lit(base)))
    rows = hit.select("path", "mtime_ns", F.posexplode(lines(F.col("content"))).alias("__pos", "__line"))
    rows = rows.where(F.contains(F.lower("__line"), F.lit(base)) & any_of(F.lower("__line"), patterns))
    out = rows.select(F.col("path").alias("file_path"), (F.col("__pos") + 1).alias("line_number"), trim_ws(F.col("__line")).alias("match_line"), "mtime_ns")
    return newest_first(out)


def too_large(notes: DataFrame) -> DataFrame:
    """The notes (path, size) that are left out of backlinks because of their size."""
    return notes.where(is_note(F.col("path")) & (F.col("size") > BACKLINK_CAP)).select("path", "size")


def newest_first(matches: DataFrame) -> DataFrame:
    """By modification time, newest first; ties in walk order, then by line."""
    return matches.orderBy(F.desc("mtime_ns"), walk_key(F.col("file_path")), "line_number")


#: A wikilink's target; what a Markdown link points at (of nested brackets, the innermost ``](``).
WIKI, MARKDOWN = r"\[\[([^\]|#\[]+)(?:\]\]|\||#)", r"\]\((?:\./)?([^)]*)\)"


def edges(notes: DataFrame) -> DataFrame:
    """All links: (src_path, mtime_ns, line_number, line, kind, target), targets lower-cased
    and Markdown targets without one ``.md``."""
    own = notes.where(is_note(F.col("path")) & (F.col("size") <= BACKLINK_CAP))
    own = own.where(F.contains("content", F.lit("[[")) | F.contains("content", F.lit("](")))
    rows = own.select(F.col("path").alias("src_path"), "mtime_ns", F.posexplode(lines(F.col("content"))).alias("__pos", "line"))
    rows = rows.where(F.contains("line", F.lit("[[")) | F.contains("line", F.lit("](")))
    found = lambda pattern, kind, clean: F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), lambda t: F.struct(F.lit(kind).alias("kind"), clean(F.lower(t)).alias("target")))
    both = F.concat(found(WIKI, "wiki", lambda t: t), found(MARKDOWN, "md", remove_md))
    return rows.select("src_path", "mtime_ns", (F.col("__pos") + 1).alias("line_number"), "line", F.inline(F.array_distinct(both)))


def names(notes: DataFrame) -> DataFrame:
    """What each note is linked by: (path, kind, target)."""
    stem = F.lower(remove_md(F.col("path")))
    base = F.lower(remove_md(basename(F.col("path"))))
    keys = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("target")) for k, t in (("wiki", base), ("wiki", stem), ("md", stem))]))
    return notes.where(is_note(F.col("path"))).select("path", F.inline(keys))


#: Characters that let one link text hold another's end; names with them are matched by length.
ODD = r"[\[\]|#()]"
_ENDS = {"wiki": r"(?:\]\]|\||#)", "md": r"\)"}
_LEAD = {"wiki": r"\[\[", "md": r"\]\((?:\./)?"}


def link_keys(notes: DataFrame) -> DataFrame:
    """What stands in the links to each note: (path, kind, key), lower-cased; the column form of :func:`shapes`."""
    name = slashes(remove_md(F.col("path")))
    stem, base, file = F.lower(remove_md(name)), F.lower(remove_md(basename(name))), F.lower(add_md(name))
    keys = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("key")) for k, t in (("wiki", base), ("wiki", stem), ("md", file), ("md", stem))]))
    return notes.where(is_note(F.col("path"))).select("path", F.inline(keys))


def link_lines(notes: DataFrame, lengths: dict[str, Column]) -> DataFrame:
    """Lines with links: (src_path, mtime_ns, line_number, line, kind, key), a row per text that may be a key.

    A key without odd characters ends at the first odd one. One with odd characters may end at any: it is cut out by
    its length, after every opening, for each length (in characters) that such keys have; looking ahead
    consumes nothing, so links inside one another are all found."""
    own = notes.where(is_note(F.col("path")) & (F.col("size") <= BACKLINK_CAP))
    own = own.where(F.contains("content", F.lit("[[")) | F.contains("content", F.lit("](")))
    rows = own.select(F.col("path").alias("src_path"), "mtime_ns", F.posexplode(lines(F.col("content"))).alias("__pos", "line"))
    rows = rows.where(F.contains("line", F.lit("[[")) | F.contains("line", F.lit("](")))
    rows = rows.withColumn("__low", F.lower("line")).select("*", *[c.alias(f"__{k}") for k, c in lengths.items()])

    def texts(kind: str) -> Column:
        inner = ODD.replace("[", "[^", 1)
        short = F.regexp_extract_all("__low", F.lit(f"{_LEAD[kind]}({inner}*)(?={_ENDS[kind]})"), 1)
        cut = lambda n: F.regexp_extract_all("__low", F.concat(F.lit(f"(?s)(?={_LEAD[kind]}(.{{"), n.cast("string"), F.lit(f"}}){_ENDS[kind]})")), F.lit(1))
        long = F.filter(F.flatten(F.transform(f"__{kind}", cut)), lambda t: F.rlike(t, F.lit(ODD)))
        return F.transform(F.array_union(short, F.coalesce(long, F.array().cast("array<string>"))), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("key")))

    return rows.select("src_path", "mtime_ns", (F.col("__pos") + 1).alias("line_number"), "line", F.inline(F.concat(texts("wiki"), texts("md"))))


def all_backlinks(notes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Backlinks of every note at once, whatever its name: (target_path, file_path, line_number, match_line,
    mtime_ns). The texts of links are cut out of the lines and meet the notes' names in an equi-join,
    instead of testing each pattern on each line; only the lengths of odd names go to all tasks. The names are looked at
    three times: ``named`` gives their paths where ``notes`` would open every file each time."""
    keys = link_keys(notes if named is None else named)
    odd = keys.where(F.col("key").rlike(ODD))
    length = lambda kind: odd.where(F.col("kind") == kind).agg(F.collect_set(F.char_length("key")))
    found = link_lines(notes, {kind: length(kind).scalar() for kind in ("wiki", "md")})
    both = found.join(keys, ["kind", "key"]).where(remove_md(slashes(F.col("src_path"))) != remove_md(F.col("path")))
    once = both.select(F.col("path").alias("target_path"), F.col("src_path").alias("file_path"), "line_number", "line", "mtime_ns").distinct()
    return once.select("target_path", "file_path", "line_number", trim_ws(F.col("line")).alias("match_line"), "mtime_ns")


def mentions(matches: DataFrame) -> DataFrame:
    """One row, ``section``: the matches by note, notes in order of their newest match. Empty
    input gives no row. The rows of one target's backlinks are what is gathered."""
    per = matches.groupBy("file_path", "mtime_ns").agg(F.array_sort(F.collect_list(F.struct("line_number", "match_line"))).alias("__rows"))
    block = F.concat(
        F.lit("\n**[["), remove_md(F.col("file_path")), F.lit("]]**\n"),
        F.array_join(F.transform("__rows", lambda r: F.concat(F.lit("- "), r["match_line"], F.lit("\n"))), ""),
    )
    blocks = F.array_sort(F.collect_list(F.struct((-F.col("mtime_ns")).alias("t"), walk_key(F.col("file_path")).alias("k"), block.alias("b"))))
    all_ = per.agg(blocks.alias("__all")).where(F.size("__all") > 0)
    return all_.select(F.concat(F.lit("\n\n## Linked Mentions\n"), F.array_join(F.transform("__all", lambda r: r["b"]), "")).alias("section"))


def replace_all(content: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        content = F.replace(content, F.lit(old), F.lit(new))
    return content


def rewritten(notes: DataFrame, old: str, new: str, strict: bool = False, unreadable: bool = False) -> DataFrame:
    """The notes whose content changes when links to ``old`` become links to ``new``, with
    the new content. Case-sensitive; hidden notes are left alone, notes in hidden folders not.

    Links by base name change for all notes of that name; ``strict`` (an extension) leaves those
    links alone where another note has the same base name, and changes links by path only; to know that, it
    runs a job while the plan is made. ``unreadable`` also keeps notes without content, for a caller that
    must not pass over them."""
    pairs = replacements(old, new)
    if strict:
        own = [with_md(x.replace("\\", "/")) for x in (old, new)]  # the note may have moved already
        same = notes.where(is_note(F.col("path")) & (basename(F.col("path")) == with_md(base_name(old))) & ~F.col("path").isin(own))
        if not same.isEmpty():
            pairs = {a: b for a, b in pairs.items() if a not in wiki(base_name(old))}
    lost = F.col("content").isNull() if unreadable else F.lit(False)
    own = notes.where(is_rewritable(F.col("path")) & (F.contains("content", F.lit(base_name(old))) | lost))
    out = own.withColumn("__new", replace_all(F.col("content"), pairs)).where(~F.col("__new").eqNullSafe(F.col("content")) | lost)
    return out.withColumn("content", F.col("__new")).drop("__new")


# --- extensions: the link graph ---------------------------------------------------------


def in_degree(notes: DataFrame) -> DataFrame:
    """Linking lines per note."""
    return all_backlinks(notes).groupBy(F.col("target_path").alias("path")).agg(F.count("*").alias("n_lines"), F.count_distinct("file_path").alias("n_notes"))


def out_degree(notes: DataFrame) -> DataFrame:
    """Links per note, and distinct targets."""
    return edges(notes).groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("n_links"), F.count_distinct("kind", "target").alias("n_targets"))


def dangling(notes: DataFrame) -> DataFrame:
    """Links whose target no note has."""
    e = edges(notes).select("src_path", "line_number", "kind", "target")
    return e.join(names(notes).select("kind", "target").distinct(), ["kind", "target"], "left_anti").select("src_path", "line_number", "kind", "target")


def orphans(notes: DataFrame) -> DataFrame:
    """Notes that no other note links to."""
    linked = all_backlinks(notes).select(F.col("target_path").alias("path")).distinct()
    return notes.where(is_note(F.col("path"))).select("path").join(linked, "path", "left_anti")


def ranked_backlinks(notes: DataFrame, k: int) -> DataFrame:
    """Each note's ``k`` newest backlinks: a limit per task comes before the shuffle."""
    w = Window.partitionBy("target_path").orderBy(F.desc("mtime_ns"), walk_key(F.col("file_path")), "line_number")
    return all_backlinks(notes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def link_shapes(path: Column) -> Column:
    """:func:`shapes` for a column of paths."""
    c = slashes(path)
    stem, base = remove_md(c), remove_md(basename(c))
    three = lambda x: [F.concat(F.lit("[["), x, F.lit(e)) for e in ("]]", "|", "#")]
    file = F.concat(stem, F.lit(".md"))
    four = [F.concat(F.lit(lead), x, F.lit(")")) for lead in ("](", "](./") for x in (file, stem)]
    return F.when(stem != base, F.array(*three(base), *three(stem), *four)).otherwise(F.array(*three(base), *four))
