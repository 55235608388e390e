"""Content search with line numbers and snippets, file-name fallback, display and fuzzy lookup.

No Python and no shuffle: a note's hits are found inside its row, after a check of the whole
content that drops most notes before any line is split; the fallback looks at the same row
instead of joining back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, is_note, walk_key
from ..functions.text import contains_ci, let, lines, trim_ws
from ..model import SEARCH_CAP
from ..scratch import written

LONG, AROUND, DOTS = 80, 20, "..."


def snippet(line: Column, query: str, as_bytes: bool = False) -> Column:
    """The trimmed line, or what stands around the first hit of a long one.

    Lengths are in bytes, so a cut may split a character: ``as_bytes`` gives the exact bytes;
    otherwise broken characters at a cut are left out. The three dots in front count as
    context when both ends are cut.
    """
    q = query.lower()
    dots, none = F.encode(F.lit(DOTS), "UTF-8"), F.encode(F.lit(""), "UTF-8")

    def around(m: Column, at: Column) -> Column:
        """What is left of a long line ``m`` with a hit at byte ``at`` (-1: no hit)."""
        b, size = F.encode(m, "UTF-8"), F.octet_length(m)
        start = F.when(at < 0, 0).otherwise(F.greatest(at - AROUND, F.lit(0)))
        end = F.when(at < 0, LONG).otherwise(F.least(at + len(query.encode()) + AROUND, size))
        front, back = start > 0, end < size
        n = end - start - F.when(front & back, len(DOTS)).otherwise(0)
        cut = F.substring(b, start + F.lit(1), n)
        if as_bytes:
            return F.concat(F.when(front, dots).otherwise(none), cut, F.when(back, dots).otherwise(none))
        whole = F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "^\ufffd+|\ufffd+$", "")
        return F.concat(F.when(front, DOTS).otherwise(""), whole, F.when(back, DOTS).otherwise(""))

    def shortened(m: Column) -> Column:
        low = F.lower(m)
        at = F.when(F.contains(low, F.lit(q)), F.octet_length(F.substring_index(low, q, 1)) if q else F.lit(0)).otherwise(-1)
        return F.when(F.octet_length(m) <= LONG, F.encode(m, "UTF-8") if as_bytes else m).otherwise(let(at, lambda p: around(m, p)))

    return let(trim_ws(line), shortened)


def search_lines(notes: DataFrame, query: str) -> DataFrame:
    """Every line with the query: the input's columns but content, line_number, line."""
    keep = [c for c in notes.columns if c != "content"]
    hit = notes.where(contains_ci(F.col("content"), query))  # a line's hit is the content's hit
    out = hit.select(*keep, F.posexplode(lines(F.col("content"))).alias("__pos", "line"))
    return out.where(contains_ci(F.col("line"), query)).select(*keep, (F.col("__pos") + 1).alias("line_number"), "line")


def search_notes(notes: DataFrame, query: str, as_bytes: bool = False) -> DataFrame:
    """Matches (file_path, line_number, match_line) in walk order: the hits of each note's
    lines, or one row with line 0 for a note whose path alone has the query."""
    found, named = contains_ci(F.col("content"), query) & (F.col("size") < SEARCH_CAP), contains_ci(F.col("path"), query)
    notes = notes.where(is_note(F.col("path"))).where(found | named)
    own = F.when(found, lines(F.col("content"))).otherwise(F.array().cast("array<string>"))
    hits = F.filter(F.transform(own, lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line"))), lambda h: contains_ci(h["line"], query))
    note = F.concat(F.lit("(filename match: "), basename(F.col("path")), F.lit(")"))
    name = F.array(F.struct(F.lit(0).alias("line_number"), note.alias("line")))
    rows = notes.select("path", F.inline(F.when(F.size(hits) > 0, hits).when(named, name)))
    text = snippet(F.col("line"), query, as_bytes)
    whole = F.encode("line", "UTF-8") if as_bytes else F.col("line")
    rows = rows.select(F.col("path").alias("file_path"), "line_number", F.when(F.col("line_number") == 0, whole).otherwise(text).alias("match_line"))
    return rows.orderBy(walk_key(F.col("file_path")), "line_number")


def place(path: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat_ws(":", path, line.cast("string"))).otherwise(path)


def display(matches: DataFrame) -> DataFrame:
    """Matches with ``display``: the place, padded to the longest one (in bytes), and the text. The width is known
    only after all matches, so they are written once and not searched for twice."""
    at = written(matches.withColumn("__place", place(F.col("file_path"), F.col("line_number"))), "matches")
    width = at.agg(F.max(F.octet_length("__place"))).scalar()
    shown = at.withColumn("__width", width)
    text = F.concat(F.when(F.col("__width") > F.char_length("__place"), F.rpad("__place", F.col("__width"), F.lit(" "))).otherwise(F.col("__place")), F.lit(" | "), F.col("match_line"))
    return shown.select(*matches.columns, text.alias("display"))


def fuzzy_search(notes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` paths that hold the query's characters in order, case-folded, best first:
    the fewest edits from the base name, then the shortest path, then walk order."""
    # each character is looked for once, from where the one before it stood: no way back
    pattern = r"\A" + "".join(rf"[^\x{{{ord(ch):x}}}]*+\x{{{ord(ch):x}}}" for ch in query.lower())
    hit = notes.where(is_note(F.col("path"))).where(F.regexp_like(F.lower("path"), F.lit(pattern)))
    score = F.levenshtein(F.lower(basename(F.col("path"))), F.lit(query.lower()))
    return hit.select("path", score.alias("score")).orderBy("score", F.char_length("path"), walk_key(F.col("path"))).limit(k)


#: Fixed values of the alignment score: a matched character, one at the start of a word, one that follows
#: the one before it at once, opening a gap between two matched characters, and each character of a gap.
MATCH, START, RUN, GAP, SKIP = 16, 8, 4, 3, 1


def alignment_score(path: Column, query: str) -> Column:
    """The best score of placing the query's characters, in order, on the path's, both case-folded; null if they do
    not fit. What is skipped before the first and after the last character is free.

    One fold over the path's characters: for each prefix of the query, the best score with its last character
    matched just here (``hit``) and with it matched earlier, the gap since then paid for (``past``)."""
    q = list(query.lower())
    if not q:
        return F.lit(0)
    low = F.lit(None).cast("int")
    empty = F.array(*[low] * len(q))

    def step(acc: Column, c: Column) -> Column:
        old = lambda name, j: F.get(acc[name], F.lit(j))
        start = F.when(acc["last"].isNull() | ~F.rlike(acc["last"], F.lit(r"[\p{L}\p{N}]")), START).otherwise(0)
        hit = []
        for j, ch in enumerate(q):
            if j == 0:
                best = F.lit(MATCH) + start
            else:
                best = F.greatest(old("hit", j - 1) + RUN, old("past", j - 1)) + MATCH + start
            hit.append(F.when(c == ch, best))
        past = [F.greatest(old("hit", j) - GAP - SKIP, old("past", j) - SKIP) for j in range(len(q))]
        best = F.greatest(acc["best"], hit[-1])
        return F.struct(F.array(*hit).alias("hit"), F.array(*past).alias("past"), best.alias("best"), c.alias("last"))

    none = F.struct(empty.alias("hit"), empty.alias("past"), low.alias("best"), F.lit(None).cast("string").alias("last"))
    return F.aggregate(F.split(F.lower(path), ""), none, step, lambda a: a["best"])


def fuzzy_ranked(notes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` paths on which the query is best placed: (path, score), the highest score first, then the shortest
    path, then walk order. An empty query is on every path, with score 0."""
    hit = notes.where(is_note(F.col("path"))).select("path", alignment_score(F.col("path"), query).alias("score")).where("score is not null")
    return hit.orderBy(F.desc("score"), F.char_length("path"), walk_key(F.col("path"))).limit(k)
