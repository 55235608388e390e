"""Many moves at once: every link is rewritten by one table of moves, in one pass.

All link texts are replaced at the same time, the leftmost first and of those the longest, so chains (a to b, b
to c) and swaps (a to b, b to a) come out right, which replacing one move after the other cannot do. The
closing ``]]``, ``|``, ``#`` or ``)`` of a link is looked at and not consumed. With one move the result is that of
:func:`marginalia.operators.links.rewritten`. Of several moves that claim one link text (notes of one base
name) the one with the smallest old name counts.

Up to ``MOST`` link texts are broadcast and the notes are read once; of more, the links found in the notes meet the
texts in an equi-join. Contents are bytes throughout, so what is not UTF-8 stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import add_md, basename, is_rewritable, remove_md, slashes
from ..scratch import written
from ..session import on_workers

#: Link texts that are broadcast: at most about 40 MB.
MOST = 200_000
#: Characters that let one link text hold another's end.
ODD = r"[\[\]|#()]"
_OPEN, _PLAIN = re.compile(rb"(?=\[\[|\]\()"), re.compile(rb"[^\[\]|#()]*")
_ENDS = {"wiki": (b"]]", b"|", b"#"), "md": (b")",)}


def link_texts(moves: DataFrame) -> DataFrame:
    """``moves`` (old, new) as (kind, key, new): what stands in a link to the old note, and what in one
    to the new; one row for each (kind, key)."""
    stem = lambda c: remove_md(slashes(c))
    base = lambda c: remove_md(basename(slashes(c)))
    file = lambda c: add_md(slashes(c))
    old, new = F.col("old"), F.col("new")
    pair = lambda kind, f, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("kind"), f(old).alias("key"), f(new).alias("new")))
    pairs = F.array(pair("wiki", base), pair("wiki", stem, stem(old) != base(old)), pair("md", file), pair("md", stem))
    rows = moves.where("old is not null and new is not null").select(F.struct(stem(old), new).alias("move"), F.inline(F.array_compact(pairs)))
    return rows.groupBy("kind", "key").agg(F.min_by("new", "move").alias("new"))


def found(content: bytes, lengths: dict[str, list[int]]):
    """Where a link text may stand: (start of the text, kind, its possible lengths, the longest first)."""
    for m in _OPEN.finditer(content):
        x = m.start()
        kind = "wiki" if content[x] == 91 else "md"
        y = x + 2
        if kind == "md" and content[y : y + 2] == b"./":
            y += 2
        plain = _PLAIN.match(content, y).end() - y
        fits = [n for n in lengths.get(kind, ()) if content.startswith(_ENDS[kind], y + n)]
        if plain not in fits and content.startswith(_ENDS[kind], y + plain):
            fits = sorted((*fits, plain), reverse=True)
        if fits:
            yield y, kind, fits


def replaced(content: bytes, texts: dict[tuple[str, bytes], bytes], lengths: dict[str, list[int]]) -> bytes:
    """``content`` with all link texts replaced at once."""
    out, at = [], 0
    for y, kind, fits in found(content, lengths):
        if y - 2 < at:
            continue
        for n in fits:
            new = texts.get((kind, content[y : y + n]))
            if new is not None:
                out += (content[at:y], new)
                at = y + n
                break
    return b"".join((*out, content[at:])) if out else content


def odd_lengths(keys: DataFrame) -> dict[str, list[int]]:
    """The lengths in bytes of link texts with odd characters, by kind, the longest first: no more numbers
    than a path may have bytes."""
    rows = keys.where(F.col("key").rlike(ODD)).groupBy("kind").agg(F.collect_set(F.octet_length("key")).alias("n")).collect()
    return {r.kind: sorted(r.n, reverse=True) for r in rows}


def _broadcast_form(notes: DataFrame, texts: DataFrame, lengths: dict) -> DataFrame:
    known = notes.sparkSession.sparkContext.broadcast({(r.kind, r.key.encode()): r.new.encode() for r in texts.collect()})

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("content")
            new = [c and replaced(c, known.value, lengths) for c in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.binary())], names=[*b.schema.names, "__new"])

    return notes.mapInArrow(run, _with_new(notes))


def _join_form(notes: DataFrame, texts: DataFrame, lengths: dict, with_hits=None) -> DataFrame:
    """``with_hits`` gives the notes with the hits of each (path, __hits): by default a join, which shuffles contents."""

    def search(batches):
        for b in batches:
            rows = []
            for path, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(path, y, n, kind, c[y : y + n].decode("utf-8", "replace")) for y, kind, fits in found(c or b"", lengths) for n in fits]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "y", "n", "kind", "key"])

    def splice(batches):
        for b in batches:
            new = []
            for c, hits in zip(b.column(b.schema.get_field_index("content")).to_pylist(), b.column(b.schema.get_field_index("__hits")).to_pylist()):
                out, at = [], 0
                for h in hits or ():  # by place, the longest first
                    if h["y"] - 2 >= at:
                        out += (c[at : h["y"]], h["new"].encode())
                        at = h["y"] - h["m"]
                new.append(c and b"".join((*out, c[at:])))
            drop = b.schema.get_field_index("__hits")
            cols = [x for i, x in enumerate(b.columns) if i != drop]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(new, pa.binary())], names=[n for n in b.schema.names if n != "__hits"] + ["__new"])

    links = notes.select("path", "content").mapInArrow(search, "path string, y long, n long, kind string, key string")
    hits = links.join(texts, ["kind", "key"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("y", (-F.col("n")).alias("m"), "new"))).alias("__hits"))
    schema = _with_new(notes)  # a join by name puts its key first
    own = with_hits(hits) if with_hits else notes.join(hits, "path", "left")
    return own.select(*notes.columns, "__hits").mapInArrow(splice, schema)


def _with_new(notes: DataFrame) -> T.StructType:
    return T.StructType([*notes.schema.fields, T.StructField("__new", T.BinaryType())])


def _rewritten(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """``notes`` with ``content`` as bytes and ``__new``, the content after the moves."""
    on_workers(notes.sparkSession)
    texts = link_texts(moves)
    lengths, n = odd_lengths(texts), texts.count()
    own = notes.withColumn("content", F.col("content").cast("binary"))
    return (_broadcast_form if n <= MOST else _join_form)(own, texts, lengths)


def rewritten_all(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """The notes whose content changes when all ``moves`` (old, new) are made, with the new content.
    Hidden notes are left alone. The table of moves is read while the plan is made."""
    kind = notes.schema["content"].dataType
    own = notes.where(is_rewritable(F.col("path")) & (F.contains("content", F.lit("[[")) | F.contains("content", F.lit("]("))))
    out = _rewritten(own, moves).where(~F.col("__new").eqNullSafe(F.col("content")))
    return out.withColumn("content", F.col("__new").cast(kind)).select(*notes.columns)


def changes(files: DataFrame, moves: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``moves`` make of ``files`` (without contents), for a sink: (path, content, moved_from), a row for each file,
    without content where no link changes. ``read`` adds the contents to a table of files and keeps its other columns:
    links are spliced where contents are read, so no shuffle has contents, and the tasks that read also write."""
    on_workers(files.sparkSession)
    to = new_paths(files.withColumn("__from", F.col("path")), moves).withColumnRenamed("path", "__to").withColumnRenamed("__from", "path")
    to, texts = written(to.select(*files.columns, "__to"), "to"), written(link_texts(moves), "texts")
    lengths, own = odd_lengths(texts), read(to)
    if texts.count() <= MOST:
        out = _broadcast_form(own, texts, lengths)
    else:
        out = _join_form(own, texts, lengths, lambda hits: read(written(to.join(hits, "path", "left"), "hits")))
    new = F.when(is_rewritable(F.col("path")) & ~F.col("__new").eqNullSafe(F.col("content")), F.col("__new"))
    return out.select(F.col("__to").alias("path"), new.alias("content"), F.col("path").alias("moved_from"))


def new_paths(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """``notes`` under their paths after the moves; of several moves of one note the smallest new name counts."""
    file = moves.where("old is not null and new is not null").select(add_md(slashes(F.col("old"))).alias("path"), add_md(slashes(F.col("new"))).alias("__to"))
    file = file.groupBy("path").agg(F.min("__to").alias("__to"))
    return notes.join(file, "path", "left").withColumn("path", F.coalesce("__to", "path")).select(*notes.columns)


def moved_all(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """All notes after the moves: their paths, and the links in them."""
    kind = notes.schema["content"].dataType
    out = _rewritten(new_paths(notes, moves), moves)
    new = F.when(is_rewritable(F.col("path")), F.col("__new")).otherwise(F.col("content"))
    return out.withColumn("content", new.cast(kind)).select(*notes.columns)


def clashes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Paths that more than one note would have after the moves: (path, n). Empty if they can be made."""
    return new_paths(notes.select("path"), moves).groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def plain(content: str, moves: list[tuple[str, str]], shapes) -> str:
    """The definition, character by character, over the pairs of link texts of ``shapes(old, new)``; for tests."""
    pairs: dict[str, str] = {}
    for old, new in sorted((old.replace("\\", "/").removesuffix(".md"), new) for old, new in moves):
        for a, b in shapes(old, new).items():
            pairs.setdefault(a, b)
    out, i = "", 0
    while i < len(content):
        hits = [a for a in pairs if content.startswith(a, i)]
        if hits:
            a = max(hits, key=len)
            end = 2 if a.endswith("]]") else 1  # what closes the link may open the next
            out += pairs[a][:-end]
            i += len(a) - end
        else:
            out, i = out + content[i], i + 1
    return out
