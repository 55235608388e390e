"""What a user does with a vault: one method per command, on top of the operators.

Opening things (another program's URI, an editor) is handed to functions that a caller may
replace. Reads are Spark plans; one note is written on the driver, many by tasks.
"""

from __future__ import annotations

import os
import shlex
import subprocess
import time
import warnings
import webbrowser
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import frontmatter as fm
from .functions.paths import is_note, is_rewritable, validate_path, with_md
from .functions.text import ESCAPES
from .model import BACKLINK_CAP, SEARCH_CAP, text_notes
from .operators import links, resolve, search
from .operators import moves as many
from .scratch import written
from .sources import listing, registry, sink
from .sources.vault import content_of

NOT_FOUND, UNREADABLE = "cannot find note in vault", "cannot read note in vault"
GUI_EDITORS = ("code", "subl", "atom", "mate")


class NoteError(RuntimeError):
    pass


def unescape_text(text: str) -> str:
    """The escapes of :data:`ESCAPES`, in one pass from left to right."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        out.append(ESCAPES.get(two, text[i]))
        i += 2 if two in ESCAPES else 1
    return "".join(out)


def build_uri(base: str, params: dict[str, str]) -> str:
    own = [f"{k}={quote(v, safe='$&+=:@~')}" for k, v in params.items() if v not in ("", "false")]
    return base + ("?" + "&".join(own) if own else "")


def editor_command(path: str) -> list[str]:
    own = shlex.split(os.environ.get("EDITOR") or "vim")
    wait = any(x in os.path.basename(own[0]) for x in GUI_EDITORS)
    return [*own, *["--wait"] * wait, path]


def open_in_editor(path: str) -> None:
    subprocess.run(editor_command(path), check=True)


@dataclass
class Vault:
    """A vault by name (or the default one), in a session. ``uri_base`` names the scheme and
    host of the application that opens notes."""

    spark: SparkSession
    name: str = ""
    uri_base: str = "notes://"
    preferences: str | None = None
    registry_file: str | None = None
    open_uri: Callable[[str], object] = webbrowser.open
    edit: Callable[[str], None] = open_in_editor
    pick: Callable[[list[str]], int] | None = None
    warn: Callable[[str], object] = warnings.warn
    delay: float = 0.2

    def resolve_name(self) -> str:
        self.name = registry.default_name(self.name, self.preferences)
        return self.name

    def path(self) -> str:
        return registry.vault_path(self.resolve_name(), self.registry_file)

    def files(self) -> DataFrame:
        """What is in the vault now, without contents."""
        return listing.list_vault(self.spark, self.path())

    def notes(self, files: DataFrame | None = None, largest: int | None = None) -> DataFrame:
        """The vault's notes in text; those of more than ``largest`` bytes are listed and not read."""
        own = (self.files() if files is None else files).where(is_note(F.col("path")))
        return text_notes(listing.with_content(own, self.path(), largest))

    def _uri(self, action: str, **params: str) -> str:
        return build_uri(f"{self.uri_base}{action}", params)

    def _open(self, note: str, editor: bool) -> None:
        if editor:
            self.edit(validate_path(self.path(), with_md(note)))
        else:
            self.open_uri(self._uri("open", file=note, vault=self.resolve_name()))

    # commands ---------------------------------------------------------------------------

    def open(self, note: str) -> None:
        """Existence is not checked: that is the opening program's matter."""
        self.open_uri(self._uri("open", file=note, vault=self.resolve_name()))

    def daily(self) -> None:
        self.open_uri(self._uri("daily", vault=self.resolve_name()))

    def _picked(self, items: list[str]) -> int:
        at = self.pick(items) if self.pick else None
        if at is None:
            raise NoteError(NOT_FOUND)
        return at

    def search(self, editor: bool = False) -> str:
        """Pick a note out of all and open it."""
        paths = [r.path for r in resolve.list_notes(self.files()).collect()]
        note = paths[self._picked(paths)]
        self._open(note, editor)
        return note

    def search_content(self, query: str, editor: bool = False) -> str | None:
        """Open the note with the query; of several the one picked; None without a match."""
        found = written(search.search_notes(self.notes(largest=SEARCH_CAP - 1), query), "found")
        few = found.limit(2).collect()
        if not few:
            return None
        if len(few) == 1:
            note = few[0].file_path
        else:
            rows = search.display(found).orderBy(search.walk_key(F.col("file_path")), "line_number").collect()
            note = rows[self._picked([r.display for r in rows])].file_path
        self._open(note, editor)
        return note

    def raw(self, note: str, files: DataFrame | None = None) -> tuple[str, bytes]:
        """The path that a name stands for, and the bytes there. A note that cannot be read is an error."""
        found = resolve.resolve(self.files() if files is None else files, note).first()
        if found is None:
            raise NoteError(NOT_FOUND)
        content = content_of(os.path.join(self.path(), found.path))
        if content is None:
            raise NoteError(f"{UNREADABLE}: {found.path}")
        return found.path, content

    def contents(self, note: str) -> tuple[str, str]:
        path, content = self.raw(note)
        return path, content.decode("utf-8", "replace")

    def print(self, note: str, mentions: bool = False) -> str:
        files = self.files()
        text = self.raw(note, files)[1].decode("utf-8", "replace")
        if mentions:
            text += "".join(r.section for r in links.mentions(links.backlinks(self.notes(files, BACKLINK_CAP), note)).collect())
            for r in links.too_large(files).toLocalIterator():
                self.warn(f"{r.path} is too large to be searched for links ({r.size} bytes)")
        return text

    def set_contents(self, note: str, content: str | bytes) -> None:
        """Overwrites the note that the name stands for; never creates one."""
        path = self.raw(note)[0]
        mode = os.stat(os.path.join(self.path(), path)).st_mode & 0o7777
        sink.put(self.path(), path, content.encode() if isinstance(content, str) else content, mode)

    def create(self, note: str, content: str = "", append: bool = False, overwrite: bool = False, show: bool = False, editor: bool = False) -> None:
        if append and overwrite:
            raise ValueError("append and overwrite exclude each other")
        flag = lambda x: str(x).lower()
        silent = True if editor and show else not show
        self.open_uri(self._uri("new", vault=self.resolve_name(), append=flag(append), overwrite=flag(overwrite), content=unescape_text(content), file=note, silent=flag(silent)))
        if editor and show:
            time.sleep(self.delay)  # the other program writes the note meanwhile
            self._open(note, True)

    def move(self, old: str, new: str, show: bool = False, editor: bool = False) -> int:
        """Rename a note and rewrite the links to it, all or nothing; the number of notes rewritten. Nothing
        is changed if a note cannot be read, since its links could not be followed."""
        root = self.path()
        a, b = (with_md(validate_path(root, x)) for x in (old, new))
        if not os.path.lexists(a) or os.path.isdir(a) or not os.path.isdir(os.path.dirname(b)):
            raise NoteError(NOT_FOUND)
        old_path, new_path = (os.path.relpath(x, root).replace(os.sep, "/") for x in (a, b))
        here = F.col("path") == old_path
        changed = links.rewritten(self.notes(), old, new, unreadable=True)
        changed = changed.select(F.when(here, new_path).otherwise(F.col("path")).alias("path"), "content", "mode", F.when(here, F.col("path")).alias("moved_from"))
        changed = written(changed.where((F.col("path") != new_path) | F.col("moved_from").isNotNull()), "changed")
        if lost := changed.where("content is null").first():
            raise NoteError(f"{UNREADABLE}: {lost.moved_from or lost.path}")
        n = changed.count()
        if changed.where("moved_from is not null").isEmpty():
            one = self.spark.createDataFrame([(new_path, None, None, old_path)], changed.schema)
            sink.write_back(changed.unionByName(one), root)
        else:
            sink.write_back(changed, root)
        if show:
            self._open(new, editor)
        return n

    def move_all(self, moves: DataFrame) -> int:
        """Many moves (old, new) at once, chains and swaps included, as one transaction; the number of notes whose
        links change. An error if two notes would have one path, or a note cannot be read."""
        root, files = self.path(), self.files().where(is_note(F.col("path")))
        for r in moves.toLocalIterator():
            for x in (r.old, r.new):
                validate_path(root, x)
        if clash := many.clashes(files, moves).first():
            raise NoteError(f"{clash.n} notes would be {clash.path}")
        notes = listing.with_content(files, root)
        if lost := notes.where(is_rewritable(F.col("path")) & F.col("content").isNull()).first():
            raise NoteError(f"{UNREADABLE}: {lost.path}")
        paths = many.new_paths(files.select("path", F.col("path").alias("moved_from")), moves)
        changed = many.rewritten_all(notes, moves).select(F.col("path").alias("moved_from"), "content")
        out = paths.join(changed.withColumn("__new", F.lit(True)), "moved_from", "left").where(F.col("__new") | (F.col("path") != F.col("moved_from")))
        out = written(out.select("path", "content", F.lit(None).cast("int").alias("mode"), "moved_from", F.coalesce("__new", F.lit(False)).alias("new")), "changed")
        sink.write_back(out.drop("new"), root)
        return out.where("new").count()

    def recover(self) -> dict[str, int]:
        """Finish or take back what a crash left half done; to be called when nothing else writes."""
        return sink.recover(self.path(), self.spark)

    def delete(self, note: str) -> None:
        try:
            os.remove(with_md(validate_path(self.path(), note)))
        except OSError as e:
            raise NoteError(NOT_FOUND) from e

    def frontmatter(self, note: str, show: bool = False, edit: bool = False, delete: bool = False, key: str = "", value: str = "") -> str:
        """Show, else edit, else delete, whichever is asked for first in this order."""
        one = self.spark.createDataFrame([(bytearray(self.raw(note)[1]),)], "content binary")
        c = F.col("content")
        if show:
            r = one.select(fm.printed(c).alias("p")).select("p.*").first()
            if r.error:
                raise NoteError(r.error)
            return r.text
        if edit:
            if not key or not value:
                raise NoteError(f"an edit needs --{'value' if key else 'key'}")
            r = one.select(fm.set_key_bytes(c, key, value).alias("r")).select("r.*").first()
            said = f"Updated frontmatter key '{key}' in {note}"
        elif delete:
            if not key:
                raise NoteError("a deletion needs --key")
            r = one.select(fm.delete_key_bytes(c, key).alias("r")).select("r.*").first()
            said = f"Deleted frontmatter key '{key}' from {note}"
        else:
            raise NoteError("nothing to do: give --print, --edit or --delete")
        if r.error:
            raise NoteError(r.error)
        self.set_contents(note, bytes(r.content))
        return said

    def set_default(self, name: str) -> str:
        """The preference is saved even if no such vault is then found."""
        registry.set_default_name(name, self.preferences)
        self.name = name
        return self.path()
