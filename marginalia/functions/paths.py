"""Path functions: the ``.md`` suffix, base names, walk order, containment."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_md(c: Column) -> Column:
    return F.when(c.endswith(".md"), c).otherwise(F.concat(c, F.lit(".md")))


def remove_md(c: Column) -> Column:
    """Strip one suffix."""
    return F.regexp_replace(c, r"\.md\z", "")


def slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/", -1), -1)


def walk_key(c: Column) -> Column:
    """Sorts as a depth-first walk with lexical order in each folder: by components."""
    return F.split(c, "/", -1)


def is_note(c: Column) -> Column:
    return c.endswith(".md")


def is_rewritable(c: Column) -> Column:
    """Notes whose links may be rewritten: not hidden themselves (their folders may be)."""
    return is_note(c) & ~basename(c).startswith(".")


def stays_inside(c: Column) -> Column:
    """Whether a relative path, cleaned lexically, stays inside its base; absolute ones do not.

    One fold over the components: the depth below the base, negative for good once it is left.
    """
    step = lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).when(p.isin("", "."), d).otherwise(d + 1)
    return ~c.startswith("/") & (F.aggregate(F.split(c, "/", -1), F.lit(0), step) >= 0)


class PathError(ValueError):
    """A path that would leave the vault."""

    def __init__(self) -> None:
        super().__init__("the path leads out of the vault")


def validate_path(base: str, relative: str) -> str:
    """The absolute path of ``relative`` under ``base``; lexical only, links are not resolved."""
    if os.path.isabs(relative):
        raise PathError
    top = os.path.abspath(base)
    joined = os.path.normpath(os.path.join(top, relative))
    if joined != top and not joined.startswith(top.rstrip(os.sep) + os.sep):
        raise PathError
    return joined


def with_md(name: str) -> str:
    return name if name.endswith(".md") else name + ".md"


def without_md(name: str) -> str:
    return name.removesuffix(".md")
