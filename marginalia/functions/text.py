"""Text functions: case, white space, lines, escapes, URIs, value parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Strip all Unicode white space from both ends (``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lines(c: Column) -> Column:
    """Lines at \\n; a final newline gives a final empty line; CR stays."""
    return F.split(c, "\n", -1)


def contains_ci(c: Column, query: str | Column) -> Column:
    """Literal, case-insensitive substring; an empty query is in everything."""
    return F.contains(F.lower(c), F.lower(F.lit(query) if isinstance(query, str) else query))


#: Two-character escapes and what they stand for.
ESCAPES = {r"\n": "\n", r"\r": "\r", r"\t": "\t", r"\\": "\\", r"\"": '"', r"\'": "'"}


def unescape(c: Column) -> Column:
    """One pass from left to right, so an escaped backslash never starts another escape."""
    known = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])
    parts = F.regexp_extract_all(c, F.lit(r"""(?s)(\\[nrt\\"']|[^\\]+|\\)"""))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def path_escape(c: Column) -> Column:
    """Percent-encoding for a path segment: space is %20, and ``$ & + = : @ ~`` stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for ch in "$&+=:@~":
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def uri(base: str, **params: str | bool | Column) -> Column:
    """``base`` with the parameters that are neither empty nor "false", in the given order."""
    cols = {k: v if isinstance(v, Column) else F.lit(str(v).lower() if isinstance(v, bool) else v) for k, v in params.items()}
    parts = F.array_compact(F.array(*[F.when((v != "") & (v != "false"), F.concat(F.lit(k + "="), path_escape(v))) for k, v in cols.items()]))
    return F.concat(F.lit(base), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def value_json(c: Column) -> Column:
    """A command-line value as JSON: true and false, ``[a, b]`` lists of trimmed strings, else a string."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    items = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ",", -1), trim_ws))
    quoted = F.regexp_replace(F.substring(F.to_json(F.struct(c.alias("x"))), 6, 2**31 - 1), r"\}\z", "")
    return F.when(c.isin("true", "false"), c).when(c.startswith("[") & c.endswith("]") & (F.length(c) >= 2), F.to_json(items)).otherwise(quoted)
