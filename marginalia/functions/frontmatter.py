"""YAML headers of notes: detect, parse, set, delete.

Header and body are cut apart byte by byte; only the header text goes to Python (Arrow
batches) for YAML, which Spark cannot parse, and the body never leaves the JVM and is never decoded.
Keys are sorted and comments lost when a header is written.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, trim_ws, value_json

DELIMITER = "---"
NO_HEADER, BAD_YAML = "the note has no header", "the header is not valid YAML"
_CLOSE = r"\n---[^\S\n]*(?:\n|\z)"


def has_header(c: Column) -> Column:
    """The first line is the delimiter; a closing one is not asked for."""
    return trim_ws(F.substring_index(c, "\n", 1)) == DELIMITER


def parts(b: Column) -> Column:
    """struct(open, header, body) of a content in bytes: cut at the delimiters, byte by byte.

    As Latin-1 every byte is one character, so places found there are places in the bytes, whatever
    they stand for. The header is null unless it is opened and closed; the body is then all there is."""

    def lines(s: Column) -> Column:
        return F.struct(s.alias("s"), F.instr(s, F.lit("\n")).alias("nl"))

    def ends(p: Column) -> Column:
        first = F.when(p["nl"] > 0, F.substring(b, F.lit(1), p["nl"] - 1)).otherwise(b)
        opened = trim_ws(first.cast("string")) == DELIMITER
        at, n = F.regexp_instr(p["s"], F.lit(_CLOSE)), F.octet_length(F.regexp_substr(p["s"], F.lit(_CLOSE)))
        return F.struct(p["nl"].alias("nl"), opened.alias("open"), F.when(opened, at).alias("at"), F.when(opened, n).alias("n"))

    def cut(e: Column) -> Column:
        head, rest = F.substring(b, e["nl"] + 1, e["at"] - e["nl"]), F.substring(b, e["at"] + e["n"], F.lit(2**31 - 1))
        return F.struct(e["open"].alias("open"), F.when(e["at"] > 0, head).alias("header"), F.when(e["at"] > 0, rest).otherwise(b).alias("body"))

    return let(let(let(F.decode(b, "ISO-8859-1"), lines), ends), cut)


def is_closed(c: Column) -> Column:
    return parts(c.cast("binary"))["header"].isNotNull()


def header(c: Column) -> Column:
    """The YAML text; null without a closed header."""
    return parts(c.cast("binary"))["header"].cast("string")


def body(c: Column) -> Column:
    """What follows a closed header, else everything."""
    return parts(c.cast("binary"))["body"].cast("string")


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading and writing YAML headers needs PyYAML on the workers") from e
    return yaml


#: What libyaml reads and writes just as the code in Python does, several times faster: short lines of ASCII without
#: quotes, flow, comments or nesting. Anything else is left to the code in Python, from which libyaml differs in places.
_KEY, _VALUE = r"[A-Za-z_][A-Za-z0-9_]{0,30}", r"[A-Za-z0-9_](?:[A-Za-z0-9_./-]{0,38}[A-Za-z0-9_])?"
_SIMPLE, _WORD = re.compile(rf"(?:{_KEY}: {_VALUE}\n)+"), re.compile(rf"{_KEY}|{_VALUE}")


def _quick(name: str, simple: bool):
    """YAML's class of that name, libyaml's where it does the same."""
    return getattr(_yaml(), f"C{name}" if simple and _yaml().__with_libyaml__ else name)


#: What a header may raise: YAML itself, dates that do not exist, mappings as keys, endless nesting.
_BROKEN = (ValueError, TypeError, RecursionError, OverflowError)


def plain(value):
    """A YAML value as JSON can hold it: keys are strings, what has no type of its own is text."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(plain(k)).strip('"'): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return ".nan" if math.isnan(value) else ".inf" if value > 0 else "-.inf"
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)


def load(text: str) -> dict | None:
    """A header's mapping, None if it is empty; ValueError if it is not a mapping."""
    yaml = _yaml()
    try:
        got = yaml.load(text, _quick("SafeLoader", _SIMPLE.fullmatch(text) is not None))
        if got is not None and not isinstance(got, dict):
            raise ValueError
        json.dumps(plain(got))  # what is endless shows here
        return got
    except (yaml.YAMLError, *_BROKEN) as e:
        raise ValueError(BAD_YAML) from e


def dump(values: dict) -> str:
    """Sorted YAML; keys that are no strings are written as such, since only strings sort with strings."""
    if not values:
        return ""
    if not all(isinstance(k, str) for k in values):
        values = {k if isinstance(k, str) else str(k): v for k, v in values.items()}
    simple = all(_WORD.fullmatch(k) and (v is None or isinstance(v, (bool, int)) or (isinstance(v, str) and _WORD.fullmatch(v))) for k, v in values.items())
    try:
        return _yaml().dump(values, Dumper=_quick("SafeDumper", simple), sort_keys=True, allow_unicode=True, default_flow_style=False)
    except _BROKEN:
        return _yaml().safe_dump(plain(values), sort_keys=True, allow_unicode=True, default_flow_style=False)


@F.pandas_udf(T.StructType().add("json", T.StringType()).add("error", T.StringType()))
def _parsed(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            got = load(t) if t is not None else None
            out.append((None if got is None else json.dumps(plain(got), ensure_ascii=False, allow_nan=False), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["json", "error"], dtype=object)


@F.pandas_udf(T.StructType().add("header", T.StringType()).add("error", T.StringType()))
def _edited(text: pd.Series, key: pd.Series, value: pd.Series) -> pd.DataFrame:
    """The header with a key set to a JSON value, or without the key if that is null."""
    out = []
    for t, k, v in zip(text, key, value):
        try:
            got = load(t) if t is not None else None
            if v is None and got is None:
                out.append((None, NO_HEADER))
                continue
            got = dict(got or {})
            if v is None:
                got.pop(k, None)
            else:
                got[k] = json.loads(v)
            out.append((dump(got), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["header", "error"], dtype=object)


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("error", T.StringType()))
def _printed(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            out.append((dump((load(t) if t is not None else None) or {}), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["text", "error"], dtype=object)


def printed(c: Column) -> Column:
    """struct(text, error): the header as it is shown, sorted; empty without one."""
    return _printed(_head(c.cast("binary"))[0])


def parse(c: Column) -> Column:
    """struct(values variant, body, error): values are null without a header or with an empty one."""
    text, bad = _head(c.cast("binary"))
    got = _parsed(text)
    error = F.coalesce(bad, got["error"])
    return F.struct(F.try_parse_json(got["json"]).alias("values"), F.when(error.isNull(), body(c)).alias("body"), error.alias("error"))


def keys(c: Column) -> Column:
    """The header's keys, sorted; none without a header."""
    got = F.map_keys(F.from_json(_parsed(_head(c.cast("binary"))[0])["json"], "map<string,string>"))
    return F.array_sort(F.coalesce(got, F.array().cast("array<string>")))


def _head(b: Column) -> tuple[Column, Column]:
    """The header's text as YAML may have it, and the error of one that is not UTF-8."""
    h = parts(b)["header"].cast("string")
    return F.when(F.is_valid_utf8(h), h), F.when(~F.is_valid_utf8(h), BAD_YAML)


def set_key_bytes(b: Column, key: str, value: str | Column) -> Column:
    """struct(content, error): a key set to a command-line value; a header is made if there is none. The
    body's bytes stay as they are, whatever they are; only the header is decoded."""
    v = value if isinstance(value, Column) else F.lit(value)
    text, bad = _head(b)
    got = _edited(text, F.lit(key), value_json(v))
    error = F.coalesce(bad, got["error"])
    new = F.concat(F.encode(F.concat(F.lit("---\n"), got["header"], F.lit("---\n")), "UTF-8"), parts(b)["body"])
    return F.struct(F.when(error.isNull(), new).alias("content"), error.alias("error"))


def delete_key_bytes(b: Column, key: str) -> Column:
    """struct(content, error): without the key; without its last key a header goes, and one
    newline after it. A missing key is no error, a missing header is one. As :func:`set_key_bytes` for bytes."""
    text, bad = _head(b)
    got, rest = _edited(text, F.lit(key), F.lit(None).cast("string")), parts(b)["body"]
    after = F.when(F.substring(rest, F.lit(1), F.lit(1)) == F.lit(b"\n"), F.substring(rest, F.lit(2), F.lit(2**31 - 1))).otherwise(rest)
    new = F.when(got["header"] == "", after).otherwise(F.concat(F.encode(F.concat(F.lit("---\n"), got["header"], F.lit("---\n")), "UTF-8"), rest))
    error = F.when(~parts(b)["open"], NO_HEADER).otherwise(F.coalesce(bad, got["error"]))
    return F.struct(F.when(error.isNull(), new).alias("content"), error.alias("error"))


def set_key(c: Column, key: str, value: str | Column) -> Column:
    """:func:`set_key_bytes` for a content in text."""
    r = set_key_bytes(c.cast("binary"), key, value)
    return F.struct(r["content"].cast("string").alias("content"), r["error"].alias("error"))


def delete_key(c: Column, key: str) -> Column:
    """:func:`delete_key_bytes` for a content in text."""
    r = delete_key_bytes(c.cast("binary"), key)
    return F.struct(r["content"].cast("string").alias("content"), r["error"].alias("error"))
