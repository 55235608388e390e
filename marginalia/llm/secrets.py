"""Secret scans with a recursive decoding worklist.

Base spans come from three patterns over the whole text. Then every encoded stretch of a
layer (URL escapes, ``\\uXXXX`` and ``\\xXX`` escapes, base64 in one run or over several lines, and the members of
gzip/zlib/bzip2/xz anywhere in a decoded layer) is unwrapped into a new layer, which is scanned and unwrapped in turn, until nothing new appears. A layer
with the same bytes from the same place is not entered again, so cycles end; decoded layers
shrink, except compressed ones. What one encoded stretch unwraps beyond ``WINDOW`` bytes is scanned
in overlapping windows, so memory stays bounded; beyond ``max_unwrapped`` bytes in all, a
stretch is reported with kind ``bomb`` rather than dropped, as is an xz stream that asks for more than
``XZ_MEMORY`` to be read. Not unwrapped: the older lzma format, deflate without a header, and the escapes
``\\u{..}`` and ``\\U........``. A finding inside a
layer is mapped back to code points of the original text: byte by byte through URL and
Unicode escapes, and to the whole encoded stretch through base64 and compression; through base64
over several lines, to the lines that hold it. Base64 is read from each of its first four
characters on, as others may be glued to its front, and what it holds need not be text.

Defined results: null text is empty; a span found both directly and in a layer is given once;
repeated rows are each answered; an empty table gives an empty table.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import bz2
import contextlib
import hashlib
import lzma
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, prepare, table, utf8_of

#: The base patterns, the least length of what they find, and the order of kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "bomb")

WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
_B64 = bytes(120 if chr(b).isalnum() and b < 128 or b in b"+/-_=" else 32 for b in range(256))
URL = re.compile(rb"%[0-9A-Fa-f]{2}")
UNI = re.compile(rb"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: The value of each hexadecimal digit, 16 for other bytes.
DIGIT = np.array([int(chr(b), 16) if chr(b) in "0123456789abcdefABCDEF" else 16 for b in range(256)], np.uint8)
B64 = re.compile(rb"[A-Za-z0-9+/_-]+={0,2}")
PLAIN = bytes.maketrans(b"-_", b"+/")
#: Line breaks, written as they are or escaped, with indentation; lines joined by them.
BREAK = re.compile(rb"[\x20\t]*(?:\r?\n|\r|\\r\\n|\\n)[\x20\t]*")
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:" + BREAK.pattern + rb"[A-Za-z0-9+/_-]++)+={0,2}")
CONTROL = bytes(b for b in range(32) if b not in b"\t\n\r")
#: gzip, bzip2, xz, and the headers of zlib.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|" + b"|".join(re.escape(bytes([a, b])) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32))
RUN = 16  # the shortest assignment found, of 12 bytes, has 16 characters in base64
MAX_UNWRAPPED, WINDOW, OVERLAP = 1 << 30, 16 << 20, 1 << 20
PIECE = 1 << 14
#: What an xz stream may ask for; one that asks for more is a ``bomb``.
XZ_MEMORY = 128 << 20
BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError)


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """Base spans in bytes. Cheap searches for what a match must have come first."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", a, b) for a, b in runs(text, _HEX, LEAST["hex"])]
    return out


def runs(text: bytes, table: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` bytes of a class."""
    flat, probe, out, at = text.translate(table), b"x" * least, [], 0
    while (at := flat.find(probe, at)) >= 0:
        end = flat.find(b" ", at)
        end = len(flat) if end < 0 else end
        out.append((at, end))
        at = end
    return out


class Layer:
    """Bytes with, for each of them, the original bytes [lo, hi) that it came from, or one number each
    for all of them; None: itself."""

    __slots__ = ("data", "lo", "hi")

    def __init__(self, data: bytes, lo: np.ndarray | int | None = None, hi: np.ndarray | int | None = None):
        self.data, self.lo, self.hi = data, lo, hi

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.lo is None:
            return a, b
        return (self.lo, self.hi) if isinstance(self.lo, int) else (int(self.lo[a:b].min()), int(self.hi[a:b].max()))

    def spliced(self, start: np.ndarray, length: np.ndarray, code: np.ndarray, run: np.ndarray, as_bytes: bool) -> "Layer":
        """This layer with a byte or a character, the ``code``, in place of each stretch that begins at
        ``start`` (a negative one: nothing). What replaces a stretch comes from the whole of its
        ``run``, which is a number that neighbours share."""
        data = np.frombuffer(self.data, np.uint8)
        n = len(data)
        start, length, run = start.astype(np.int32), length.astype(np.int8), run.astype(np.int32)
        wide = ((1 if as_bytes else 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)) * (code >= 0)).astype(np.int8)
        size = np.ones(n, np.int8)
        for i in range(int(length.max())):
            size[start[length > i] + i] = 0
        size[start] = wide
        at = np.cumsum(size, dtype=np.int32)
        out = np.empty(int(at[-1]), np.uint8)
        at -= size
        kept = size > 0
        kept[start] = False
        out[at[kept]] = data[kept]
        for i in range(int(wide.max())):
            own = wide > i
            c, w = code[own], wide[own].astype(np.int32)
            lead = np.select([w < 2, w == 2, w == 3], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)
            out[at[start[own]] + i] = (lead if i == 0 else 0x80 | c >> 6 * (w - 1 - i) & 63).astype(np.uint8)
        del at, kept
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])).astype(np.int32)
        last = np.append(begin[1:], len(start)) - 1
        a, b, each = start[begin], start[last] + length[last], np.diff(np.append(begin, len(start)))
        if self.lo is None:
            lo = np.arange(n, dtype=np.int32)
            hi = lo + 1
        else:
            lo, hi = (np.array(np.broadcast_to(x, n), np.int32) for x in (self.lo, self.hi))
            cuts = np.stack([a, b], 1).ravel()
            cuts = cuts[:-1] if cuts[-1] == n else cuts
            a, b = np.minimum.reduceat(lo, cuts)[::2], np.maximum.reduceat(hi, cuts)[::2]
        lo[start], hi[start] = np.repeat(a, each), np.repeat(b, each)
        return Layer(out.tobytes(), np.repeat(lo, size), np.repeat(hi, size))

    def whole(self, a: int, b: int, data: bytes) -> "Layer":
        return Layer(data, *self.origin(a, b))


def decompressor(data):
    """For what starts like a compressed member, else None."""
    head = bytes(data[:6])
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)


def over_limit(e: Exception) -> bool:
    """Whether an xz stream needs a dictionary larger than ``XZ_MEMORY``: it is not broken, and not read."""
    return isinstance(e, lzma.LZMAError) and "limit" in str(e)


def inflate(data: bytes, most: int, at: int = 0) -> tuple[bytes, int, bool] | None | bool:
    """What the compressed members from ``at`` on hold, one after another, where the last whole one ends,
    and whether a cut or broken one follows; None if there are none, False if they hold more than ``most``.
    Two bytes are a zlib header by chance, so one that breaks counts only at the start of the data."""
    view, out, n, end, cut = memoryview(data), [], 0, at, False
    while not cut and n <= most and (d := decompressor(view[end:])) is not None:
        for piece in (PIECE, 1):  # byte by byte up to the damage, if any: what comes before it counts
            got, cut = [], True
            try:
                for i in range(end, len(data), piece):
                    got.append(d.decompress(view[i : i + piece], most - n + 1))
                    n += len(got[-1])
                    if d.eof or n > most:
                        break
                broken = False
            except BROKEN as e:
                if over_limit(e):
                    return False
                broken = True
            if piece == 1 or not broken:
                out += got
                break
            n -= sum(map(len, got))
            if end and data[end] & 15 == 8:
                break
            d = decompressor(view[end:])
        if d.eof and not broken:
            end, cut = min(len(data), i + piece) - len(d.unused_data), False
            while end < len(data) and not data[end]:  # gzip and xz files may be padded
                end += 1
    return False if n > most else (b"".join(out), end, cut) if n else None


def windows(data: bytes, at: int, most: int):
    """What the compressed members from ``at`` on hold, in overlapping windows; None in the end if that
    is more than ``most``."""
    view, end, held, fresh, n = memoryview(data), at, [], 0, 0
    while (d := decompressor(view[end:])) is not None:
        try:
            for i in range(end, len(data), 1 << 10):
                held.append(d.decompress(view[i : i + (1 << 10)]))
                n, fresh = n + len(held[-1]), fresh + len(held[-1])
                if n > most:
                    yield None
                    return
                if fresh >= WINDOW:
                    whole = b"".join(held)
                    yield whole
                    held, fresh = [whole[-OVERLAP:]], 0
                if d.eof:
                    break
        except BROKEN as e:
            if over_limit(e):
                yield None
                return
            break
        if not d.eof:
            break
        end = min(len(data), i + (1 << 10)) - len(d.unused_data)
        while end < len(data) and not data[end]:
            end += 1
    if fresh:
        yield b"".join(held)


def readable(data: bytes) -> bool:
    """Whether decoded bytes look like text: UTF-8 with few control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return (len(data) - len(data.translate(None, CONTROL))) * 20 <= len(text)


def unwrap(layer: Layer, most):
    """The layers inside a layer; (start, end, None) for what would unwrap to more than ``most`` allows at its start."""
    data = layer.data
    if layer.lo is not None:  # a layer that is compressed itself, wherever it comes from
        done = 0
        for at in packed(data):
            if at < done:  # what a whole member holds is not looked into twice
                continue
            got = inflate(data, min(WINDOW, most(at)), at)
            if got is False:
                if any(x is None for x in windows(data, at, most(at))):
                    yield at, len(data), None
                else:
                    yield from (layer.whole(at, len(data), x) for x in windows(data, at, most(at)) if telling(x))
            elif got is not None:
                new, done, cut = got
                if telling(new):
                    yield layer.whole(at, len(data) if cut else done, new)
    if b"%" in data and URL.search(data):
        x = np.frombuffer(data, np.uint8)
        start = np.flatnonzero(x[:-2] == 37)
        one, two = DIGIT[x[start + 1]], DIGIT[x[start + 2]]
        own = (one < 16) & (two < 16)
        start, code = start[own], (one[own] * 16 + two[own]).astype(np.int32)
        yield layer.spliced(start, np.full(len(start), 3, np.int8), code, np.arange(len(start), dtype=np.int32), True)
    if (b"\\u" in data or b"\\x" in data) and UNI.search(data):
        yield layer.spliced(*escapes(np.frombuffer(data, np.uint8)), False)
    for a, b in runs(data, _B64, RUN):
        for m in B64.finditer(data, a, b):
            for raw, _ in decoded(m.group().rstrip(b"=")):
                if telling(raw):
                    yield layer.whole(m.start(), m.end(), raw)
    for lines in wrapped(data):
        found = [x for x in decoded(b"".join(data[a:b] for a, b in lines).rstrip(b"=")) if telling(x[0])]
        if found:  # each byte comes from the whole lines that its characters stand on
            of = np.repeat(np.arange(len(lines)), [b - a for a, b in lines])
            lo, hi = (np.array(x)[of] for x in zip(*(layer.origin(a, b) for a, b in lines)))
            for raw, shift in found:
                at = shift + np.arange(len(raw)) * 4 // 3
                yield Layer(raw, lo[at], hi[at + 1])


def escapes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unicode escapes: where they begin, how long they are, their characters (surrogate pairs put
    together, lone ones replaced), and the runs that count as one: those with other than ASCII."""
    n = len(x)
    start = np.flatnonzero(x == 92)
    digit = lambda i: np.where(start + i < n, DIGIT[x[np.minimum(start + i, n - 1)]], 16).astype(np.int32)
    kind = x[np.minimum(start + 1, n - 1)]
    d = [digit(i) for i in range(2, 6)]
    short = (kind == 120) & (d[0] < 16) & (d[1] < 16)
    long = (kind == 117) & np.all([v < 16 for v in d], axis=0)
    code = np.where(long, d[0] << 12 | d[1] << 8 | d[2] << 4 | d[3], d[0] << 4 | d[1])
    own = short | long
    start, length, code = start[own], np.where(long, 6, 4)[own], code[own]
    new = np.concatenate([[True], start[1:] != start[:-1] + length[:-1]])  # the first escape of a run
    run = np.cumsum(new) - 1
    ascii_ = np.maximum.reduceat(code, np.flatnonzero(new)) < 128
    high, low = (code & 0xFC00) == 0xD800, (code & 0xFC00) == 0xDC00
    pair = np.append(high[:-1] & low[1:] & ~new[1:], False)
    second = np.append(False, pair[:-1])
    both = 0x10000 + ((code & 0x3FF) << 10) + np.append(code[1:] & 0x3FF, 0)
    code = np.where(pair, both, np.where((high | low) & ~pair, 0xFFFD, code))
    code = np.where(second, -1, code)
    return start, length, code, np.where(ascii_[run], -1 - np.arange(len(run)), run)


def wrapped(data: bytes):
    """Base64 over several lines, as (start, end) of each line."""
    if not (b"\n" in data or b"\r" in data or b"\\n" in data):
        return
    for m in WRAPPED.finditer(data):
        if m.end() - m.start() > RUN:
            cuts = [m.start(), *(x for c in BREAK.finditer(data, m.start(), m.end()) for x in c.span()), m.end()]
            yield list(zip(cuts[::2], cuts[1::2]))


def decoded(body: bytes):
    """Base64 characters decoded from each of their first four on, as other characters may be glued to the
    front, and how many were left out."""
    body = body.translate(PLAIN)
    for shift in range(4):
        n = len(body) - shift
        n -= n % 4 == 1
        if n >= RUN - 2:
            yield base64.b64decode(body[shift : shift + n] + b"=" * (-n % 4)), shift


def packed(data: bytes):
    """Where compressed members may start; in text that can only be its start."""
    if decompressor(data) is not None:
        yield 0
    if MAGIC.search(data, 1) and not readable(data):
        yield from (m.start() for m in MAGIC.finditer(data, 1))


def telling(data: bytes) -> bool:
    """Whether a decoded layer, readable or not, has anything to find or to unwrap."""
    return bool(scan(data) or runs(data, _B64, RUN) or UNI.search(data) or URL.search(data)) or any(next(x, None) is not None for x in (packed(data), wrapped(data)))


def find(text: bytes, max_unwrapped: int = MAX_UNWRAPPED) -> tuple[list, list]:
    """Base spans and all spans of a text, as (start, order of kind, end) in bytes."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted((a, order[k], b) for k, a, b in scan(text))
    spans = set(base)
    if not (b"%" in text or b"\\u" in text or b"\\x" in text or runs(text, _B64, RUN) or next(wrapped(text), None)):
        return base, base
    # a layer is known by what it holds and where it stands: the same secret may be hidden twice
    seen, work = {(hashlib.sha1(text).digest(), 0, len(text))}, deque([Layer(text)])
    used: dict[int, int] = {}  # by where an encoded stretch starts in the text
    while work:
        layer = work.pop()  # the last first, so that few large layers are held at once
        for got in unwrap(layer, lambda at: max(0, max_unwrapped - used.get(layer.origin(at, at + 1)[0], 0))):
            if isinstance(got, tuple):
                a, b = layer.origin(got[0], got[1])
                spans.add((a, order["bomb"], b))
                continue
            if got.data and (key := (hashlib.sha1(got.data).digest(), *got.origin(0, len(got.data)))) not in seen:
                seen.add(key)
                if len(got.data) > len(layer.data):
                    used[key[1]] = used.get(key[1], 0) + len(got.data)
                for k, a, b in scan(got.data):
                    a, b = got.origin(a, b)
                    spans.add((a, order[k], b))
                work.append(got)
    return base, sorted(spans)


def in_code_points(text: bytes, spans: list) -> list[tuple[int, int, int]]:
    if text.isascii() or not spans:
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[a]), k, int(lead[b])) for a, k, b in spans]


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, keep: list[str] | None = None, max_unwrapped: int = MAX_UNWRAPPED) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and spans."""
    prepare(docs.sparkSession)
    fields = T.StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_spans", "string").add("spans", "string")

    def make():
        def f(b):
            rows = []
            for text in utf8_of(b):
                text = text or b""
                base, spans = (in_code_points(text, s) for s in find(text, max_unwrapped))
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), shown(base), shown(spans)))
            cols = list(zip(*rows)) or [()] * 5
            return [pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),) * 2)]

        return f

    return add_columns(docs, make, fields, keep)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
