"""Secret scans: a worklist unwraps nested layers until nothing new appears, and scans each layer.

A layer is a text and, for each of its code points, the span of the original
text that it came from. Unwrapping a layer may give: the layer with its URL
escapes decoded, the layer with its Unicode and character-reference escapes
decoded, and layers for each base64 run: its lines joined, whatever their
widths, and each long enough line alone, at all four alignments, so that letters or
lines in front don't hide what follows; their bytes are text or compressed text
(gzip, zlib, bzip2, xz, zstandard; all members, wherever the data starts; compression
may nest), under URL and \\x escapes too. Layers wait in a
list until it is empty; a layer whose text already came from the same place is
not taken again, which also ends compression that yields itself.

Spans are code points of the original text, end exclusive: one in a decoded
layer maps to all that its code points came from (for base64 the letters that hold
their bits, for compressed data all letters from its start to its end).

Defined results: a null text is empty; an empty text has no spans; repeated
rows give one row each. Bytes that are no UTF-8 are read as
Latin-1, those with null bytes as UTF-16 too; bytes that aren't clean text and can
hold nothing are no layer. Compressed data is unfolded to at most ``MAX_UNFOLDED``
bytes, which guards a worker's memory against decompression bombs; these are
scanned, larger data is counted in ``n_unread``, and masking takes all of it.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of ties, and the least number of code points of the match (group 2 for assignments).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8
MAX_UNFOLDED = 64 << 20
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_Bytes = namedtuple("_Bytes", "high any")
_URL_BYTE = _Bytes(re.compile(r"%[89A-Fa-f][0-9A-Fa-f]"), re.compile(r"%([0-9A-Fa-f]{2})()"))
_X_BYTE = _Bytes(re.compile(r"\\x[89A-Fa-f][0-9A-Fa-f]"), re.compile(r"""\\+x([0-9A-Fa-f]{2})|\\([nrtabfv0\\'"])"""))
_NAMED = dict(zip("nrtabfv0\\'\"", b"\n\r\t\a\b\f\v\0\\'\"", strict=True))
#: How gzip, zlib, bzip2, xz and zstandard data start.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_FED = 1024
_ESCAPE = re.compile(
    r"(?P<u>(?:\\+u[0-9A-Fa-f]{4}|%u[0-9A-Fa-f]{4})+)|\\+U(?P<U>[0-9A-Fa-f]{8})|\\+u\{(?P<b>[0-9A-Fa-f]{1,6})\}|(?P<x>(?:\\+x[0-9A-Fa-f]{2})+)|&#(?P<d>[0-9]{1,7});|&#[xX](?P<h>[0-9A-Fa-f]{1,6});|\bU\+(?P<p>[0-9A-Fa-f]{4,6})"
)
# The shortest secret has 14 bytes, so fewer letters than its 19 can hold none; lines of letters are joined whatever their widths.
LEAST_LETTERS = 19
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{19}|[A-Za-z0-9+/_-]{1,18}\r?\n)[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]{19,}")
_STANDARD = bytes.maketrans(b"-_", b"+/")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
# Bytes without any of these can hold neither a secret nor a layer with one.
_WORTH = re.compile(
    rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_-]{19}|[A-Za-z0-9+/_-]\r?\n[ \t]*[A-Za-z0-9+/_-]|%[0-9A-Fa-fu][0-9A-Fa-f]|\\[uUx]|&#|U\+[0-9A-Fa-f]"
)
_HINT = re.compile(r"[A-Za-z0-9+/_-]{19}|[A-Za-z0-9+/_-]\r?\n[ \t]*[A-Za-z0-9+/_-]|%[0-9A-Fa-fu][0-9A-Fa-f]|\\[uUx]|&#|U\+[0-9A-Fa-f]")


@dataclass
class Layer:
    text: str
    starts: np.ndarray | None = None  # None: the original text
    ends: np.ndarray | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def part(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return np.arange(start, end), np.arange(start + 1, end + 1)
        return self.starts[start:end], self.ends[start:end]


@dataclass
class Found:
    base: list[tuple[int, str, int]] = field(default_factory=list)
    spans: list[tuple[int, str, int]] = field(default_factory=list)
    layers: int = 1
    large: dict[int, int] = field(default_factory=dict)  # start: end of what unfolds to more than may be held

    @property
    def unread(self) -> int:
        return len(self.large)


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match that decodes replaced by its text."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        plain = decode(m)
        if plain is None:
            continue
        for piece, (first, last) in ((layer.text[at : m.start()], (at, m.start())), (plain, m.span())):
            own_starts, own_ends = layer.part(first, last)
            if piece is plain and len(piece):
                # Every code point maps to its share of the run of escapes.
                edges = np.linspace(0, last - first, len(piece) + 1)
                low, high = np.floor(edges[:-1]).astype(int), np.maximum(np.ceil(edges[1:]).astype(int), np.floor(edges[:-1]).astype(int) + 1)
                own_starts, own_ends = own_starts[low], own_ends[high - 1]
            parts.append(piece)
            starts.append(own_starts[: len(piece)])
            ends.append(own_ends[: len(piece)])
        at = m.end()
    if not parts:
        return None
    own_starts, own_ends = layer.part(at, len(layer.text))
    return Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, own_starts]), np.concatenate([*ends, own_ends]))


def _url(m: re.Match) -> str | None:
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _escape(m: re.Match) -> str | None:
    try:
        if m["u"]:
            units = re.findall(r"u([0-9A-Fa-f]{4})", m["u"])
            return bytes.fromhex("".join(units)).decode("utf-16-be")
        if m["x"]:
            raw = bytes.fromhex("".join(re.findall(r"x([0-9A-Fa-f]{2})", m["x"])))
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return raw.decode("latin-1")
        if m["d"]:
            point = int(m["d"])
        else:
            point = int(m["U"] or m["b"] or m["h"] or m["p"], 16)
        return chr(point) if not 0xD800 <= point < 0xE000 else None
    except (ValueError, OverflowError, UnicodeDecodeError):
        return None


def _engine(raw: bytes, at: int):
    if raw.startswith(b"BZh", at):
        return bz2.BZ2Decompressor()
    if raw.startswith(b"\xfd7zXZ", at):
        return lzma.LZMADecompressor()
    if raw.startswith(b"\x28\xb5", at):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(47)


def _inflate(raw: bytes, at: int, most: int) -> tuple[bytes, int, int, bool]:
    """(unfolded bytes, end, place to go on from, whether there are more than ``most``) of the members one after the other from ``at`` on; of a broken or cut member what comes out."""
    out, size, end = [], 0, at
    while _MAGIC.match(raw, end):
        fed = end
        try:
            engine = _engine(raw, end)
            while not engine.eof and fed < len(raw):
                part = engine.decompress(raw[fed : fed + _FED])  # little at a time: a bomb ends after a few MB more
                fed = min(fed + _FED, len(raw))
                out.append(part)
                size += len(part)
                if size > most:
                    return b"".join(out)[:most], len(raw), len(raw), True
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return b"".join(out), fed + _FED, max(end, at + 1), False
        except Exception as error:  # zstandard's own error type
            if type(error).__name__ != "ZstdError":
                raise
            return b"".join(out), fed + _FED, max(end, at + 1), False
        if not engine.eof:
            return b"".join(out), len(raw), max(end, at + 1), False
        end = fed - len(engine.unused_data)
    return b"".join(out), end, end, False


def _unfolded(raw: bytes, most: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, bytes, whether cut at ``most``) of ``raw`` and of all compressed data in it, wherever it starts, and of that in the unfolded bytes, at the outer place.

    What was unfolded to its end is null bytes in the bytes that held it.
    """
    work, seen = [(None, raw, False)], set()
    while work:
        place, own, cut = work.pop()
        at, rest = 0, None
        while m := _MAGIC.search(own, at):
            low = m.start()
            out, end, at, large = _inflate(own, low, most)
            end = min(end, len(own))
            if at > low + 1 and not large:
                rest = rest or bytearray(own)
                rest[low:at] = bytes(at - low)
            key = ((place or (low,))[0], hashlib.sha256(out).digest())
            if out and key not in seen:
                seen.add(key)
                work.append((place or (low, end), out, large))
        yield *(place or (0, len(raw))), own if rest is None else bytes(rest), cut


def _text(raw: bytes) -> tuple[str, np.ndarray | None] | None:
    """Text of bytes and the bytes of each code point (None: one each): UTF-8, else Latin-1. Bytes that aren't clean text are none unless they may hold something."""
    worth = _WORTH.search(raw)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return (raw.decode("latin-1"), None) if worth else None
    if not text or (_CONTROL.search(text) and not worth):
        return None
    return text, None if text.isascii() else np.array([1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text])


def _readings(m: re.Match) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(start, end, letters, their places) of the joined run and, if it has several lines, of each line that is long enough alone."""
    spans = [m.span()]
    if "\n" in m[0]:
        spans += [line.span() for line in _LINE.finditer(m.string, *m.span())]
    for start, end in spans:
        raw = m.string[start:end].encode()
        letters = raw.translate(_STANDARD, b"\r\n\t =")
        if len(letters) >= LEAST_LETTERS:
            kinds = np.frombuffer(raw, np.uint8)
            yield start, end, letters, start + np.flatnonzero((kinds > 32) & (kinds != 61))


def _base64_layers(layer: Layer, most: int, found: Found) -> Iterator[Layer]:
    """Layers of every run of letters. Read at all four alignments, a run holds what starts at any of its letters."""
    for m in _BASE64.finditer(layer.text):
        for start, end, letters, place in _readings(m):
            for skip in range(4):
                yield from _decoded(layer, start, end, letters[skip:], place[skip:], most, found)


def _wide(raw: bytes) -> Iterator[tuple[str, int]]:
    """(text, first byte) of what UTF-16 of either order would be, where that may hold something; other letters than Latin-1 become one that no pattern takes."""
    if b"\0" in raw:
        for skip in (0, 1):
            low = np.frombuffer(raw, np.uint8)[skip::2]
            high = np.frombuffer(raw + b"\0", np.uint8)[skip + 1 :: 2][: len(low)]
            text = np.where(high == 0, low, 255).astype(np.uint8).tobytes()
            if _WORTH.search(text):
                yield text.decode("latin-1"), skip


def _squeezed(unfolded: Iterator[tuple[int, int, bytes, bool]], found: Found, place) -> Iterator[Layer]:
    """Layers of unfolded bytes; ``place`` gives the span of a range of the bytes that held them."""
    for start, end, out, large in unfolded:
        low, high = place(start, end)
        if large:
            found.large[low] = max(high, found.large.get(low, 0))
        known = _text(out)
        for text in [*(known[:1] if known else ()), *(wide for wide, _ in _wide(out))]:
            yield Layer(text, np.broadcast_to(np.int64(low), len(text)), np.broadcast_to(np.int64(high), len(text)))


def _decoded(layer: Layer, start: int, end: int, letters: bytes, place: np.ndarray, most: int, found: Found) -> Iterator[Layer]:
    size = len(letters) - (len(letters) % 4 == 1)
    raw = binascii.a2b_base64(letters[:size] + b"=" * (-size % 4))

    # Byte k is made of the letters of its bits: 8k // 6 to (8k + 7) // 6.
    def span(low: int, high: int) -> tuple[int, int]:
        return layer.span(int(place[low * 8 // 6]), end if high == len(raw) else int(place[(high * 8 - 1) // 6]) + 1)

    unfolded = _unfolded(raw, most)
    raw = next(unfolded)[2]
    yield from _squeezed(unfolded, found, span)
    known = _text(raw)
    read = [(known[0], 0, 1 if known[1] is None else known[1])] if known is not None else []
    read += [(text, skip, 2) for text, skip in _wide(raw)]
    for text, skip, sizes in read:
        last = skip + (np.arange(1, len(text) + 1) * sizes if isinstance(sizes, int) else np.cumsum(sizes))
        first = (last - sizes) * 8 // 6
        last = np.minimum((last * 8 - 1) // 6, size - 1)
        starts, ends = layer.part(start, end)
        yield Layer(text, starts[place[first] - start], ends[place[last] - start])


def _byte_layers(layer: Layer, most: int, found: Found) -> Iterator[Layer]:
    """Layers of compressed data whose bytes are URL or \\x escapes, with plain letters among them."""
    for pattern in (_URL_BYTE, _X_BYTE):
        if not pattern.high.search(layer.text):
            continue
        own = np.frombuffer(layer.text.encode("latin-1", "replace"), np.uint8)
        for plus in (False, True)[: 1 + (pattern is _URL_BYTE and "+" in layer.text)]:
            data, kept = own.copy(), np.ones(len(own), bool)
            if plus:
                data[own == 43] = 32
            for m in pattern.any.finditer(layer.text):
                data[m.start()] = int(m[1], 16) if m[1] else _NAMED[m[2]]
                kept[m.start() + 1 : m.end()] = False
            places = np.r_[np.flatnonzero(kept), len(own)]
            unfolded = _unfolded(data[kept].tobytes(), most)
            next(unfolded)  # the escapes as text are a layer anyway
            yield from _squeezed(unfolded, found, lambda low, high, places=places: layer.span(int(places[low]), int(places[high])))


def find(text: str | None, most: int = MAX_UNFOLDED) -> Found:
    text = text or ""
    found = Found()
    order = {kind: k for k, kind in enumerate(KINDS)}
    by_place = lambda x: (x[0], order[x[1]], x[2])
    found.base = sorted(((s, kind, e) for kind, s, e in scan(text)), key=by_place)
    spans = set(found.base)
    if _HINT.search(text):
        work, seen = [Layer(text)], {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0)}
        while work:
            layer = work.pop()
            if layer.starts is not None:
                found.layers += 1
                for kind, start, end in scan(layer.text):
                    low, high = layer.span(start, end)
                    spans.add((low, kind, high))
            rewritten = (_rewritten(layer, pattern, decode) for pattern, decode, sign in ((_URL, _url, "%"), (_ESCAPE, _escape, r"\\|%u|&#|U\+")) if re.search(sign, layer.text))
            for child in itertools.chain(rewritten, _byte_layers(layer, most, found), _base64_layers(layer, most, found)):
                if child is not None and child.text:
                    key = (hashlib.sha256(child.text.encode("utf-8", "surrogatepass")).digest(), int(child.starts[0]))
                    if key not in seen:
                        seen.add(key)
                        work.append(child)
    found.spans = sorted(spans, key=by_place)
    return found


def told(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_RESULT = "n_assign long, n_access long, n_hex long, base string, spans string, n_layers long, n_unread long"


def secrets(docs: DataFrame, *, text: str = "text", most: int = MAX_UNFOLDED) -> DataFrame:
    """``docs`` with a struct ``secrets`` per row: base counts, base spans and all spans as kind:start:end lists."""

    @F.pandas_udf(_RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch:
                found = find(value, most)
                kinds = [kind for _, kind, _ in found.base]
                rows.append((*(kinds.count(kind) for kind in KINDS), told(found.base), told(found.spans), found.layers, found.unread))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans", "n_layers", "n_unread"])

    return docs.withColumn("secrets", scanned(F.col(text)))


def masked(text: str | None, mask: str = "[secret]", most: int = MAX_UNFOLDED) -> str | None:
    """The text with every found span and every run that unfolds to too much, overlapping ones joined, replaced by ``mask``."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    found = find(text, most)
    for start, end in sorted([(start, end) for start, _, end in found.spans] + list(found.large.items())):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets masked in the text column; other columns and clean texts stay."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda value: masked(value, mask))

    return docs.withColumn(text, cleaned(F.col(text)))
