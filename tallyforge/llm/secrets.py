"""Secret scans through nested encodings.

A text is a layer. A worklist unwraps what a layer encloses: percent escapes, Unicode
escapes, base64 runs, and compressed bytes inside those, with all their members and frames. Each new layer is scanned like
the text and put on the list, until none brings anything new; a layer's content that was
seen for this place already is a cycle and ends there. Every layer knows which characters
of the original text each of its own came from, so spans are always in code points of the
text that was given.

Every character of compressed data comes from all of their place, so which kinds they hold is all
that counts. Where a document's data unpack to more than IN_MEMORY bytes, they are read as a stream,
through all compressions around each other, in windows that overlap, each searched like a
text of its own. No size ends that. Only data packed DEEPEST times, or compressed data inside such a
stream that a window cuts off, are reported as a span of kind "packed", beside what was found.

Defined results: null text is an empty text; an empty text has no spans and the hash of the
empty string; texts of any length are scanned whole; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored, under whatever names.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import map_batches, only, read_table, texts_of

KINDS = ("assign", "access", "hex")
#: Bytes that a document's compressed data may take at once; windows of streams and their overlap.
IN_MEMORY, WINDOW, OVERLAP = 64 << 20, 4 << 20, 256 << 10
DEEPEST = 64
_NAMES = (*KINDS, "packed")
_ORDER = {k: i for i, k in enumerate(_NAMES)}
#: base64 runs from so many characters on are tried.
MIN_BASE64 = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_UNIT = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: How compressed data start: gzip, zlib, bzip2, xz, zstd and its frames to skip.
_MAGICS = (b"\x1f\x8b\x08", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", *(bytes([0x50 + k]) + b"\x2a\x4d\x18" for k in range(16)))
_NULS = re.compile(rb"\x00*")
_SHORT = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "0": 0, "\\": 92, "'": 39, '"': 34, "/": 47}


def _magic(mark: str, forms: str) -> re.Pattern:
    """The starts, each byte as an escape (@@ and @ are its two and its least hexadecimal digits) or as it is."""

    def one(b: int) -> str:
        out = [forms.replace("@@", f"(?i:{b:02x})").replace("@", f"(?i:{b:x})")]
        out += [re.escape(chr(b))] if 0x20 < b < 0x7F else []
        out += [rf"\\{c}" for c, v in _SHORT.items() if v == b < 32] if mark == "\\" else []
        return f"(?:{'|'.join(out)})"

    return re.compile("|".join("".join(map(one, m)) for m in _MAGICS))


#: Bytes in text, for each kind of escape: its mark, the starts, a run, and a run's bytes as (digits, short escape, plain).
_PERCENT_BYTE = r"%([0-9A-Fa-f]{2})|([^\x00-\U0010ffff])|([!-$&-~])"
_ESCAPED_BYTE = r"""\\(?:x|u00|U000000|u(?=\{0{0,4}[0-9A-Fa-f]{1,2}\}))([0-9A-Fa-f]{2}|\{[0-9A-Fa-f]+\})|\\([abtnvfr0\\'"/])|([\x20-\[\]-~])"""
_BYTES = [(mark, _magic(mark, forms), re.compile(f"(?:{byte})+"), re.compile(byte)) for mark, forms, byte in (("%", "%@@", _PERCENT_BYTE), ("\\", r"\\x@@|\\u00@@|\\U000000@@|\\u\{0*@\}", _ESCAPED_BYTE))]
#: Such runs line below line, as text or with escaped line ends; the lines of those.
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:%s[A-Za-z0-9+/_-]+)+={0,2}" % (MIN_BASE64, _BREAK))
_LINE = re.compile(rf"(?:{_BREAK})?([A-Za-z0-9+/_-]+={{0,2}})")
_STANDARD = {45: 43, 95: 47}
_COMPRESSED = re.compile(b"|".join(map(re.escape, _MAGICS)))
#: What decoded bytes must hold somewhere for a pattern to match them or a layer to lie in them.
_WORTH = re.compile(rb"[A-Za-z0-9+/_-]{%d}|%%[0-9A-Fa-f]{2}|\\[xuU]|(?i:passw|secret|token|api_?key)" % MIN_BASE64)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the three patterns find, sorted."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the start and end, in the original, of each of its characters.

    first and last are None for the original itself.
    """

    __slots__ = ("first", "last", "text")

    def __init__(self, text: str, first=None, last=None):
        self.text, self.first, self.last = text, first, last

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.first is None else (int(self.first[a]), int(self.last[b - 1]))


def _from_units(layer: Layer, pieces: list[tuple[str, int, int]]) -> Layer:
    """A layer from (text, start, end) pieces; a piece as long as its range maps one to one."""
    firsts, lasts = [], []
    for text, a, b in pieces:
        if not text:
            continue
        if len(text) == b - a:
            own = np.arange(a, b)
            f, e = own, own + 1
        else:
            f, e = np.full(len(text), a), np.full(len(text), b)
        if layer.first is not None:
            f, e = layer.first[f], layer.last[e - 1]
        firsts.append(f)
        lasts.append(e)
    none = np.zeros(0, np.int64)
    return Layer("".join(t for t, _, _ in pieces), np.concatenate(firsts or [none]), np.concatenate(lasts or [none]))


def _chars(data: bytes) -> list[tuple[str, int, int]]:
    """(character, first byte, end byte) of UTF-8 data; a byte that is none is a character of its own."""
    out, at = [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        n = len(c.encode("utf-8", "surrogateescape"))
        out.append((c, at, at + n))
        at += n
    return out


def _percent(layer: Layer) -> Layer | None:
    pieces, at, t = [], 0, layer.text
    for m in _PERCENT.finditer(t):
        chars = _chars(bytes.fromhex(m[0].replace("%", "")))
        pieces.append((t[at : m.start()], at, m.start()))
        pieces += [(c, m.start() + 3 * i, m.start() + 3 * j) for c, i, j in chars]
        at = m.end()
    return _from_units(layer, [*pieces, (t[at:], at, len(t))]) if at else None


def _unicode(layer: Layer) -> Layer | None:
    pieces, at, t = [], 0, layer.text
    for m in _UNICODE.finditer(t):
        units = [(int(next(filter(None, u.groups())), 16), u.start(), u.end()) for u in _UNIT.finditer(t, m.start(), m.end())]
        new, k = [], 0
        while k < len(units):
            v, i, j = units[k]
            if 0xD800 <= v < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
                k += 1
                v, j = 0x10000 + ((v - 0xD800) << 10) + units[k][0] - 0xDC00, units[k][2]
            new.append((chr(v) if v < 0x110000 and not 0xD800 <= v < 0xE000 else "\ufffd", i, j))
            k += 1
        pieces += [(t[at : m.start()], at, m.start()), *new]
        at = m.end()
    return _from_units(layer, [*pieces, (t[at:], at, len(t))]) if at else None


def _stream(data, at: int, most: int) -> tuple[bytes, int] | None:
    """What the member or frame at a place holds and where it ends, or None if there is none.

    One that is cut off or damaged gives what comes before and ends with the data. Raises
    OverflowError beyond most bytes.
    """
    head, step = bytes(data[at : at + 6]), 1 << 16
    if head[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
    elif len(head) > 2 and head[0] == 0x78 and int.from_bytes(head[:2], "big") % 31 == 0:
        d = zlib.decompressobj()
    elif head[:3] == b"BZh":
        d = bz2.BZ2Decompressor()
    elif head == b"\xfd7zXZ\x00":
        d = lzma.LZMADecompressor()
    elif head[:4] == b"\x28\xb5\x2f\xfd" or (head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):
        import zstandard

        # it has no limit of its own, so that steps are short: a block of four bytes may hold 128 KiB
        d, step = zstandard.ZstdDecompressor().decompressobj(), 256
    else:
        return None
    limited, out, size, k = step > 256, [], 0, 256
    try:
        while at < len(data) and not d.eof:
            part = data[at : at + k]
            at += len(part)
            out.append(d.decompress(part, most - size + 1) if limited else d.decompress(part))
            size += len(out[-1])
            if size > most:
                raise OverflowError
            k = min(2 * k, step)
    except OverflowError:
        raise
    except Exception:  # each format has its own error
        return (b"".join(out), len(data)) if size else None
    return b"".join(out), at - len(d.unused_data)


def _reader(raw: io.BufferedReader) -> io.BufferedReader | None:
    """What unpacks the compressed data that a stream starts with, members and frames one after the other."""
    head = raw.peek(6)[:6]
    if head[:2] == b"\x1f\x8b":
        out = gzip.GzipFile(fileobj=raw)
    elif head[:3] == b"BZh":
        out = bz2.BZ2File(raw)
    elif head == b"\xfd7zXZ\x00":
        out = lzma.LZMAFile(raw)
    elif head[:4] == b"\x28\xb5\x2f\xfd" or (head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):
        import zstandard

        out = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    elif len(head) > 2 and head[0] == 0x78 and int.from_bytes(head[:2], "big") % 31 == 0:
        out = _Zlib(raw)
    else:
        return None
    return io.BufferedReader(out, 1 << 16)


class _Zlib(io.RawIOBase):
    """zlib data as a stream."""

    def __init__(self, raw: io.BufferedReader):
        self.raw, self.d, self.rest = raw, zlib.decompressobj(), b""

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self.d.eof:
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                break
            out = self.d.decompress(data, len(room))
            self.rest = self.d.unconsumed_tail
            if out:
                room[: len(out)] = out
                return len(out)
        return 0


def _windows(data, at: int) -> Iterator[bytes | None]:
    """Overlapping windows of what compressed data hold, through all compressions; None where those do not end."""
    stream, depth = io.BufferedReader(io.BytesIO(bytes(data[at:]))), 0
    try:
        while (inner := _reader(stream)) is not None:
            stream, depth = inner, depth + 1
            if depth > DEEPEST:
                yield None
                return
    except Exception:  # what looked like a start was none
        pass
    before = b""
    while True:
        parts, size = [before], len(before)
        try:
            while size < WINDOW and (one := stream.read1(1 << 16)):
                parts.append(one)
                size += len(one)
            end = size < WINDOW
        except Exception:  # damaged or cut off: what came before counts
            end = True
        whole = b"".join(parts)
        yield whole
        if end:
            return
        before = whole[-OVERLAP:]


def _streamed(data, at: int) -> set[str]:
    """The kinds that compressed data hold, at whatever depth and size."""
    found: set[str] = set()
    for window in _windows(data, at):
        if window is None:
            found.add("packed")
        elif _WORTH.search(window):
            found |= {k for _, k, _ in all_spans(window.decode("utf-8", "replace"))}
            if any(_cut_off(window, m.start()) for m in _COMPRESSED.finditer(window)):
                found.add("packed")
    return found


def _cut_off(window: bytes, at: int) -> bool:
    """Whether compressed data at a place go on behind the window."""
    got = _stream(window, at, IN_MEMORY) if len(window) >= WINDOW else None
    return got is not None and len(got[0]) > 64 and got[1] >= len(window)


def _members(data, at: int, most: int) -> tuple[list[bytes], int] | None:
    """What the members or frames from a place on hold, one after the other, and their end."""
    parts = []
    while (one := _stream(data, at, most)) is not None:
        parts.append(one[0])
        most -= len(one[0])
        at = _NULS.match(data, one[1]).end()
    return (parts, at) if parts else None


def _opened(data, at: int, budget: list[int]) -> tuple[list[bytes], int] | None:
    """Every content of the compressed data at a place, through all compressions, and their end."""
    if (first := _members(data, at, budget[0])) is None:
        return None
    out, work = [], [first[0]]
    budget[0] -= sum(map(len, first[0]))
    while work:
        parts = work.pop()
        whole = b"".join(parts)
        # a later member that is compressed data itself starts inside the whole
        for k, one in enumerate([whole, *parts[1:]]):
            if (inner := _members(one, 0, budget[0])) is not None:
                budget[0] -= sum(map(len, inner[0]))
                work.append([*inner[0], one[inner[1] :]] if inner[1] < len(one) else inner[0])
            elif k == 0:
                out.append(whole)
    return out, first[1]


def _escaped(layer: Layer, budget: list[int], tried: dict) -> tuple[list[Layer], list[tuple[int, str, int]]]:
    """Layers for compressed bytes written as escapes, and as plain characters between those; what streams held."""
    out, told, t = [], [], layer.text
    for mark, magic, run, token in _BYTES:
        if mark not in t:
            continue
        end, done = 0, 0
        for m in magic.finditer(t):
            a = m.start()
            if a < done:
                continue
            if a >= end:
                start, end = a, run.match(t, a).end()
                tokens = [*token.finditer(t, start, end)]
                data = bytes(_byte(x) for x in tokens)
                at = np.fromiter((x.start() for x in tokens), np.int64, len(tokens))
                own = hashlib.sha256(data).digest()
            k = int(np.searchsorted(at, a))
            key = (own, a - start, end - a, *layer.span(a, end))
            if key in tried:
                done = a + tried[key]
                continue
            tried[key] = 0
            try:
                if k == len(at) or at[k] != a or (got := _opened(data, k, budget)) is None:
                    continue
            except OverflowError:
                told += [(a, kind, end) for kind in _streamed(data, k)]
                done = end
                tried[key] = done - a
                continue
            done = int(at[got[1]]) if got[1] < len(at) else end
            tried[key] = done - a
            if not layer.text[a:done].isascii() or mark not in t[a:done]:
                continue
            out += [_whole(layer, x.decode("utf-8", "replace"), a, done) for x in got[0]]
    return out, told


def _byte(token: re.Match) -> int:
    """The byte of an escape or of a plain character."""
    digits, short, plain = token.groups()
    return int(digits.strip("{}"), 16) if digits else _SHORT[short] if short else ord(plain)


def _whole(layer: Layer, text: str, a: int, b: int) -> Layer:
    """A layer each of whose characters comes from all of a range."""
    f, e = np.full(len(text), a), np.full(len(text), b)
    if layer.first is not None and len(text):
        f, e = layer.first[f], layer.last[e - 1]
    return Layer(text, f, e)


def _base64(layer: Layer, budget: list[int], tried: dict) -> tuple[list[Layer], list[tuple[int, str, int]]]:
    """Layers for what each run decodes to, from each of four alignments, and for what is
    compressed in there; what streams held. Runs over several lines are tried as one, too.
    """
    out, told, t = [], [], layer.text
    runs = [(m[0], m.start(), None) for m in _BASE64.finditer(t)]
    for m in _WRAPPED.finditer(t):
        lines = [*_LINE.finditer(t, m.start(), m.end())]
        at = np.concatenate([np.arange(x.start(1), x.end(1)) for x in lines])
        runs.append(("".join(x[1] for x in lines), m.start(), at))
    for run, start, at in runs:
        body, to = run.rstrip("=").translate(_STANDARD), len(run)
        # where a run's characters are in the layer
        place = (lambda i, start=start: start + i) if at is None else at.__getitem__
        a, b = start, int(place(to - 1)) + 1
        key = (run, *layer.span(a, b))
        if key in tried:
            continue
        tried[key] = 0
        for skip in range(4):
            part = body[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            if len(part) < 2:
                continue
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            done = 0
            for m in _COMPRESSED.finditer(data):
                if m.start() < done:
                    continue
                try:
                    if (got := _opened(data, m.start(), budget)) is not None:
                        done = got[1]
                        out += [_whole(layer, x.decode("utf-8", "replace"), a, b) for x in got[0] if _WORTH.search(x)]
                except OverflowError:
                    told += [(a, kind, b) for kind in _streamed(data, m.start())]
                    break
            if not _WORTH.search(data):
                continue
            # a byte that is not UTF-8 is one character, and nothing else is lost for it
            text = data.decode("utf-8", "surrogateescape")
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            sizes[(points >= 0xDC80) & (points < 0xDD00)] = 1
            ends = np.cumsum(sizes)
            f = place(skip + (ends - sizes) * 4 // 3)
            e = place(np.minimum(skip + -(-ends * 4 // 3), len(body)) - 1) + 1
            # the padding belongs to the last character
            e[-1] = max(e[-1], b) if skip + -(-int(ends[-1]) * 4 // 3) >= len(body) else e[-1]
            if layer.first is not None:
                f, e = layer.first[f], layer.last[e - 1]
            out.append(Layer(text, f, e))
    return out, told


def all_spans(text: str, most: int | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of base spans and of those in decoded layers, sorted, each once."""
    found = {(a, k, b) for a, k, b in base_spans(text)}
    budget = [IN_MEMORY if most is None else most]
    # runs by content and place, so that one that several layers show is opened and charged once
    tried: dict[tuple, int] = {}
    work, seen = [Layer(text)], set()
    while work:
        layer = work.pop()
        t = layer.text
        new = [x for x in (_percent(layer) if "%" in t else None, _unicode(layer) if "\\" in t else None) if x is not None]
        inner, no = _base64(layer, budget, tried)
        more, also = _escaped(layer, budget, tried)
        for a, kind, b in (*no, *also):
            i, j = layer.span(a, b)
            found.add((i, _ORDER[kind], j))
        for x in [*new, *inner, *more]:
            if not x.text:
                continue
            # the same content for the same place again: a cycle, or two ways to one layer
            key = hashlib.sha256(x.text.encode("utf-8", "surrogatepass")).digest() + x.first[[0, -1]].tobytes() + x.last[[0, -1]].tobytes()
            if key in seen:
                continue
            seen.add(key)
            work.append(x)
            for a, k, b in base_spans(x.text):
                i, j = x.span(a, b)
                found.add((i, k, j))
    return [(a, _NAMES[k], b) for a, k, b in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch, text_col):
                base = base_spans(text)
                spans = all_spans(text)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined([(a, KINDS[k], b) for a, k, b in base]).encode()).hexdigest(), joined(spans), len(spans)))
            cols = [*zip(*rows, strict=True)] or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

        return f

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, {SCHEMA}")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs with their secrets cut out, whatever layer they lie in; null texts stay null.

    size_col, where given, is set to the new number of characters.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            k = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, s) if (s := all_spans(t)) else t for t in batch.column(k).to_pylist()]
            out = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            if size_col is not None:
                j = batch.schema.get_field_index(size_col)
                old = batch.column(j).to_pylist()
                out = out.set_column(j, batch.schema.field(j), pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], batch.schema.field(j).type))
            return out

        return f

    return map_batches(docs, make, docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return scan(docs)
