"""Secrets in texts and in what is encoded there.

Each text is the first layer of a worklist. A layer is scanned; then its URL and Unicode escapes are unwrapped into further
layers, each with a map back to the text, until nothing new comes up. All that lies inside a base64 run maps to that run, so
no places are kept there: contents are unpacked and scanned as streams, in overlapping pieces, whatever their size.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from readloom.llm.shared import text_slices
from readloom.llm.words import words_of

KINDS = ("assign", "access", "hex")
#: A base64 run with contents of more bytes than this counts in n_large.
MAX_LAYER_BYTES = 64 << 20
PIECE = 1 << 20  # bytes of a stream that are scanned at once
STEP = 1 << 16  # bytes that are unpacked at once
#: Places at which the letters of a run can begin, as other letters may adjoin them.
ALIGNMENTS = 4
LEAST = 12  # bytes of the shortest match
OVERLAP = 64  # more than the fewest characters that make a match, where spaces are single
#: Contents nested deeper, as in archives that hold themselves, aren't opened; their run counts in n_large.
MAX_DEPTH = 50

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_UNICODE_ONE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?|&#(?:[xX]([0-9A-Fa-f]+)|([0-9]+));")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line break, plain or escaped, with the space around.
_BREAK = re.compile(r"[\x20\t]*+(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+")
#: Runs of one or several lines.
_LINES = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)*+={{0,2}}")
_LINES_ON = re.compile(r"[A-Za-z0-9+/_\n-]*")
_KEYWORDS = re.compile(rb"passw(?:or)?d|secret|token|api_?key")
_ENCODED = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx]|&#")


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the plain matches, by kind."""
    found = [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(2, *m.span()) for m in _HEX.finditer(text)]


@dataclass
class Layer:
    """starts, ends: for each character, the span of the document's text that it comes from; None: the text itself."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    trail: str

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with every decodable match replaced; None if there is none."""
    pieces, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        decoded = decode(m[0])
        if decoded is None:
            continue
        changed = True
        for text, a, b, same in ((layer.text[at : m.start()], at, m.start(), True), (decoded, m.start(), m.end(), False)):
            if not text:
                continue
            pieces.append(text)
            own = np.arange(a, b) if layer.starts is None else layer.starts[a:b]
            own_ends = np.arange(a, b) + 1 if layer.starts is None else layer.ends[a:b]
            starts.append(own if same else np.full(len(text), own[0]))
            ends.append(own_ends if same else np.full(len(text), own_ends[-1]))
        at = m.end()
    if not changed:
        return None
    tail = layer.text[at:]
    pieces.append(tail)
    trail = f"{layer.trail}>{name}"
    starts.append(np.arange(at, at + len(tail)) if layer.starts is None else layer.starts[at:])
    ends.append(np.arange(at, at + len(tail)) + 1 if layer.starts is None else layer.ends[at:])
    return Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends), trail)


def _from_url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(run: str) -> str | None:
    def one(m: re.Match) -> str:
        code = int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3])
        return chr(code) if code < 0x110000 else m[0]

    text = _UNICODE_ONE.sub(one, run)
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # joins pairs
    return text if text != run else None


#: How compressed contents begin, with HEAD_BYTES at most.
_HEAD = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9][1\x17]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
HEAD_BYTES = 6
#: How compressed contents begin where their bytes are escaped, in URLs and in string literals.
def _escaped_heads(before: str) -> str:
    """The heads with each byte escaped, by before and two digits, or as it is if it is a visible character."""

    def one(byte: int) -> str:
        digits = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in f"{byte:02x}")
        short = {8: r"|\\b", 0: r"|\\0"}.get(byte, "") if before != "%" else ""
        return f"(?:{before}{digits}{short}{'|' + re.escape(chr(byte)) if 33 <= byte < 127 else ''})"

    heads = [b"\x1f\x8b\x08", b"x\x01", b"x\x9c", b"x\xda", b"\xfd7zXZ\0", b"\x28\xb5\x2f\xfd"]
    spell = lambda h: "".join(map(one, h))
    return "|".join([*map(spell, heads), f"{spell(b'BZh')}(?:{before}3[1-9]|[1-9]){spell(b'1AY')}{'%26' if before == '%' else spell(b'&')}{spell(b'SY')}"])


_ESCAPED_HEAD = re.compile(rf"(?P<url>{_escaped_heads('%')})|{_escaped_heads(r'\\(?:x|u00)')}".encode())
_URL_RUN = re.compile(rb"(?:%[0-9A-Fa-f]{2}|[^%\s\"<>])*")
_LITERAL_RUN = re.compile(rb"(?:\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|[abfnrtv0/\\'\"])|[^\\\r\n])*")
#: By the quote before a run: it goes on to the next one, or to white space or any quote if there is none.
_LITERAL_RUNS = {q: re.compile(_LITERAL_RUN.pattern.replace(rb"\r\n]", stop + rb"\r\n]")) for q, stop in ((b'"', b'"'), (b"'", b"'"), (b"", rb"\s\"'"))}
_LITERAL_ESCAPE = re.compile(rb"\\(?:(?:x|u00)([0-9A-Fa-f]{2})|(.))")
_SHORT = dict(zip(b"abfnrtv0", b"\a\b\f\n\r\t\v\0"))
_LONGEST_HEAD = 48  # bytes
_UNPACK_ERRORS = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError)
_HEADS = (b"passw", b"secret", b"token", b"api")  # of keywords
_MARKS = re.compile(rb"AKIA|%[0-9A-Fa-f]{2}|\\[uUx]|&#|" + _HEAD.pattern)
_LONG = re.compile(rb"[A-Za-z0-9+/_-]{16}")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_CODE = _LETTERS + "=%&#;\\{}\r\n"  # what runs and escapes are made of
_BEGUN_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]?|\\(?:[uUx]\{?[0-9A-Fa-f]{0,7})?|&(?:#[xX]?[0-9A-Fa-f]{0,7})?)\Z")
_SPACES = re.compile(r"\x20{2,}")
_STANDARD = str.maketrans("-_", "+/", "=\n")


def _member(head: bytes):
    """A decompressor for contents that begin so, and the format's name."""
    if head[:1] in b"\x1fx":
        return zlib.decompressobj(47), "gzip" if head[:1] == b"\x1f" else "zlib"
    if head[:1] == b"B":
        return bz2.BZ2Decompressor(), "bz2"
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor(), "xz"
    return zstandard.ZstdDecompressor().decompressobj(), "zstd"


def _unpack(member, name: str, data: bytes, out) -> bytes | None:
    """Hands what data unpacks to, in bounded steps, to out. The bytes after the end, or None if the end is yet to come."""
    if name == "zstd":
        for i in range(0, len(data), 256):  # a few bytes can stand for 128 KB
            out(member.decompress(data[i : i + 256]))
            if member.eof:
                return member.unused_data + data[i + 256 :]
        return None
    while True:
        if name in ("gzip", "zlib"):
            got = member.decompress(data, STEP)
            data = member.unconsumed_tail
            more = data or len(got) == STEP
        else:
            got, data = member.decompress(data, STEP), b""
            more = not member.eof and not member.needs_input
        out(got)
        if member.eof:
            return member.unused_data
        if not more:
            return None


def _escaped_bytes(run: bytes, url: bool) -> bytes:
    if url:
        return unquote_to_bytes(run.replace(b"+", b" "))
    return _LITERAL_ESCAPE.sub(lambda m: bytes.fromhex(m[1].decode()) if m[1] else bytes([_SHORT.get(m[2][0], m[2][0])]), run)


def _escaped_packed(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bool]]:
    """start and end of the escaped runs that begin like compressed contents, and whether they are escaped as in URLs."""
    while m := _ESCAPED_HEAD.search(data, at):
        url = m["url"] is not None
        before = data[max(0, m.start() - 1) : m.start()]
        at = (_URL_RUN if url else _LITERAL_RUNS.get(before, _LITERAL_RUNS[b""])).match(data, m.start()).end()
        yield m.start(), at, url


class _Found:
    """trails: the layers through which each kind was found in a run; large: whether some contents are."""

    def __init__(self, limit: int):
        self.limit, self.trails, self.large = limit, {}, False


class _Stream:
    """Bytes inside a run, of any number. Pieces end outside of runs and escapes; a run of more than half a piece is handed
    on in parts."""

    def __init__(self, trail: str, found: _Found):
        self.trail, self.found, self.total = trail, found, 0
        self.closed = trail.count(">") > MAX_DEPTH
        self.new, self.rest, self.before = bytearray(), "", ""
        self.unsearched, self.packed = b"", None
        self.unread, self.literal = b"", None
        self.escapes: dict[str, _Stream] = {}
        self.run: _Run | None = None
        found.large |= self.closed

    def inner(self, name: str) -> _Stream:
        return _Stream(f"{self.trail}>{name}", self.found)

    def feed(self, data: bytes) -> None:
        if self.closed or not data:
            return
        self.total += len(data)
        self.found.large |= self.total > self.found.limit
        if not self.trail.endswith(("url", "unicode")):  # those are texts; compressed bytes only look like escapes
            self._search(data)
        self._search_escaped(data)
        self.new += data
        if len(self.new) + len(self.rest) >= PIECE:
            self._pass(last=False)

    def close(self) -> None:
        if not self.closed:
            if self.packed:
                self._search(b"", last=True)
            self._search_escaped(b"", last=True)
            self._pass(last=True)
            for x in [*self.escapes.values(), *(self.packed or [])[2:]]:
                x.close()

    def _search(self, data: bytes, last: bool = False) -> None:
        """Unpacks compressed contents wherever they begin; members that follow one another are one content."""
        data, at, begin = self.unsearched + data, 0, -1
        self.unsearched = b""
        while True:
            if self.packed is None:
                m = _HEAD.search(data, at)
                if m is None:
                    self.unsearched = data[max(at, len(data) - HEAD_BYTES + 1) :]
                    return
                at = begin = m.start()
                member, name = _member(m[0])
                self.packed = [member, name, self.inner(name)]
            member, name, inner = self.packed
            if member is None:  # between two members of one content
                at = max(at, len(data) - len(data[at:].lstrip(b"\0")))  # padding
                head = data[at : at + 8]
                skipped = head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5  # a frame of zstd without content
                size = 8 + int.from_bytes(head[4:], "little") if skipped and len(head) == 8 else 8
                if len(head) < 8 and not last or skipped and at + size > len(data) and size <= PIECE and not last:
                    self.unsearched = data[at:]
                    return
                if skipped and at + size <= len(data):
                    at += size
                    continue
                if not _HEAD.match(data, at):
                    inner.close()
                    self.packed = None
                    continue
                begin = at
                self.packed[:2] = member, name = _member(head)
            try:
                left = _unpack(member, name, data[at:], inner.feed)
            except _UNPACK_ERRORS:
                at = begin + 1
            else:
                if left is None:
                    return
                at = len(data) - len(left)
                self.packed[0] = None
                continue
            inner.close()
            self.packed = None

    def unpack(self, data: bytes, last: bool) -> None:
        """Searches data for compressed contents alone."""
        if self.closed:
            return
        for at in range(0, len(data), STEP):
            self._search(data[at : at + STEP])
        if last and self.packed:
            self._search(b"", last=True)
        if last and self.packed:
            self.packed[2].close()

    def _search_escaped(self, data: bytes, last: bool = False) -> None:
        """Unpacks compressed contents whose bytes are escaped."""
        data, at = self.unread + data, 0
        while True:
            if self.literal is None:
                m = _ESCAPED_HEAD.search(data, at)
                if m is None:
                    self.unread = data[max(at, len(data) - _LONGEST_HEAD) :]
                    return
                at, url = m.start(), m["url"] is not None
                self.literal = url, self.inner("url" if url else "unicode")
            url, inner = self.literal
            end = (_URL_RUN if url else _LITERAL_RUN).match(data, at).end()
            over = last or len(data) - end >= 12  # else an escape may have begun
            inner.unpack(_escaped_bytes(data[at:end], url), over)
            at = end
            if not over:
                self.unread = data[end:]
                return
            self.literal = None

    def _end(self, text: str) -> int:
        """How much of text can be passed on, the rest being kept until more is known."""
        least = len(text) // 2
        end = len(text.rstrip(" ").rstrip(_CODE))
        if end >= least:
            return end
        end = len(text.rstrip(" \r\n\\"))
        start = len(text[:end].rstrip(_LETTERS + "\n"))
        end = start if start >= least else end
        if m := _BEGUN_ESCAPE.search(text, max(0, end - 12), end):
            end = m.start()
        return end if end >= least else len(text)

    def _pass(self, last: bool) -> None:
        text = _SPACES.sub(" ", _BREAK.sub("\n", self.rest + self.new.decode("latin-1")))
        self.new.clear()
        end = len(text) if last else self._end(text)
        text, self.rest = text[:end], text[end:]
        piece = self.before + text
        for kind in _kinds(piece):
            self.found.trails.setdefault(kind, self.trail)
        for name, pattern, decode in (("url", _URL, _url_bytes), ("unicode", _UNICODE, _unicode_bytes)):
            inner = self.escapes.get(name)
            if inner is None and pattern.search(text):
                inner = self.escapes[name] = self.inner(name)
                inner.feed(self.before.encode("latin-1"))
            if inner is not None:
                inner.feed(pattern.sub(decode, text).encode("latin-1"))
        self.before = piece[-OVERLAP:]
        at = 0
        if self.run is not None:
            at = _LINES_ON.match(text).end()
            self.run.feed(text[:at])
            if last or at < len(text):
                self.run.close()
                self.run = None
        for m in _LINES.finditer(text, at):
            if m.end() == len(text) and not last:
                self.run = _Run(f"{self.trail}>base64", self.found)
                self.run.feed(m[0])
            else:
                _scan_run(m[0], f"{self.trail}>base64", self.found)


def _url_bytes(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def _unicode_bytes(m: re.Match) -> str:
    codes = (int(x[1] or x[2], 16) if x[1] or x[2] else int(x[3]) for x in _UNICODE_ONE.finditer(m[0]))
    return "".join(chr(c) if c < 256 else "?" for c in codes)  # no other letters are in secrets


def _has_keyword(data: bytes) -> bool:
    data = data.lower()
    return any(x in data for x in _HEADS)


def _kinds(piece: str) -> Iterator[int]:
    """The kinds that matches() finds."""
    if _has_keyword(piece.encode("latin-1")) and any(len(m[2]) >= 6 for m in _ASSIGN.finditer(piece)):
        yield 0
    if any(len(m[0]) >= 20 for m in _ACCESS.finditer(piece)):
        yield 1
    if _HEX.search(piece):
        yield 2


def _base64_bytes(letters: str) -> bytes:
    n = len(letters) - (len(letters) % 4 == 1)
    return base64.b64decode(letters[:n] + "=" * (-n % 4))


class _Run:
    """A base64 run that comes in parts."""

    def __init__(self, trail: str, found: _Found):
        self.inner = [_Stream(trail, found) for _ in range(ALIGNMENTS)]
        self.skip, self.left = [*range(ALIGNMENTS)], [""] * ALIGNMENTS

    def feed(self, letters: str) -> None:
        letters = letters.translate(_STANDARD)
        for i, inner in enumerate(self.inner):
            part = self.left[i] + letters
            skip = min(self.skip[i], len(part))
            self.skip[i] -= skip
            n = skip + (len(part) - skip) // 4 * 4
            self.left[i] = part[n:]
            for at in range(skip, n, STEP):
                inner.feed(base64.b64decode(part[at : min(n, at + STEP)]))

    def close(self) -> None:
        for inner, left in zip(self.inner, self.left):
            inner.feed(_base64_bytes(left))
            inner.close()


def _scan_run(letters: str, trail: str, found: _Found) -> None:
    letters = letters.translate(_STANDARD)
    for skip in range(ALIGNMENTS):
        data = _base64_bytes(letters[skip:])
        if len(data) >= LEAST and (_has_keyword(data) or _MARKS.search(data) or _LONG.search(data)):
            inner = _Stream(trail, found)
            for at in range(0, len(data), STEP):
                inner.feed(data[at : at + STEP])
            inner.close()


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end and letters of the base64 runs, in one line and across lines."""
    for m in _LINES.finditer(text):
        for run in _BASE64.finditer(text, *m.span()):
            yield run.start(), run.end(), run[0]
        joined = _BREAK.sub("", m[0])
        if len(joined) < len(m[0]):
            yield m.start(), m.end(), joined


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers one step inside whose characters have places of their own."""
    if "%" in layer.text and (x := _replaced(layer, _URL, _from_url, "url")):
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _replaced(layer, _UNICODE, _from_unicode, "unicode")):
        yield x


def scan_text(text: str, limit: int = MAX_LAYER_BYTES) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], str], int]:
    """The base matches; all spans (kind, start, end) with the layers that each was found through; the number of base64 runs
    with contents of more than limit bytes, which are scanned as all others, or nested more than MAX_DEPTH times."""
    base = sorted(matches(text), key=lambda x: (x[1], x[0]))
    found = {x: "" for x in base}
    seen, work, large = {text}, [Layer(text, None, None, "")], set()
    while work:
        layer = work.pop()
        if layer.trail:
            for kind, a, b in matches(layer.text):
                found.setdefault((kind, *layer.span(a, b)), layer.trail[1:])
        for a, b, letters in _runs(layer.text):
            inside, span = _Found(limit), layer.span(a, b)
            _scan_run(letters, f"{layer.trail}>base64", inside)
            for kind, trail in inside.trails.items():
                found.setdefault((kind, *span), trail[1:])
            if inside.large:
                large.add(span)
        if "%" in layer.text or "\\" in layer.text:
            data = layer.text.encode("latin-1", "replace")  # a byte for each character
            for a, b, url in _escaped_packed(data):
                inside, span = _Found(limit), layer.span(a, b)
                _Stream(f"{layer.trail}>{'url' if url else 'unicode'}", inside).unpack(_escaped_bytes(data[a:b], url), True)
                for kind, trail in inside.trails.items():
                    found.setdefault((kind, *span), trail[1:])
                if inside.large:
                    large.add(span)
        for x in _inner(layer):
            if x.text not in seen:  # else the layers would go round
                seen.add(x.text)
                work.append(x)
    return base, found, len(large)


def _suspects(rows: pa.Table) -> np.ndarray:
    """Which texts can hold anything: a keyword, an access key's head, an escape, or a long run of base64 or hex letters."""
    w = words_of(rows.column("text"))
    between = w.offsets[1:-1]
    buf = np.insert(w.buf, between, 10)  # no run, keyword or escape goes on from one text to the next
    begin = w.offsets[:-1] + np.arange(rows.num_rows)
    ok = np.zeros(256, np.int8)
    ok[[*_LETTERS.encode()]] = 1
    edges = np.flatnonzero(np.diff(ok[buf], prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    data = buf.tobytes()
    at = [m.start() for m in _KEYWORDS.finditer(data.lower())] + [m.start() for m in _ENCODED.finditer(data)]
    out = np.zeros(rows.num_rows, bool)
    for found in (starts[ends - starts >= 16], np.array(at, np.int64)):
        out[np.searchsorted(begin, found, "right") - 1] = True
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string()), ("base", pa.bool_())]))


def _scan(limit: int, mask: str | None, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, "text"):
            texts, spans, large = rows.column("text").to_pylist(), [], []
            for i, suspect in enumerate(_suspects(rows).tolist()):
                if not suspect:
                    spans.append([])
                    large.append(0)
                    continue
                base, found, n = scan_text(texts[i], limit)
                base = set(base)
                order = sorted(found, key=lambda x: (x[1], x[0], x[2]))
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "layers": found[k, a, b], "base": (k, a, b) in base} for k, a, b in order])
                large.append(n)
                if mask is not None and order:
                    texts[i] = redacted(texts[i], [(a, b) for _, a, b in order], mask)
            if mask is not None:
                at = rows.column_names.index("text")
                rows = rows.set_column(at, "text", pa.array(texts, pa.string()))
                yield from rows.select(keep).to_batches()
            else:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(spans, _SPANS), pa.array(large, pa.int64())], ["doc_id", "spans", "n_large"])


def redacted(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_LAYER_BYTES) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, end exclusive, the layers it was found through, and whether it is a
    match in the plain text), by start and kind, and n_large (base64 runs with contents of more than limit bytes, which are scanned as all others, or nested more
    than MAX_DEPTH times).

    A null text counts as empty. Repeated rows are scanned each; other columns are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,layers:string,base:boolean>>, n_large long"
    return rows.mapInArrow(lambda it: _scan(limit, None, [], it), schema)


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text", limit: int = MAX_LAYER_BYTES) -> DataFrame:
    """docs with every span that scan() finds replaced by mask in the column text; all else stays. A text without spans,
    null included, stays as it is."""
    if text != "text" and "text" in docs.columns:
        raise ValueError("another column is called text")
    rows = docs.withColumnRenamed(text, "text")
    names = rows.columns
    out = rows.mapInArrow(lambda it: _scan(limit, mask, names, it), rows.schema)
    return out.withColumnRenamed("text", text)
