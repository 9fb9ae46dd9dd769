"""Secret scans through nested encodings: a worklist of decoded layers per document, every layer rescanned."""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkwell.llm.stash import small_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: One percent, Unicode, byte or HTML escape.
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: The longest escape, and the characters that one begins with.
_LONGEST, _LEADS = 11, frozenset("%\\&")
#: A base64 token, with the lines below it that a single line end joins to it.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
#: A short first line of a token that begins in the middle of its line.
_ABOVE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{1,15})\r?\n\Z")
_LINE = re.compile(r"[^\r\n]+")
#: How gzip, zlib, bz2 and xz begin, as bytes and in base64.
_MAGIC = (b"\x1f\x8b", b"\x78", b"BZh", b"\xfd7zXZ")
_PACKED = re.compile(rb"H4s|e[A-P]|Ql|[/_]T")
#: Texts in which none of the patterns above can begin are skipped by one linear pass in Arrow.
_MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux]|&#|[A-Za-z0-9+/_-]{16}"""
#: Decompressed layers are read in windows of this many bytes, one at a time, that overlap by OVERLAP. A token without
#: white space that a border would cut is held back until it ends, or has HELD bytes: then it goes on in a next window,
#: from a place that keeps the alignment of base64 (of GROUP characters, so of nested base64, too), and packed bytes in
#: it are unpacked as they come. So memory is bounded by these, the document, and the dictionary of an xz layer as far
#: as the layer fills it.
WINDOW, OVERLAP, HELD, GROUP = 1 << 20, 1 << 16, 8 << 20, 4**6
_TOKEN = bytes(i for i in range(33, 127)) + b"\r\n"
_BASE64_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"
_STANDARD = bytes.maketrans(b"-_", b"+/")
_ENDS = re.compile(rb"[\r\n]+")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in a text as it is."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Places:
    """Where the characters of a layer stand in the document: pieces that begin at `at`.

    A piece with last < 0 is copied: its characters stand one by one from `first` on. Any other piece stands as a whole
    for first to last. Layers of layers are mapped to the document at once, so that no chain of maps grows.
    """

    def __init__(self) -> None:
        self.at, self.first, self.last = array("q"), array("q"), array("q")

    @classmethod
    def copied(cls) -> Places:
        return cls().add(0, 0, -1)

    @classmethod
    def whole(cls, first: int, last: int) -> Places:
        return cls().add(0, first, last)

    def add(self, at: int, first: int, last: int) -> Places:
        if not self.at or last < 0 or self.first[-1] != first or self.last[-1] != last:
            self.at.append(at)
            self.first.append(first)
            self.last.append(last)
        return self

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a = self.first[i] + (start - self.at[i] if self.last[i] < 0 else 0)
        return a, self.first[j] + end - self.at[j] if self.last[j] < 0 else self.last[j]

    def copy_into(self, new: Places, at: int, start: int, end: int) -> None:
        """Adds the pieces of [start, end) of this layer to a new one, from its place `at` on."""
        if start >= end:
            return
        i = bisect.bisect_right(self.at, start) - 1
        while i < len(self.at) and (i < 0 or self.at[i] < end):
            here = max(start, self.at[i])
            new.add(at + here - start, self.first[i] + (here - self.at[i] if self.last[i] < 0 else 0), self.last[i])
            i += 1


def _unwrapped(text: str, m: re.Match) -> tuple[int | str | None, int]:
    """(byte of a percent escape, character of another one, or None if there is none such; its end in the text).

    What unwraps to the beginning of another escape is unwrapped on at once, so that a nest of them is one step.
    """
    end = m.end()
    while True:
        if m[1]:
            value: int | str | None = int(m[1], 16)
            plain = chr(value)
        else:
            code = int(m[6]) if m[6] else int(m[2] or m[3] or m[4] or m[5], 16)
            if code >= 0x110000 or 0xD800 <= code < 0xE000:
                return None, end
            value = plain = chr(code)
        more = _ESCAPE.match(plain + text[end : end + _LONGEST]) if plain in _LEADS else None
        if more is None:
            return value, end
        m, end = more, end + more.end() - 1


def _escaped(text: str, places: Places) -> tuple[str, Places] | None:
    """The text with percent, Unicode and HTML escapes resolved, and its places."""
    out, new, upto, size = [], Places(), 0, 0
    m = _ESCAPE.search(text)
    while m:
        start = m.start()
        value, end = _unwrapped(text, m)
        if isinstance(value, int):  # bytes that stand side by side are decoded together
            raw = bytearray([value])
            while (m := _ESCAPE.match(text, end)) and isinstance((following := _unwrapped(text, m))[0], int):
                raw.append(following[0])
                end = following[1]
            value = raw.decode("utf-8", "replace")
        if value is not None:
            places.copy_into(new, size, upto, start)
            size += start - upto
            out += [text[upto:start], value]
            new.add(size, *places.span(start, end))
            size += len(value)
            upto = end
        m = _ESCAPE.search(text, end)
    if not out:
        return None
    places.copy_into(new, size, upto, len(text))
    return "".join([*out, text[upto:]]), new


def _texts(data: bytes) -> Iterator[str]:
    """Bytes as UTF-8, those that are not kept as surrogates; with NUL among them also as UTF-16."""
    yield data.decode("utf-8", "surrogateescape")
    if b"\0" in data:
        yield data.decode("utf-16-le", "replace")
        yield data.decode("utf-16-be", "replace")


class _Carried:
    """Packed bytes whose base64 comes in parts: each part is unpacked as far as it goes, and the state is kept for the next."""

    def __init__(self) -> None:
        self.parts: deque[bytes] = deque()
        self.open, self.ended = True, False
        self.texts = _windows(_inflated(self._bytes()))

    def _bytes(self) -> Iterator[bytes | None]:
        rest = b""
        while True:
            if self.parts:
                chars = rest + self.parts.popleft().translate(_STANDARD, b"\r\n")
                n = len(chars) // 4 * 4
                rest = chars[n:]
                if n:
                    yield base64.b64decode(chars[:n])
            elif self.ended:
                if len(rest) > 1:
                    yield base64.b64decode(rest + b"=" * (-len(rest) % 4))
                return
            else:
                yield None  # until there is more

    def read(self, part: bytes, start: int = 0) -> Iterator[str]:
        """The texts that part[start:] completes."""
        for some in _parts(part, start):
            self.parts.append(some)
            for t in self.texts:
                if t is None:
                    break
                yield t
            else:
                self.open = False
                return

    def end(self) -> Iterator[str]:
        self.ended = True
        yield from (t for t in self.texts if t is not None)


def _parts(data: bytes, start: int) -> Iterator[bytes]:
    """data[start:] in slices that grow, as most of what looks packed is not."""
    size = 256
    while start < len(data):
        yield data[start : start + size]
        start, size = start + size, min(2 * size, 1 << 16)


def _carried_from(part: bytes, starts: list[int]) -> Iterator[str | _Carried]:
    """The texts that packed bytes at these places of a part of a token have, and those that may go on."""
    for x in starts:
        if len(part) - x < 3 or _PACKED.match(part, x):
            one = _Carried()
            yield from one.read(part, x)
            if one.open:
                yield one


def _windows(chunks: Iterator[bytes | None]) -> Iterator[str | None]:
    """Decoded text in overlapping windows of bounded size; a token at the border comes whole in a later one, or in parts when it is too long.

    A chunk of None, which says that more comes later, is handed on.
    """
    tail, held, parted, after_end = b"", False, False, False
    carried: list[_Carried] = []

    def begin(part: bytes, starts: list[int]) -> Iterator[str]:
        for x in _carried_from(part, starts):
            if isinstance(x, str):
                yield x
            else:
                carried.append(x)

    for c in chunks:
        if c is None:
            yield None
            continue
        if parted:
            inside = c[: len(c) - len(c.lstrip(_BASE64_BYTES))]
            for one in carried:
                yield from one.read(inside)
            carried[:] = [one for one in carried if one.open]
            yield from begin(inside, [0] * (after_end and bool(inside)) + [m.end() for m in _ENDS.finditer(inside) if m.end() < len(inside)])
            after_end = inside[-1:] in (b"\r", b"\n")
            if len(inside) < len(c):
                for one in carried:
                    yield from one.end()
                parted = False
                carried.clear()
        block = tail + c
        at = len(block.rstrip(_TOKEN))
        held = len(block) - at > OVERLAP
        if held and len(block) - at <= HELD:
            if at > OVERLAP or not tail:
                yield from _texts(block[:at])
            tail = block[max(0, at - OVERLAP) :]
            continue
        yield from _texts(block)
        cut = max(0, len(block) - OVERLAP)
        if held:
            first = len(block.rstrip(_BASE64_BYTES))
            cut = max(first, cut)
            extra = len(block[first:cut].translate(None, b"\r\n")) % GROUP  # keep whole groups of base64 characters together
            while cut > first and (extra or block[cut : cut + 1] in (b"\r", b"\n")):
                cut -= 1
                extra -= block[cut] not in (10, 13)
            if not parted and first < len(block):
                parted, after_end = True, block[-1] in (10, 13)
                yield from begin(block, [first] + [m.end() for m in _ENDS.finditer(block, first) if m.end() < len(block)])
        tail, held = block[cut:], False
    if held:
        yield from _texts(tail)
    for one in carried:
        yield from one.end()


def _inflated(chunks: Iterator[bytes | None]) -> Iterator[bytes | None]:
    """What compressed bytes hold, all members of them one after another, WINDOW bytes at a time; None is handed on."""
    makers = (lambda: zlib.decompressobj(31), zlib.decompressobj, bz2.BZ2Decompressor, lzma.LZMADecompressor)
    rest, source, over = b"", iter(chunks), False
    while True:
        while len(rest) < 5 and not over:
            if (more := next(source, b"")) is None:
                yield None
            elif more:
                rest += more
            else:
                over = True
        make = next((make for magic, make in zip(_MAGIC, makers, strict=True) if rest.startswith(magic)), None)
        if make is None:
            return
        d = make()
        try:
            while not d.eof:
                block = d.decompress(rest, WINDOW)
                rest = getattr(d, "unconsumed_tail", b"")
                if block:
                    yield block
                elif not d.eof and not rest and getattr(d, "needs_input", True):
                    if (more := next(source, b"")) is None:
                        yield None
                    elif more:
                        rest = more
                    else:
                        return
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        rest = d.unused_data.lstrip(b"\0")


def _decoded(token: str) -> bytes:
    body = token.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _unpacked(data: bytes, start: int = 0) -> Iterator[str]:
    """The texts that packed bytes from a place on hold."""
    if data.startswith(_MAGIC, start):
        yield from _windows(_inflated(_parts(data, start)))  # type: ignore[misc]


def _line_places(plain: str, read: list[tuple[int, int]], places: Places) -> Places:
    """Places of the text of a token over several lines: for every character the lines that hold its bytes."""
    begins = list(itertools.accumulate((b - a for a, b in read[:-1]), initial=0))
    # byte n takes characters n // 3 * 4 + n % 3 and the next one of the token; the first byte of every line, and who lies over its end
    first = np.array([x // 4 * 3 + min(x % 4, 3) for x in begins])
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    alone = (codes >= 0xDC80) & (codes <= 0xDCFF)
    size = np.where(alone | (codes < 0x80), 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    ends = np.cumsum(size)
    last = ends - 1
    start_line = np.searchsorted(first, ends - size, "right") - 1
    end_line = np.searchsorted(np.array(begins), last // 3 * 4 + last % 3 + 1, "right") - 1
    pair = start_line * len(read) + end_line
    out = Places()
    for i in np.flatnonzero(np.diff(pair, prepend=-1)).tolist():
        out.add(i, *places.span(read[start_line[i]][0], read[end_line[i]][1]))
    return out


def _tokens(layer: str, places: Places) -> Iterator[tuple[str, Places]]:
    """What the base64 tokens of a layer hold, with its places; one text at a time.

    Every line of a token over several lines is read alone, too. The whole is decoded once for each alignment, from the
    first line that has it; packed bytes may begin at any line, as what stands above may not belong to them, and are
    sought in what is decoded already. Unpacked text maps to all lines read, plain text to those that hold it.
    """
    for m in _BASE64.finditer(layer):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        above = _ABOVE.search(layer, max(0, m.start() - 18), m.start())
        if above:
            lines.insert(0, above.span(1))

        def texts(data: bytes, read: list[tuple[int, int]]) -> Iterator[tuple[str, Places]]:
            whole = Places.whole(*places.span(read[0][0], read[-1][1]))
            for inner in itertools.chain(_unpacked(data), itertools.islice(_texts(data), 1, None)):
                yield inner, whole
            plain = data.decode("utf-8", "surrogateescape")
            yield plain, whole if len(read) == 1 or not plain else _line_places(plain, read, places)

        for x in lines:
            if x[1] - x[0] >= 16:
                yield from texts(_decoded(layer[x[0] : x[1]]), [x])
        if len(lines) > 1:
            joined, begin = "".join(layer[a:b] for a, b in lines), 0
            firsts: dict[int, tuple[int, bytes]] = {}
            for k, (a, b) in enumerate(lines[:-1]):
                if begin % 4 not in firsts:
                    firsts[begin % 4] = begin, _decoded(joined[begin:])
                    yield from texts(firsts[begin % 4][1], lines[k:])
                else:
                    at, data = firsts[begin % 4]
                    for inner in _unpacked(data, (begin - at) // 4 * 3):
                        yield inner, Places.whole(*places.span(a, lines[-1][1]))
                begin += b - a


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the text as it is, spans of every layer mapped to the text), each sorted.

    The worklist holds layers that are open: the text itself, then what escapes, base64 tokens and compressed tokens
    unwrap to. The texts inside a layer are made one by one as the list comes back to it; when none is left, the layer
    gives way to itself with its escapes resolved. A layer that has been seen in the same place is not unwrapped again,
    so cycles end. Escapes map span by span; what a base64 token holds maps to the token, or to those of its lines that
    hold it. Nothing is called in itself, so no depth of layers is too much.
    """
    base = scan(text)
    found, seen = set(base), set()
    work: list[tuple[str, Places, Iterator[tuple[str, Places]]]] = []

    def open_layer(layer: str, places: Places) -> None:
        key = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), places.span(0, max(1, len(layer))))
        if layer and key not in seen:
            seen.add(key)
            if work or seen != {key}:
                found.update((k, *places.span(a, b)) for k, a, b in scan(layer))
            work.append((layer, places, _tokens(layer, places)))

    open_layer(text, Places.copied())
    while work:
        layer, places, inside = work[-1]
        inner = next(inside, None)
        if inner is not None:
            open_layer(*inner)
            continue
        work.pop()
        plain = _escaped(layer, places)
        if plain and plain[0] != layer:
            open_layer(*plain)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order)


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones joined) replaced by a marker."""
    out, at, upto = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= upto:
            out += [text[at:a], "[secret]"]
        upto = max(upto, b)
        at = upto
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_assign, n_access, n_hex (secrets standing as they are), base_spans, spans (all) and redacted.

    spans are strings kind:start:end in code points, comma-joined by start, then kind. A null text counts as empty:
    no spans, and redacted stays null. Rows are scanned one by one, so repeated rows get equal spans; a text is scanned
    whole however long, with bounded memory beyond it for packed layers; an empty table gives an empty result. Columns
    called as the new ones are replaced, all others stay. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted")
    names = docs.schema.names
    schema = docs.selectExpr("*", "0L n_assign", "0L n_access", "0L n_hex", "'' base_spans", "'' spans", f"`{text}` redacted").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            counts = {k: [0] * n for k in KINDS}
            bases, spans, red = [""] * n, [""] * n, texts.to_pylist()
            for i in maybe.nonzero()[0].tolist():
                own, every = all_spans(red[i])
                for k, _, _ in own:
                    counts[k][i] += 1
                bases[i], spans[i], red[i] = spelled(own), spelled(every), redact(red[i], every)
            new = [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(x, pa.string()) for x in (bases, spans, red)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names=schema.names)

    return docs.mapInArrow(run, schema)
