"""Secret scans with a recursive decoding worklist.

The text is scanned as it is. Every layer that a decoder makes out of a layer
(percent escapes, Unicode escapes, base64, compressed bytes) joins the worklist
until nothing new appears; a layer seen before is not taken apart again. Finds in a
decoded layer are mapped back to every span of the text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ESCAPES = re.compile(rb"%u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};")
PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
#: Where compressed streams may begin inside a layer, and what may stand between them.
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
SKIPPED = re.compile(rb"\x00*")
#: The shortest secret or encoded run has 12 bytes.
PRINTABLE = re.compile(rb"[\t\r\n\x20-\x7e]{12}")
#: ASCII in two or four bytes a character, either end first.
WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}|(?:\x00[\t\r\n\x20-\x7e]){12,}|(?:[\t\r\n\x20-\x7e]\x00\x00\x00){12,}|(?:\x00\x00\x00[\t\r\n\x20-\x7e]){12,}")
#: Base64 over several lines, whose breaks may be written out. It begins where a run does and takes runs whole, so that the time is in proportion to the text.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAK, LETTERS = re.compile(rb"\r?\n[ \t]*|(?:\\r)?\\n[ \t]*"), re.compile(rb"[^ ]+")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: Decompressed bytes that are held and scanned at once, those of the piece before that are scanned again, and those taken of one text in all, against bombs.
PIECE, OVERLAP, MAX_TOTAL = 1 << 24, 1 << 16, 1 << 30
#: A layer gives way to others that wait when it has taken this part of what a text may give.
TURNS = 8

Map = Callable[[int, int], tuple[int, int]]


def scan(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in bytes, leftmost and non-overlapping for each kind.

    A match that is too short takes its place from later ones before it is
    dropped. For access and hex a run that is too short holds no longer
    one, so that the lengths can stand in the pattern.
    """
    low, places = data.lower(), []
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            places.append(at)
            at = low.find(word, at + 1)
    end = 0
    for at in sorted(places):
        if at >= end and (m := ASSIGN.match(data, at)):
            end = m.end()
            if len(m[2]) >= 6:
                yield "assign", at, end
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(data):
            yield kind, m.start(), m.end()


def _replaced(data: bytes, pattern: re.Pattern, decode: Callable[[bytes], bytes]) -> tuple[bytes, Map] | None:
    """The data with every match decoded, and the way back."""
    out, made, source, size, last = [], [0], [0], 0, 0
    for m in pattern.finditer(data):
        got = decode(m[0])
        if got == m[0]:
            continue
        size += m.start() - last
        out += [data[last : m.start()], got]
        made += [size, size + len(got)]
        source += [m.start(), m.end()]
        size, last = size + len(got), m.end()
    if not out:
        return None
    out.append(data[last:])

    def back(start: int, end: int) -> tuple[int, int]:
        # even segments are copied, odd ones are matches, which count whole
        i, j = bisect_right(made, start) - 1, bisect_right(made, end - 1) - 1
        first = source[i] if i % 2 else source[i] + start - made[i]
        stop = source[j + 1] if j % 2 else source[j] + end - made[j]
        return first, stop

    return b"".join(out), back


def _unescape(found: bytes) -> bytes:
    if found[:1] == b"&":
        return html.unescape(found.decode()).encode("utf-8", "surrogatepass")
    point = int(found[2:].strip(b"{}"), 16)
    return chr(point).encode("utf-8", "surrogatepass") if point < 0x110000 else found


def _text_like(data: bytes) -> bool:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.9 * len(text)


class Budget:
    """Decompressed bytes that a text may still give, and those that a layer takes in one turn."""

    def __init__(self, left: int) -> None:
        self.left, self.cut_off = left, False
        self.turn = max(1, left // TURNS)
        self.piece = min(PIECE, self.turn)


def _stream(data: bytes, at: int, budget: Budget) -> Iterator[tuple[bytes, int, bool]]:
    """What the compressed stream at ``at`` gives, as far as it can be read: each part, where the reading stands then, and whether that is its end."""
    head, size = data[at : at + 3], 4096
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        tool = zlib.decompressobj(47)
    elif head == b"BZh":
        tool = bz2.BZ2Decompressor()
    elif head[:2] == b"\xfd7":
        tool = lzma.LZMADecompressor(memlimit=1 << 27)
    else:
        # it can't be held at a number of bytes, so that it gets little at once
        tool, size = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), 256
    rest = b""
    while not tool.eof:
        full = not rest and not getattr(tool, "needs_input", True)  # what was read gives more yet
        piece = b"" if full else rest or data[at : at + size]
        if not piece and not full:
            return
        at += 0 if rest else len(piece)
        try:
            got = tool.decompress(piece) if size == 256 else tool.decompress(piece, budget.piece)
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError, zstandard.ZstdError):
            return
        rest = getattr(tool, "unconsumed_tail", b"")
        budget.left -= len(got)
        if budget.left < 0:
            budget.cut_off = True
            yield got[: budget.left], at, False
            budget.left = 0
            return
        yield got, at - len(tool.unused_data) * tool.eof, tool.eof


def _inflate(data: bytes, at: int, budget: Budget) -> Iterator[tuple[bytes, int]]:
    """The decompressed bytes of all streams that follow each other from ``at``, in pieces that overlap, and where the reading stands then."""
    held, new = bytearray(), 0
    while data.startswith(MAGIC, at):
        whole = False
        for got, at, whole in _stream(data, at, budget):
            held += got
            new += len(got)
            if new >= budget.piece:
                yield bytes(held), at
                del held[:-OVERLAP]
                new = 0
        if not whole:
            break
        end = at
        # zeros may stand between streams
        at = SKIPPED.match(data, at).end()
        if not data.startswith(MAGIC, at):
            at = end
            break
    if new:
        yield bytes(held), at


def _base64_runs(data: bytes) -> Iterator[tuple[bytes, Callable[[int], int]]]:
    """Each run of base64 letters, and those over several lines joined, with the place of each letter."""
    for m in BASE64.finditer(data):
        yield m[0], lambda k, at=m.start(): at + k
    for m in WRAPPED.finditer(data):
        pieces, made, source, size = [], [], [], 0
        for x in LETTERS.finditer(BREAK.sub(lambda b: b" " * len(b[0]), m[0])):
            pieces.append(x[0])
            made.append(size)
            source.append(m.start() + x.start())
            size += len(x[0])

        def place(k: int, made=made, source=source) -> int:
            j = bisect_right(made, k) - 1
            return source[j] + k - made[j]

        yield b"".join(pieces), place


def _unwrap(data: bytes, budget: Budget, decoded: bool = False) -> Iterator[tuple[bytes, Map]]:
    """Each layer that can be decoded from this one, and its way back.

    Compressed streams are looked for at the beginning, and in a ``decoded`` layer everywhere. A run of base64 letters
    may begin with others, so that it is decoded from each of its first four.
    """
    if b"%" in data and (found := _replaced(data, PERCENT, unquote_to_bytes)):
        yield found
    if (b"\\" in data or b"&" in data or b"%u" in data) and (found := _replaced(data, ESCAPES, _unescape)):
        yield found
    if b"\0" in data:
        for m in WIDE.finditer(data):
            width = 4 if b"\0\0" in m[0] else 2
            yield m[0].replace(b"\0", b""), lambda start, end, at=m.start(), width=width: (at + width * start, at + width * end)
    last = 0
    for at in (m.start() for m in STREAM.finditer(data)) if decoded else (0,):
        if at < last or not data.startswith(MAGIC, at):
            continue
        for got, stop in _inflate(data, at, budget):
            # a few bytes look like a stream by chance
            if not at or PRINTABLE.search(got) or STREAM.search(got) or WIDE.search(got):
                last = stop if at or len(got) > 64 else 0
                yield got, lambda start, end, at=at, stop=stop: (at, stop)
    for run, place in _base64_runs(data):
        letters = run.rstrip(b"=").translate(URL_SAFE)
        for k in range(4):
            body = letters[k:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            try:
                got = base64.b64decode(body + b"=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                continue
            if PRINTABLE.search(got) or STREAM.search(got) or WIDE.search(got) or not k and _text_like(got):

                def back(start: int, end: int, k=k, n=len(run), place=place) -> tuple[int, int]:
                    return place(k + start // 3 * 4), place(min(n, k + (end + 2) // 3 * 4) - 1) + 1

                yield got, back


def find_secrets(text: str | None, max_total: int = MAX_TOTAL) -> tuple[list[tuple[str, int, int, bool]], int, bool]:
    """Spans (kind, start, end, decoded) in code points, the number of decoded layers, and whether they were cut at ``max_total`` decompressed bytes.

    Spans are ordered by start, then kind as in KINDS, then end. decoded is
    false for spans of the text as it is; a find in a decoded layer that maps
    to such a span of the same kind is the same find. A large compressed layer is decoded and scanned piece by piece.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    found = {x: False for x in scan(data)}
    budget = Budget(max_total)
    # layers are told apart by content, and taken apart once; into[j] has each place (layer, way back) where layer j was found
    number = {hashlib.sha256(data).digest(): 0}
    into: list[list[tuple[int, Map]]] = [[]]
    finds: list[set[tuple[str, int, int]]] = [set()]
    # each layer is held while what it holds is taken apart, which bounds the bytes held by the depth; those that
    # have had their turn wait, TURNS at most and their parents, so that a bomb doesn't hide what stands beside it
    work, waiting = [(0, _unwrap(data, budget), budget.left)], deque()
    while work or waiting:
        if not work:
            i, layers, _ = waiting.popleft()
            work.append((i, layers, budget.left))
        i, layers, since = work[-1]
        if since - budget.left >= budget.turn and (waiting or len(work) > 1):
            waiting.append(work.pop())
            continue
        item = next(layers, None)
        if item is None:
            work.pop()
            continue
        got, back = item
        j = number.setdefault(hashlib.sha256(got).digest(), len(into))
        if j == len(into):
            into.append([])
            finds.append(set(scan(got)))
            work.append((j, _unwrap(got, budget, True), budget.left))
        if j not in (0, i):
            into[j].append((i, back))
    layers = len(into) - 1
    # each find goes back by every way until nothing is new, which ends also where layers hold each other
    moves = [(j, x) for j in range(1, len(into)) for x in finds[j]]
    while moves:
        j, (kind, start, end) = moves.pop()
        for i, back in into[j]:
            x = (kind, *back(start, end))
            if not i:
                found.setdefault(x, True)
            elif x not in finds[i]:
                finds[i].add(x)
                moves.append((i, x))
    order = sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    if text and not text.isascii():
        places = sorted({p for x in order for p in x[1:]})
        points, at, n = {}, 0, 0
        for p in places:
            # bytes that start a code point
            n += sum(b & 0xC0 != 0x80 for b in data[at:p])
            points[p], at = n, p
        return [(k, points[s], points[e], found[k, s, e]) for k, s, e in order], layers, budget.cut_off
    return [(*x, found[x]) for x in order], layers, budget.cut_off


SPANS = "array<struct<kind:string,start:long,end:long,decoded:boolean>>"


def secrets_in(text: Column, max_total: int = MAX_TOTAL) -> Column:
    """struct(spans, layers, cut_off) of a text; null counts as empty."""

    @F.pandas_udf(f"struct<spans:{SPANS},layers:int,cut_off:boolean>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [find_secrets(t, max_total) for t in texts]
        spans = [[{"kind": k, "start": s, "end": e, "decoded": d} for k, s, e, d in x] for x, _, _ in rows]
        return pd.DataFrame({"spans": spans, "layers": [x[1] for x in rows], "cut_off": [x[2] for x in rows]})

    return of(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_total: int = MAX_TOTAL) -> DataFrame:
    """(id_col, spans, layers, cut_off) for every row of ``docs``.

    spans: array of (kind, start, end, decoded), code points, end exclusive.
    Null and empty texts have no spans. Repeated rows each get a row. Other columns
    are ignored; an empty table gives an empty result. A text's compressed layers
    give ``max_total`` bytes at most, which only bombs reach; cut_off tells where
    that happened. No find of the text itself is ever left out.
    """
    found = docs.select(F.col(id_col).alias("id"), secrets_in(F.col(text_col), max_total).alias("found"))
    return found.select(F.col("id").alias(id_col), "found.spans", "found.layers", "found.cut_off")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    """The number of spans of one kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, xs) -> str | None:
            if t is None or xs is None or not len(xs):
                return t
            out, last = [], 0
            for start, end in sorted((x["start"], x["end"]) for x in xs):
                if start >= last or not out:
                    out += [t[last:start], mark]
                last = max(last, end)
            return "".join([*out, t[last:]])

        return pd.Series([one(t, x) for t, x in zip(texts, found, strict=True)], dtype=object)

    return of(text, spans)
