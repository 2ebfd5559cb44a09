r"""Secret scans with a recursive decoding worklist.

The base scan finds three kinds in the text itself, leftmost and
non-overlapping per kind: `assign`, `access` and `hex`. Then layers are
unwrapped: percent escapes, Unicode escapes (\uXXXX, \UXXXXXXXX, \xXX, numeric
character references), base64 (both alphabets, also wrapped into lines of
MIN_RUN or more characters) and what it may hold compressed (gzip, zlib, bzip2,
xz, zstandard, all members of a sequence, and deflate without a header). Decoded bytes that aren't plain UTF-8
are read byte for byte, once more without NULs (UTF-16 and UTF-32), and count as
a layer if they hold a secret or something encoded. Every new layer is scanned with the same
patterns and unwrapped again, until no layer is new; a layer met before (same
text from the same place) ends its chain, so cycles end too. Each layer maps
its characters to the original ones: escapes exactly, the content of an encoded
run to the whole run. Spans are in code points, end exclusive, of the text as
stored.

Bounded memory: a compressed layer is read as a stream and followed in parts of
about MAX_EXPANDED bytes that end at line ends, which no secret spans. One with a
longer line, with more than MAX_LAYER bytes in all, or that its format can't open
in bounded memory (xz dictionaries above 256 MiB, zstandard windows above 128 MiB)
is left closed from there on, counted in n_unopened and replaced whole by redact.
Layers are followed depth first, so that only those of one chain are held.

Bounded work: escapes are unwrapped one level at a time, each level a layer, until
the layers of a document together are DEEP times as long as it is. Deeper nests
are unwrapped to the end at once, in linear time, and what results is a layer.
Everything else is followed to the fixpoint.

Defined cases: a null text counts as empty; a text without secrets has an empty
span list (and the digest of the empty string); repeated rows are scanned row
by row; a null doc_id is kept. Other columns of the input play no part in
scans, whatever their names; redact keeps them.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{24,}")
MAX_EXPANDED, MAX_LAYER = 32 << 20, 1 << 30
DEEP = 64
#: Shorter runs can't hold a secret of any kind.
MIN_RUN = 16
MARK = "[SECRET]"

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
_BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|\\r\\n|\\n)[ \t]*+")
#: Possessive and from the start of a run only, or a long run would be tried from each of its characters.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:%s[A-Za-z0-9+/_-]{%d,}+)*+(?:%s[A-Za-z0-9+/_-]++)?={0,2}" % (MIN_RUN, _BREAK.pattern, MIN_RUN, _BREAK.pattern))
_PIECES = re.compile(r"[A-Za-z0-9]{%d,}={0,2}" % MIN_RUN)

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class Layer:
    """A text and where its characters come from in the original: all from one place, each from its own, or, of the original, itself."""

    def __init__(self, text: str, place: tuple[int, int] | None = None, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text, self.place, self.starts, self.ends = text, place, starts, ends

    def start(self, at: int) -> int:
        return self.place[0] if self.place else at if self.starts is None else int(self.starts[at])

    def end(self, at: int) -> int:
        """The end of the character before the given place."""
        return self.place[1] if self.place else at if self.ends is None else int(self.ends[at - 1])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            n = len(self.text)
            if self.place:
                return np.full(n, self.place[0], np.int32), np.full(n, self.place[1], np.int32)
            at = np.arange(n + 1, dtype=np.int32)
            return at[:-1], at[1:]
        return self.starts, self.ends

    def key(self) -> tuple:
        n = len(self.text)
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.start(0), self.end(n)) if n else (b"", 0, 0)


def _percent(run: str, width: int = 3) -> list[tuple[str, int, int]]:
    """Characters of an escaped run with their places in it, `width` for a byte; a byte that isn't UTF-8 is its Latin-1 character."""
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        lone = 0xDC80 <= ord(c) <= 0xDCFF
        n = width if lone else width * len(c.encode("utf-8"))
        out.append((chr(ord(c) - 0xDC00) if lone else c, at, at + n))
        at += n
    return out


def _unicode(run: str) -> list[tuple[str, int, int]] | None:
    if run.startswith("&#"):
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    elif len(run) == 12:
        code = 0x10000 + ((int(run[2:6], 16) & 0x3FF) << 10) + (int(run[8:], 16) & 0x3FF)
    else:
        code = int(run[2:], 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return None
    return [(chr(code), 0, len(run))]


def _unescape(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """One level of escapes undone."""
    text, starts, ends, at = [], [], [], 0
    froms = None
    for m in pattern.finditer(layer.text):
        if (chars := decode(m[0])) is None:
            continue
        text.append(layer.text[at : m.start()])
        text.append("".join(c for c, _, _ in chars))
        if not layer.place:
            froms = froms or layer.places()
            starts += [froms[0][at : m.start()], froms[0][[m.start() + a for _, a, _ in chars]]]
            ends += [froms[1][at : m.start()], froms[1][[m.start() + b - 1 for _, _, b in chars]]]
        at = m.end()
    if not text:
        return None
    text = "".join([*text, layer.text[at:]])
    if layer.place:
        return Layer(text, layer.place)
    return Layer(text, None, np.concatenate([*starts, froms[0][at:]]), np.concatenate([*ends, froms[1][at:]]))


_TAIL = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)\Z")
_ENDS = frozenset("0123456789abcdefABCDEF;")


def _flattened(layer: Layer) -> Layer:
    """All levels of escapes undone in one pass: whatever ends in an escape is replaced at once, and may end in another then.

    Bytes above 127 stay bytes until the end, where those in a row are read as UTF-8.
    """
    froms = layer.places()
    out, starts, ends = [], [], []
    for c, s, e in zip(layer.text, froms[0].tolist(), froms[1].tolist(), strict=True):
        out.append(c)
        starts.append(s)
        ends.append(e)
        while out[-1] in _ENDS and (m := _TAIL.search("".join(out[-10:]))):
            n, got = len(m[0]), m[0]
            code = int(got[1:], 16) if got[0] == "%" else int(got[3:-1], 16) if got[:3] in ("&#x", "&#X") else int(got[2:-1]) if got[0] == "&" else int(got[2:], 16)
            if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                break
            out[-n:] = [chr(code + 0xDC00) if got[0] == "%" and code > 127 else chr(code)]
            del starts[1 - n :]
            ends[-n:] = [ends[-1]]
    text, starts, ends = "".join(out), np.array(starts, np.int32), np.array(ends, np.int32)
    if re.search("[\udc80-\udcff]", text):
        held = Layer(text, None, starts, ends)
        return _unescape(held, re.compile("[\udc80-\udcff]+"), lambda run: _percent("".join(f"%{ord(c) - 0xDC00:02x}" for c in run), 1))
    return Layer(text, layer.place) if layer.place else Layer(text, None, starts, ends)


class Budget:
    """What has been tried in a document: runs by digest and place; the places of layers that stay closed; the work on escapes."""

    def __init__(self, size: int) -> None:
        self.tried: dict[tuple, bool | None] = {}
        self.closed: dict[tuple[int, str], int] = {}
        self.work, self.most = 0, DEEP * (size + 4096)


class Closed(Exception):
    """A compressed layer that is too large."""


_BROKEN = (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError)
_STEP, _HEAD = 1 << 20, 1 << 16
_OPEN = {"zlib": lambda: zlib.decompressobj(47), "bare": lambda: zlib.decompressobj(-15), "bz2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(memlimit=1 << 28)}


def _magic(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0):
        return "zlib"
    return {b"BZh": "bz2", b"\xfd7z": "xz", b"\x28\xb5\x2f": "zstd"}.get(data[:3])


class _Stream:
    """Bytes in pieces, of which the first may be looked at."""

    def __init__(self, pieces) -> None:
        self.pieces, self.held = iter(pieces), b""

    def head(self) -> bytes:
        while len(self.held) < _HEAD and (more := next(self.pieces, None)) is not None:
            self.held += more
        return self.held[:_HEAD]

    def __iter__(self):
        return self

    def __next__(self) -> bytes:
        if self.held:
            got, self.held = self.held, b""
            return got
        return next(self.pieces)

    def read(self, n: int = -1) -> bytes:
        """As a file has it."""
        if not self.held:
            self.held = next(self.pieces, b"")
        n = len(self.held) if n < 0 else n
        got, self.held = self.held[:n], self.held[n:]
        return got


def _members(source: _Stream, kind: str) -> Iterator[bytes]:
    """The content of all members of a compressed stream, in steps."""
    try:
        while kind != "zstd":
            d, data = _OPEN[kind](), next(source, b"")
            while not d.eof:
                out = d.decompress(data, _STEP)
                if out:
                    yield out
                if kind in ("zlib", "bare"):
                    data = d.unconsumed_tail
                    want = not data and len(out) < _STEP and not d.eof
                else:
                    data, want = b"", d.needs_input
                if want and not (data := next(source, b"")):
                    return  # cut short
            source.held = d.unused_data + source.held
            while source.head() and not source.held.strip(b"\0"):  # padding between members
                source.held = b""
            source.held = source.held.lstrip(b"\0")
            if kind == "bare" or not (kind := _magic(source.head())):
                return
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(source, read_across_frames=True) as r:
            while out := r.read(_STEP):
                yield out
    except lzma.LZMAError as e:
        if "limit" in str(e):
            raise Closed from e
        raise
    except zstandard.ZstdError as e:
        if "too much memory" in str(e):
            raise Closed from e
        raise


def _decompressed(data: bytes) -> _Stream | None:
    """The content of compressed bytes, opened again as long as it is compressed itself; None if they aren't compressed."""
    stream, met, size = _Stream([data]), set(), 0

    def counted(pieces: Iterator[bytes]) -> Iterator[bytes]:
        nonlocal size
        for p in pieces:
            size += len(p)
            if size > MAX_LAYER:
                raise Closed
            yield p

    def recorded(pieces: _Stream, taken: list[list]) -> Iterator[bytes]:
        for p in pieces:
            for log in taken:
                log.append(p)
            yield p

    opened = False
    while kind := _magic(head := stream.head()):
        if (told := hashlib.blake2b(head, digest_size=16).digest()) in met:
            return _Stream(())  # a cycle: nothing new
        met.add(told)
        taken = [[]]
        inner = _Stream(counted(_members(_Stream(recorded(stream, taken)), kind)))
        try:
            first = inner.head()
        except _BROKEN:  # what came before the fault counts
            first, inner.pieces = inner.held, iter(())
        if not first:  # not compressed after all
            stream = _Stream(chain(*taken, stream))
            break
        taken.clear()
        stream, opened = inner, True
    return stream if opened else _bare(data)


def _bare(data: bytes) -> _Stream | None:
    """The content of deflated bytes without a header, if they are nothing else."""
    d, more, size = zlib.decompressobj(-15), data, 0
    try:
        while not d.eof and size <= MAX_LAYER:
            out = d.decompress(more, _STEP)
            more, size = d.unconsumed_tail, size + len(out)
            if not out and not more:
                break
    except zlib.error:
        return None
    if size > MAX_LAYER:
        raise Closed
    return _Stream(_members(_Stream([data]), "bare")) if d.eof and not d.unused_data and size else None


_LINE_END = re.compile(rb"[^A-Za-z0-9+/_=\s-][ \t\r]*\n")


def _parts(stream: _Stream) -> Iterator[bytes]:
    """The content in parts that end at line ends, preferably not between lines that may be base64."""
    held = bytearray()
    try:
        for piece in stream:
            held += piece
            if len(held) > MAX_EXPANDED:
                cut = held.rfind(b"\n") + 1
                if not cut:
                    raise Closed
                for m in _LINE_END.finditer(held, max(0, len(held) - _STEP)):
                    cut = m.end()
                yield bytes(held[:cut])
                del held[:cut]
    except _BROKEN:  # cut short or spoilt: what came before counts
        pass
    if held:
        yield bytes(held)


def _readable(data: bytes) -> str | None:
    """The bytes as text, if they are text: UTF-8 without control characters but white space."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if any(ord(c) < 32 and c not in "\t\n\r\f\v" or ord(c) == 127 for c in text) else text


def _hidden(data: bytes) -> str | None:
    """Other bytes as characters, and again without NULs, as far as these hold a secret or something encoded."""
    every = [data.decode("latin-1")]
    if b"\0" in data:
        every.append(data.replace(b"\0", b"").decode("latin-1"))
    return "\n\0\n".join(t for t in every if base_spans(t) or any(p.search(t) for p in (_PERCENT, _UNICODE, _RUN))) or None


def _contents(run: str) -> Iterator[tuple[str, bool]]:
    """The texts in a base64 run, or in what it holds compressed, and whether they are plain text. Raises Closed where the rest stays closed."""
    body = run.rstrip("=")
    if "-" in body and ("+" in body or "/" in body):
        return
    whole = len(body) % 4 != 1
    body = body if whole else body[:-1]
    try:
        data = base64.b64decode((body + "=" * (-len(body) % 4)).translate(_URL_SAFE), validate=True)
    except (binascii.Error, ValueError):
        return
    if whole and (text := _readable(data)) is not None:
        if text:
            yield text, True
        return
    stream = _decompressed(data)
    for part in [data] if stream is None else _parts(stream):
        text = _readable(part) if stream else None
        if text:
            yield text, True
        elif text is None and (text := _hidden(part)):
            yield text, False


_URL_SAFE = str.maketrans("-_", "+/")


def _wrapped(text: str) -> Iterator[list[list[tuple[int, int]]]]:
    """Groups of lines that base64 may be wrapped into: first all of them, then those of one width with a line before and a rest."""
    for m in _LINES.finditer(text):
        breaks = [(m.start() + x.start(), m.start() + x.end()) for x in _BREAK.finditer(m[0])]
        if not breaks:
            continue
        lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]))
        wide, at, tries = [b - a for a, b in lines], 0, {(0, len(lines)): None}
        while at < len(lines) - 1:
            end = at + 2
            while end < len(lines) and wide[end] == wide[at + 1]:
                end += 1
            rest = end + (end < len(lines) and wide[end] < wide[at + 1])
            for a in (at, at + 1):
                tries |= {(a, z): None for z in (rest, end, end - 1) if z - a > 1}
            at = end - 1
        yield [lines[a:z] for a, z in tries]


def children(layer: Layer, budget: Budget) -> Iterator[Layer]:
    text = layer.text
    percent, unicode = "%" in text and _PERCENT.search(text), ("\\" in text or "&#" in text) and _UNICODE.search(text)
    if (percent or unicode) and budget.work > budget.most:
        yield _flattened(layer)
    else:
        for found, pattern, decode in ((percent, _PERCENT, _percent), (unicode, _UNICODE, _unicode)):
            if found and (got := _unescape(layer, pattern, decode)):
                budget.work += len(got.text)
                yield got

    def opened(run: str, a: int, b: int) -> tuple[Iterator[Layer], bool | None]:
        """The layers in a run unless it was met before, and whether they begin with plain text; None if there are none."""
        place = layer.start(a), layer.end(b)
        key = (hashlib.blake2b(run.encode(), digest_size=16).digest(), *place)
        if key in budget.tried:
            return iter(()), budget.tried[key]

        def layers() -> Iterator[tuple[Layer, bool]]:
            try:
                for text, plain in _contents(run):
                    yield Layer(text, place), plain
            except Closed:
                at = (place[0], run[:64])
                budget.closed[at] = max(place[1], budget.closed.get(at, 0))

        rest = layers()
        first = next(rest, None)
        budget.tried[key] = first[1] if first else None
        return (got for got, _ in chain([first] if first else [], rest)), budget.tried[key]

    done = []
    for tries in _wrapped(text):
        for lines in tries:
            got, plain = opened("".join(text[a:b] for a, b in lines), lines[0][0], lines[-1][1])
            yield from got
            if plain:
                done.append((lines[0][0], lines[-1][1]))
                break
    done.reverse()
    for m in _RUN.finditer(text):
        while done and done[-1][1] <= m.start():
            done.pop()
        if done and done[-1][0] <= m.start() and m.end() <= done[-1][1]:
            continue  # a line of what is open already
        got, plain = opened(m[0], m.start(), m.end())
        yield from got
        if not plain and not m[0].rstrip("=").isalnum():
            for p in _PIECES.finditer(m[0]):
                yield from opened(p[0], m.start() + p.start(), m.start() + p.end())[0]


def _may_hide(text: str) -> bool:
    return "%" in text or "\\" in text or "&#" in text or _RUN.search(text) is not None


def scan(text: str | None) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, the number of layers met below the text, and of compressed ones left closed."""
    base, every, layers, closed = _scan(text)
    return base, every, layers, len(closed)


def _scan(text: str | None) -> tuple[list[Span], list[Span], int, list[tuple[int, int]]]:
    """As scan, with the places of the closed layers."""
    text = text or ""
    base = base_spans(text)
    if not _may_hide(text):
        return base, base, 0, []
    found, budget, layers = set(base), Budget(len(text)), 0
    root = Layer(text)
    seen, work = {root.key()}, [children(root, budget)]
    while work:
        if (child := next(work[-1], None)) is None:
            work.pop()
            continue
        if (key := child.key()) in seen:
            continue
        seen.add(key)
        layers += 1
        found.update((child.start(s), k, child.end(e)) for s, k, e in base_spans(child.text))
        work.append(children(child, budget))
    return base, sorted(found), layers, [(a, b) for (a, _), b in budget.closed.items()]


def without(text: str | None, spans: list[Span], mark: str = MARK) -> str | None:
    """The text with the union of the spans replaced."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every document."""
    C.ready(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unopened long")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, every, layers, closed = scan(text)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, closed))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_unopened"])

    return C.on_all_cores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", scanned("text").alias("x")).select("doc_id", "x.*")


def redact(docs: DataFrame, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """The documents with every secret of the text, encoded or not, and every layer left closed replaced by a mark."""
    C.ready(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for t in texts:
                _, every, _, closed = _scan(t)
                rows.append(without(t, [*every, *((a, 0, b) for a, b in closed)], mark))
            yield pd.Series(rows, dtype=object)

    return C.on_all_cores(docs).withColumn(text_col, cleaned(F.col(text_col)))


def base_sql() -> str:
    """The base counts in DuckDB SQL; letters of either case are spelled out."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    count = lambda pattern, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: length(x) >= {least}))::BIGINT"
    assign = rf"({words})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
    return f"SELECT doc_id, {count(assign, 2, 6)} AS n_assign, {count('AKIA[A-Z0-9]+', 0, 20)} AS n_access, {count('[0-9a-f]+', 0, 24)} AS n_hex FROM documents"
