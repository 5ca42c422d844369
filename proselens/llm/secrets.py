"""Secret scans with a recursive decoding worklist.

Each whole text is scanned with three patterns. Then its encoded parts are unwrapped: percent-encoded and Unicode- or entity-escaped lines,
base64 runs (of one line, and of wrapped lines joined), and compressed data inside them. Decoded bytes that are no clean text are scanned all the same. Every layer is scanned again and its own encoded parts join
the worklist, until nothing is left. A layer is known by its text and the place that it stems from: the same at the same place is not taken up
again, so cycles end, while an encoded part that is repeated is scanned wherever it stands. Each character of a layer knows the range of the original text that it stems from, so that spans always refer to
the original.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import itertools
import re
import tempfile
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

# The patterns that the scan is defined by. The shortest lengths of hex and access keys stand in the patterns, which finds the same
# runs, as both match whole runs of one class.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN = 12

URL_LINE = re.compile(r"[^\n]*%[0-9A-Fa-f]{2}[^\n]*")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE_LINE = re.compile(r"[^\n]*(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)[^\n]*")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAP = re.compile(r"[\x20\t]*\r?\n[\x20\t]*(?:>[\x20\t]?)*([A-Za-z0-9+/_-]+={0,2})")  # a further line of a wrapped run, perhaps indented or quoted
LAYER_BYTES = 1 << 26  # a decompressed layer of more bytes goes to disk and is scanned in pieces of so many: a guard of memory against decompression bombs
OVERLAP = 1 << 20      # bytes that a piece has in common with the one before it
READ, PIECE = 1 << 16, 1 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _code(match: str) -> str:
    """The text that an escape stands for; what is no character stays as it is."""
    try:
        if match.startswith("&#"):
            return chr(int(match[3:-1], 16) if match[2] in "xX" else int(match[2:-1]))
        if match.startswith("\\u"):  # pairs of surrogates are one character
            units = b"".join(int(x, 16).to_bytes(2, "big") for x in match.split("\\u")[1:])
            return units.decode("utf-16-be", "replace")
        return chr(int(match[2:], 16))
    except (ValueError, OverflowError):
        return match


def _replaced(text: str, lo: int, hi: int, pattern: re.Pattern, decode, at):
    """text[lo:hi] with each match decoded, and each new character's range in the original. at(i, j): the original range of text[i:j]."""
    out, ranges, pos = [], Ranges(), lo
    for m in pattern.finditer(text, lo, hi):
        out.append(text[pos : m.start()])
        ranges.extend(at(i, i + 1) for i in range(pos, m.start()))
        new = decode(m.group())
        out.append(new)
        n, width = len(new), m.end() - m.start()
        ranges.extend(at(m.start() + k * width // n, max(m.start() + k * width // n + 1, m.start() + (k + 1) * width // n)) for k in range(n))
        pos = m.end()
    out.append(text[pos:hi])
    ranges.extend(at(i, i + 1) for i in range(pos, hi))
    return "".join(out), ranges


class Ranges:
    """Ranges of characters in two arrays of integers: 16 bytes for each, as lines may be long."""

    def __init__(self, pairs=()):
        self.lo, self.hi = array("q"), array("q")
        self.extend(pairs)

    def extend(self, pairs) -> None:
        for s, e in pairs:
            self.lo.append(s)
            self.hi.append(e)


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _printable(text: str) -> bool:
    return len(text) >= 8 and all(c.isprintable() or c in "\t\r\n" for c in text)


def _texts(raw: bytes):
    """Readings (text, encoding, first byte) of bytes that are not all printable, where they hold a secret or an encoded part: UTF-8, in which a byte that
    belongs to no character stands for itself, and where there are NULs UTF-16 from either byte."""
    s = raw.decode("utf-8", "surrogateescape")
    if _tells(s):
        yield s, "utf-8", 0
    for start in (0, 1) if b"\0" in raw else ():
        t = raw[start : len(raw) - (len(raw) - start) % 2].decode("utf-16-le", "replace")
        if _tells(t):
            yield t, "utf-16-le", start


def _edges(text: str, encoding: str, start: int) -> list[int]:
    """The byte at which each character begins, and the end."""
    return list(itertools.accumulate((len(c.encode(encoding, "surrogateescape")) for c in text), initial=start))


def _tells(text: str) -> bool:
    return bool(scan(text) or BASE64.search(text) or URL_RUN.search(text) or ESCAPE.search(text))


def _runs(text: str):
    """Base64 runs (characters, their places in the text): each run of a line, and lines of one width together with a shorter one that ends them. The
    first may be of another width where something else stands before it."""
    wrapped = 0
    for m in BASE64.finditer(text):
        yield m.group(), range(m.start(), m.end())
        if m.start() < wrapped or m.group().endswith("="):
            continue
        runs, end = [m.span()], m.end()
        width = None if text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t>") else end - m.start()
        while (n := WRAP.match(text, end)) and (width is None or len(n[1]) <= width):
            width = width or len(n[1])
            runs.append(n.span(1))
            end = n.end()
            if len(n[1]) < width or n[1].endswith("="):
                break
        if len(runs) > 1:
            if runs[0][1] - runs[0][0] == width:  # lines of full width begin no group of their own
                wrapped = runs[-1][0]
            yield "".join(text[x:y] for x, y in runs), [i for x, y in runs for i in range(x, y)]


class _Zstandard:
    def __init__(self):
        import zstandard

        self.d, self.unconsumed_tail = zstandard.ZstdDecompressor().decompressobj(), b""

    def decompress(self, data: bytes, _) -> bytes:
        return self.d.decompress(data)

    eof = property(lambda self: self.d.eof)
    unused_data = property(lambda self: self.d.unused_data)


def _decompressor(head: bytes):
    """For gzip, zlib, bzip2 or zstandard data that begin so; None for others."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstandard()
    return None


def _members(data):
    """What the compressed members at the beginning of a file hold, in pieces; cut or damaged ones as far as they can be read."""
    feed = data.read(READ)
    try:
        while (d := _decompressor(feed)) is not None:
            while not d.eof:
                piece = d.decompress(feed, PIECE)
                if piece:
                    yield piece
                feed = getattr(d, "unconsumed_tail", b"")
                if not feed and not d.eof and len(piece) < PIECE and not (feed := data.read(READ)):
                    return
            feed = d.unused_data.lstrip(b"\0")  # padding
            while len(feed) < 4 and (more := data.read(READ)):
                feed = (feed + more).lstrip(b"\0")
    except Exception:  # noqa: BLE001  not such data after all
        return


def _inflated(raw: bytes):
    """A file with what compressed data hold, unwrapped until they are no longer compressed or come again; None where they hold nothing."""
    now, out, seen = io.BytesIO(raw), None, set()
    while True:
        digest = hashlib.sha256()
        inner = tempfile.SpooledTemporaryFile(LAYER_BYTES)
        for piece in _members(now):
            digest.update(piece)
            inner.write(piece)
        if not inner.tell() or digest.digest() in seen:
            return out
        seen.add(digest.digest())
        inner.seek(0)
        now = out = inner


def _pieces(data):
    """The bytes of a file: all, or overlapping pieces if they are many."""
    data.seek(0)
    now = data.read(LAYER_BYTES)
    while now:
        yield now
        more = data.read(LAYER_BYTES - OVERLAP)
        now = more and now[-OVERLAP:] + more


def unwrapped(text: str, at):
    """Layers (text, at) directly below a text."""
    if "%" in text:
        for m in URL_LINE.finditer(text):
            yield _layer(*_replaced(text, m.start(), m.end(), URL_RUN, _percent, at))
    if "\\" in text or "&#" in text:
        for m in ESCAPE_LINE.finditer(text):
            yield _layer(*_replaced(text, m.start(), m.end(), ESCAPE, _code, at))
    for run, places in _runs(text):
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            run = run[:-1]
        raw = base64.b64decode(run + "=" * (-len(run) % 4))
        plain = raw.decode("utf-8", "surrogateescape")
        more = None if _printable(plain) else _inflated(raw)
        if more is None:
            last = len(places) - 1
            for inner, encoding, start in [(plain, "utf-8", 0)] if _printable(plain) else _texts(raw):
                edges = _edges(inner, encoding, start)
                yield _layer(inner, Ranges(at(places[x * 4 // 3], places[min(last, (y * 4 + 2) // 3 - 1)] + 1) for x, y in zip(edges, edges[1:])))
            continue
        whole = at(places[0], places[-1] + 1)
        for piece in _pieces(more):
            for inner in {piece.decode("utf-8", "replace"), *(t for t, encoding, _ in _texts(piece) if encoding != "utf-8")}:
                yield inner, lambda i, j, w=whole: w


def _layer(text: str, ranges: Ranges):
    return text, lambda i, j: (ranges.lo[i], max(ranges.hi[i:j]))


def spans(text: str) -> tuple[list, set, int]:
    """(base spans, all spans, layers): spans as (start, kind, end) in code points of the text; layers counts different texts."""
    base = scan(text)
    known = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
    found, seen, texts = set(base), {(known(text), 0, len(text))}, {known(text)}
    work = [unwrapped(text, lambda i, j: (i, j))]  # of the layers above, only what is not yet unwrapped
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        inner, to = layer
        place = known(inner), *to(0, len(inner))
        if place in seen:
            continue
        seen.add(place)
        texts.add(place[0])
        for s, kind, e in scan(inner):
            lo, hi = to(s, e)
            found.add((lo, kind, hi))
        work.append(unwrapped(inner, to))
    return base, found, len(texts) - 1


def shown(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers of every row of docs (doc_id, text).

    Null text counts as empty. A base match inside an encoded part stays; a hit in a decoded layer that maps to a span of the same kind that is
    there already adds nothing. Extra columns are ignored."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def run(batches):
        for batch in slices(batches):
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, found, layers = spans(t)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((i, *n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(found), layers))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    d = pick(docs, {"doc_id": "long", "text": "string"}).fillna("", ["text"])
    return d.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")


def query(spark, sf_dir):
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def base_query(spark, sf_dir):
    """The counts of op7, which SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE = r"""
select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) n_assign,
    len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) n_hex from documents
"""
