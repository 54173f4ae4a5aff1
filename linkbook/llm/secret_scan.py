"""Secret scans: credentials in texts, also under nested encodings.

A recursive decoding worklist: each text is scanned, URL escapes, Unicode escapes, base64 and
compressed data in it are unwrapped to further layers, and these are scanned and unwrapped in
turn until nothing new comes out. A layer that equals one it came from is a cycle and ends. Each
layer knows which stretch of the one above each of its characters came from, so every finding is
told as a span of the text itself.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in the order in which equal starts are told. The patterns and least lengths are fixed values of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}"
    r"|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};"
)
# Runs of base64, also wrapped at 60 to 76 characters a line.
BASE64_RUN = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_PART = re.compile(r"[A-Za-z0-9+]{16,}")
# First bytes of gzip, zlib, zstandard, bzip2 and xz data, as characters up to 255.
COMPRESSED = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|\\(\xb5/\xfd|BZh[1-9]|\xfd7zXZ\x00")
BYTES = re.compile("[\x00-\xff]*")
PROBE = 4096
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
# A decompressed layer of more bytes is not unwrapped; findings tell how many were left so.
LAYER_BYTES = 64 << 20

Span = tuple[int, int]


@dataclass
class Layer:
    """A text, the way it was unwrapped, and where its characters stood in the layer above."""

    text: str
    path: str = ""
    parent: Layer | None = None
    above: Callable[[int, int], Span] | None = None
    digest: bytes = b""

    def __post_init__(self) -> None:
        self.digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def root_span(self, start: int, end: int) -> Span:
        layer = self
        while layer.parent is not None:
            start, end = layer.above(start, end)
            layer = layer.parent
        return start, end

    def is_cycle(self) -> bool:
        layer = self.parent
        while layer is not None:
            if layer.digest == self.digest:
                return True
            layer = layer.parent
        return False


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in a text as it is."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return found


def _replaced(layer: Layer, way: str, pieces: Iterator[tuple[int, int, str]]) -> Layer | None:
    """A layer in which escapes, each (start, end, its one character), are replaced."""
    out, at, length = [], 0, 0
    starts, sources, ends = [], [], []  # of stretches; ends is -1 for one that stays as it is
    for start, end, character in pieces:
        if start > at:
            starts.append(length)
            sources.append(at)
            ends.append(-1)
            out.append(layer.text[at:start])
            length += start - at
        starts.append(length)
        sources.append(start)
        ends.append(end)
        out.append(character)
        length += 1
        at = end
    if not starts:
        return None
    starts.append(length)
    sources.append(at)
    ends.append(-1)
    out.append(layer.text[at:])

    def above(a: int, b: int) -> Span:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        first = sources[i] if ends[i] >= 0 else sources[i] + a - starts[i]
        return first, ends[j] if ends[j] >= 0 else sources[j] + b - starts[j]

    return Layer("".join(out), f"{layer.path}>{way}", layer, above)


def _url_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of escapes are UTF-8, or else a character a byte."""
    for m in URL_RUN.finditer(text):
        data, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        try:
            characters = [(c, len(c.encode())) for c in data.decode()]
        except UnicodeDecodeError:
            characters = [(chr(b), 1) for b in data]
        for c, n in characters:
            yield at, at + 3 * n, c
            at += 3 * n


def _unicode_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    for m in UNICODE.finditer(text):
        escape = m[0]
        if len(escape) == 12 and escape[1] == "u" and escape[2] != "{":
            code = 0x10000 + ((int(escape[2:6], 16) & 0x3FF) << 10) + (int(escape[8:], 16) & 0x3FF)
        elif escape[0] == "&":
            code = int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
        else:
            code = int(escape[2:].strip("{}"), 16)
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            yield m.start(), m.end(), chr(code)


def _as_text(data: bytes) -> tuple[str, Callable[[int], int]] | None:
    """Bytes as a text without control characters, and the byte at which a character begins; None if they are none."""
    wide = len(data) % 2 == 0 and len(data) >= 8 and not any(data[1::2])
    try:
        text = data.decode("utf-16-le" if wide else "utf-8")
    except UnicodeDecodeError:
        return None
    if CONTROL.search(text):
        return None
    if wide:
        return text, lambda i: 2 * i
    if len(text) == len(data):
        return text, lambda i: i
    return text, lambda i: len(text[:i].encode())


def _base64_layer(layer: Layer, start: int, end: int) -> Layer | None:
    """What a run unwraps to: a text, or compressed data with a character for each byte."""
    run = layer.text[start:end]
    kept = re.sub(r"[\r\n=]", "", run)
    usable = kept[: len(kept) - (len(kept) % 4 == 1)].translate({45: "+", 95: "/"})
    try:
        data = base64.b64decode(usable + "=" * (-len(usable) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    read = _as_text(data)
    if read is None:
        if not COMPRESSED.match(data[:8].decode("latin-1")):
            return None
        read = data.decode("latin-1"), lambda i: i
    text, byte = read
    places = [i for i, c in enumerate(run) if c not in "\r\n="] if len(kept) < len(run.rstrip("=")) else None

    def above(a: int, b: int) -> Span:
        first, last = byte(a) * 8 // 6, (byte(b) * 8 - 1) // 6  # digits that hold the first and the last bit
        if places:
            first, last = places[first], places[last]
        return start + first, start + last + 1

    return Layer(text, f"{layer.path}>base64", layer, above)


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64_RUN.finditer(layer.text):
        inner = _base64_layer(layer, *m.span())
        if inner:
            yield inner
        else:  # the run may join a name and data by - _ or /
            for part in BASE64_PART.finditer(layer.text, *m.span()):
                if part.span() != m.span() and (inner := _base64_layer(layer, *part.span())):
                    yield inner


class _TooLarge(Exception):
    pass


def _unpacked(data: bytes) -> tuple[bytes, int] | None:
    """Decompressed bytes and how many bytes they were; None if they are not what their first bytes say."""
    if data[:2] == b"\x1f\x8b":
        machine = zlib.decompressobj(31)
    elif data[:1] == b"x":
        machine = zlib.decompressobj()
    elif data[:3] == b"BZh":
        machine = bz2.BZ2Decompressor()
    elif data[:1] == b"\xfd":
        machine = lzma.LZMADecompressor()
    else:
        machine = None
    try:
        if machine is None:
            with zstandard.ZstdDecompressor().stream_reader(data) as reader:
                out = reader.read(LAYER_BYTES + 1)
            if len(out) <= LAYER_BYTES:
                machine = zstandard.ZstdDecompressor().decompressobj()
                machine.decompress(data)
        else:
            out = machine.decompress(data, LAYER_BYTES + 1)
        if len(out) <= LAYER_BYTES and not machine.eof:
            return None
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, ValueError, EOFError):
        return None
    if len(out) > LAYER_BYTES:
        raise _TooLarge
    return out, len(data) - len(machine.unused_data)


def _plausible(first: str) -> bool:
    """Whether the first characters can begin zlib data; in prose they end at once, without a look at the rest."""
    if first[0] != "x":
        return True
    try:
        zlib.decompressobj().decompress(BYTES.match(first)[0].encode("latin-1"), 1 << 20)
    except zlib.error:
        return False
    return True


def _compressed_layers(layer: Layer, left: list[str]) -> Iterator[Layer]:
    at = 0
    while m := COMPRESSED.search(layer.text, at):
        start, at = m.start(), m.end()
        if not _plausible(layer.text[start : start + PROBE]):
            continue
        stretch = BYTES.match(layer.text, start)
        try:
            unpacked = _unpacked(stretch[0].encode("latin-1"))
        except _TooLarge:
            left.append(layer.path)
            continue
        if unpacked:
            data, used = unpacked
            read = _as_text(data)
            text = read[0] if read else data.decode("latin-1")
            if read or COMPRESSED.match(text):
                yield Layer(text, f"{layer.path}>compressed", layer, lambda a, b, span=(start, start + used): span)
                at = start + used


def scan_text(text: str) -> tuple[list[tuple[str, int, int, str]], int, int]:
    """(findings: kind, start, end, path of decodings; layers unwrapped; layers too large to unwrap).

    Findings as the text stands have an empty path. A finding that several layers tell has the
    path of the first. They are in order of start, kind as in ``KINDS``, and end.
    """
    found: dict[tuple[str, int, int], str] = {}
    seen: set[tuple[int, int, bytes]] = set()
    left: list[str] = []
    work, layers = deque([Layer(text)]), 0
    while work:
        layer = work.popleft()
        for kind, start, end in matches(layer.text):
            found.setdefault((kind, *layer.root_span(start, end)), layer.path.lstrip(">"))
        inner = []
        if "%" in layer.text:
            inner.append(_replaced(layer, "url", _url_pieces(layer.text)))
        if "\\" in layer.text or "&#" in layer.text:
            inner.append(_replaced(layer, "unicode", _unicode_pieces(layer.text)))
        inner += _base64_layers(layer)
        inner += _compressed_layers(layer, left)
        for child in inner:
            if child is None or not child.text or child.is_cycle():
                continue
            # The same text can come out of the same place in several orders.
            name = (*child.root_span(0, len(child.text)), child.digest)
            if name not in seen:
                seen.add(name)
                work.append(child)
                layers += 1
    order = sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))
    return [(*f, found[f]) for f in order], layers, len(left)


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        findings, layers, left = [], [], []
        for text in batch.column("text"):
            found, n, m = scan_text(text.as_py() or "")
            findings.append([dict(zip(("kind", "start", "end", "path"), f, strict=True)) for f in found])
            layers.append(n)
            left.append(m)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(findings, pa.list_(_FINDING)), pa.array(layers, pa.int64()), pa.array(left, pa.int64())],
            ["doc_id", "findings", "n_layers", "n_too_large"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, findings (kind, start, end, path), n_layers, n_too_large.

    Spans count code points of ``text``, end exclusive; ``path`` names the decodings, outermost
    first, and is empty for what stands in the text as it is. Null and empty texts have no
    findings, repeated rows equal ones. Empty tables give no rows; further columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _scanned, f"doc_id {id_type}, findings array<struct<kind: string, start: bigint, end: bigint, path: string>>, n_layers bigint, n_too_large bigint"
    )


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op13: secrets of all documents."""
    rows = scan(spark.read.parquet(f"{folder}/documents.parquet"))
    base = F.filter("findings", lambda f: f["path"] == "")
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"),
        "n_layers", "n_too_large",
    )
