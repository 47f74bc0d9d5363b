"""Document files as a source: listing, and extraction of pages by a pluggable extractor."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import FILES

#: Suffix .pdf in any case.
GLOB = "*.[pP][dD][fF]"


class Extractor(Protocol):
    def pages(self, content: bytes) -> list[str]:
        """Plain text of each page, blank ones too; raises on what is no document."""


class PlainExtractor:
    """UTF-8 text with a form feed between pages."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


class LibraryExtractor:
    """PyMuPDF, where it is installed."""

    def pages(self, content: bytes) -> list[str]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [page.get_text("text") for page in doc]


class UnicodeMap:
    """A font's map of codes to text, from its ToUnicode stream; a font without one has codes of one byte, as Windows spells them."""

    _pair = re.compile(rb"<([0-9A-Fa-f\s]*)>")
    _section = re.compile(rb"begin(codespacerange|bfchar|bfrange)(.*?)end(?:codespacerange|bfchar|bfrange)", re.S)
    _range = re.compile(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(<[0-9A-Fa-f\s]*>|\[.*?\])", re.S)

    def __init__(self, stream: bytes | None, wide: bool = False):
        self.text: dict[bytes, str] = {}
        self.widths = {2} if wide else {1}
        self.known = stream is not None
        for kind, body in self._section.findall(stream or b""):
            if kind == b"codespacerange":
                self.widths = {len(_hex(x)) for x in self._pair.findall(body)} or self.widths
            elif kind == b"bfchar":
                codes = self._pair.findall(body)
                self.text |= {_hex(c): _utf16(_hex(t)) for c, t in zip(codes[::2], codes[1::2])}
            else:
                for low, high, to in self._range.findall(body):
                    self._add(_hex(low), _hex(high), [_hex(x) for x in self._pair.findall(to)], to[:1] == b"[")

    def _add(self, low: bytes, high: bytes, to: list[bytes], each: bool) -> None:
        first = int.from_bytes(low, "big")
        for k in range(min(int.from_bytes(high, "big") - first + 1, 1 << 16)):
            if each and k >= len(to) or not to:
                break
            # Without a list the last character counts on.
            whole = to[k] if each else to[0][:-2] + ((int.from_bytes(to[0][-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")
            self.text[(first + k).to_bytes(len(low), "big")] = _utf16(whole)

    def decode(self, data: bytes) -> str:
        if not self.known:
            return data.decode("cp1252", "replace") if self.widths == {1} else ""
        out, at, widths = [], 0, sorted(self.widths)
        while at < len(data):
            width = next((w for w in widths if data[at : at + w] in self.text), widths[0])
            out.append(self.text.get(data[at : at + width], "\ufffd"))
            at += width
        return "".join(out)


def _hex(digits: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _utf16(data: bytes) -> str:
    return data.decode("utf-16-be", "replace")


class SimplePdfExtractor:
    """Text of PDF files: plain or deflated streams, object streams, and fonts of one byte or with a ToUnicode map.

    Encrypted files are refused; text in forms, in images or in fonts without
    a map of two-byte codes needs :class:`LibraryExtractor`.
    """

    _object = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
    _string = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)"
    _show = re.compile(_string + rb"|<[0-9A-Fa-f\s]*>|/([^\s/<>\[\]()]+)\s+[-+.\d]+\s+Tf\b|\b(?:Tj|TJ|Td|TD|Tm|ET)\b|T\*|'|\"|\[|\]|-?\d+(?:\.\d+)?", re.S)
    _escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    #: In an array of strings, a step back of so many thousandths is a space.
    _space = -200

    def pages(self, content: bytes) -> list[str]:
        if not content.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if b"/Encrypt" in content:
            raise ValueError("encrypted")
        objects = {int(m[1]): m[2] for m in self._object.finditer(content)}
        for o in [o for o in objects.values() if re.search(rb"/Type\s*/ObjStm\b", o)]:
            objects = self._packed(o) | objects
        roots = [n for n, o in objects.items() if re.search(rb"/Type\s*/Catalog\b", o)]
        if not roots:
            raise ValueError("no catalog")
        first = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", objects[roots[-1]])
        fonts: dict[bytes, UnicodeMap] = {}
        return [self._text(objects, page, resources, fonts) for page, resources in self._leaves(objects, int(first[1]), b"")] if first else []

    def _packed(self, stream: bytes) -> dict[int, bytes]:
        """The objects of an object stream: numbers and places in front, then the objects."""
        data = self._stream(stream)
        first = re.search(rb"/First\s+(\d+)", stream)
        if data is None or not first:
            return {}
        head = [int(x) for x in data[: int(first[1])].split()]
        numbers, places = head[::2], [int(first[1]) + x for x in head[1::2]]
        return {n: data[a:z] for n, a, z in zip(numbers, places, [*places[1:], len(data)])}

    @staticmethod
    def _stream(o: bytes) -> bytes | None:
        found = re.search(rb"(.*?)\bstream\r?\n(.*?)\r?\nendstream", o, re.S)
        if not found:
            return None
        # A decompressor, as data may be followed by more line ends.
        return zlib.decompressobj().decompress(found[2]) if b"/FlateDecode" in found[1] else found[2]

    def _value(self, objects: dict[int, bytes], data: bytes, key: bytes) -> bytes:
        """The dictionary, list or object that ``key`` names, references followed; empty if there is none."""
        found = re.search(rb"/" + key + rb"\s*(?=[\[<\d])", data)
        if not found:
            return b""
        rest = data[found.end() :]
        if ref := re.match(rb"(\d+)\s+\d+\s+R", rest):
            return objects.get(int(ref[1]), b"")
        depth = 0
        for m in re.finditer(rb"<<|>>|\[|\]", rest):
            depth += 1 if m[0] in (b"<<", b"[") else -1
            if depth == 0:
                return rest[: m.end()]
        return b""

    def _leaves(self, objects: dict[int, bytes], n: int, resources: bytes, depth: int = 0) -> Iterator[tuple[bytes, bytes]]:
        """Pages with their resources, which they may have from above."""
        node = objects.get(n, b"")
        resources = self._value(objects, node, b"Resources") or resources
        kids = self._value(objects, node, b"Kids")
        if kids and depth < 50:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids):
                yield from self._leaves(objects, int(k), resources, depth + 1)
        elif node:
            yield node, resources

    def _map(self, objects: dict[int, bytes], font: bytes) -> UnicodeMap:
        to = self._value(objects, font, b"ToUnicode")
        return UnicodeMap(self._stream(to) if to else None, b"/Type0" in font)

    def _text(self, objects: dict[int, bytes], page: bytes, resources: bytes, known: dict[bytes, UnicodeMap]) -> str:
        own = self._value(objects, resources, b"Font")
        fonts = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", own):
            if n not in known:
                known[n] = self._map(objects, objects.get(int(n), b""))
            fonts[name] = known[n]
        at = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", at[1]) if at else []
        if len(refs) == 1 and objects.get(int(refs[0]), b"").lstrip()[:1] == b"[":
            refs = re.findall(rb"(\d+)\s+\d+\s+R", objects[int(refs[0])])
        streams = [self._stream(objects.get(int(r), b"")) for r in refs]
        return self._shown(b"\n".join(x for x in streams if x is not None), fonts)

    def _shown(self, data: bytes, fonts: dict[bytes, UnicodeMap]) -> str:
        out: list[str] = []
        font, listed = UnicodeMap(None), False
        for m in self._show.finditer(data):
            t = m[0]
            if m[1] is not None:
                font = fonts.get(m[1], UnicodeMap(None))
            elif t[:1] == b"(":
                out.append(font.decode(re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", self._unescaped, t[1:-1], flags=re.S)))
            elif t[:1] == b"<":
                out.append(font.decode(_hex(t[1:-1])))
            elif t in (b"[", b"]"):
                listed = t == b"["
            elif t[:1] in b"-0123456789":
                if listed and float(t) <= self._space:
                    out.append(" ")
            elif t not in (b"Tj", b"TJ"):
                out.append("\n")
        return "".join(out)

    def _unescaped(self, m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r\n") else self._escapes.get(c, c)


def default_extractor() -> Extractor:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return SimplePdfExtractor()
    return LibraryExtractor()


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files of ``folder`` itself by suffix, with content; none if there is no such folder."""
    if not _there(spark, folder):
        return spark.createDataFrame([], FILES)
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder)


def root_of(spark: SparkSession, folder: str) -> str:
    """The folder as the file source spells it in the paths of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def named(path: Column, root: str, served_as: str) -> Column:
    """A file's name in the tables: its place under ``root``, behind ``served_as``; a path elsewhere stays as it is."""
    inside = F.startswith(path, F.lit(root + "/"))
    return F.when(inside, F.concat(F.lit(served_as.rstrip("/")), F.substring(path, F.lit(len(root) + 1), F.length(path)))).otherwise(path)


def unnamed(name: str, root: str, served_as: str) -> str:
    """The path of a file by its name in the tables."""
    front = served_as.rstrip("/") + "/"
    return f"{root}/{name[len(front):]}" if name.startswith(front) else name


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of these files; those that are gone are left out. Marks of glob patterns in names are plain."""
    plain = [re.sub(r"([\\*?\[\]{}^])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(plain).select("path", "content")


def paths_with_suffix(df: DataFrame, path_col: str, suffix: str) -> DataFrame:
    return df.where(F.endswith(F.lower(F.col(path_col)), F.lit(suffix.lower())))


def pages_of(path: str, content: bytes, extractor: Extractor) -> list[tuple[str, int | None, str | None, str | None]]:
    """(path, page number from 1, text, error) of a file's pages; one row with the error if it fails, with neither if it has no page."""
    try:
        return [(path, n, text, None) for n, text in enumerate(extractor.pages(content), 1)] or [(path, None, None, None)]
    except Exception as e:  # whatever a document makes an extractor raise is that document's error
        return [(path, None, None, f"{type(e).__name__}: {e}"[:500])]


def extract_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """``path, page_number (from 1), text, error`` of ``files (path, content)``.

    A file that fails gives one row with the error and no page, so one bad file
    stops nothing. A file without pages gives one row with neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, content in zip(b["path"], b["content"], strict=True) for r in pages_of(path, bytes(content), extractor)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")
