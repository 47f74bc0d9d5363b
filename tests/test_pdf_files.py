"""PDF files as modern writers make them: cross-reference and object streams, fonts with ToUnicode maps."""

from __future__ import annotations

import zlib

import pytest

from folioscope.config import Settings
from folioscope.engine import Engine
from folioscope.sources.documents import SimplePdfExtractor, UnicodeMap

BENGALI, HINDI = "বাংলা ভাষায় লেখা", "हिन्दी में लिखा हुआ"


def stream(data: bytes, extra: bytes = b"", deflate: bool = True) -> bytes:
    if deflate:
        data, extra = zlib.compress(data), extra + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


def cmap(text: str, ranges: bool) -> tuple[bytes, dict[str, int]]:
    """A ToUnicode map of two-byte codes for the letters of ``text``, one by one or in runs."""
    letters = sorted(set(text))
    codes = {c: 0x0100 + 3 * i for i, c in enumerate(letters)}
    if ranges:
        codes = {c: 0x0200 + i for i, c in enumerate(letters)}
        body = b"2 beginbfrange\n<0200> <%04x> [%s]\nendbfrange" % (0x0200 + len(letters) - 1, b" ".join(b"<%s>" % c.encode("utf-16-be").hex().encode() for c in letters))
    else:
        body = b"%d beginbfchar\n%s\nendbfchar" % (len(letters), b"\n".join(b"<%04X> <%s>" % (codes[c], c.encode("utf-16-be").hex().encode()) for c in letters))
    return b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + body + b"\nendcmap", codes


def shown(text: str, codes: dict[str, int]) -> bytes:
    return b"<" + b"".join(b"%04X" % codes[c] for c in text) + b">"


def modern(pages: list[tuple[str, bool]]) -> bytes:
    """Catalog, pages and fonts in an object stream; contents and maps are streams; a cross-reference stream ends the file."""
    packed: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    direct: dict[int, bytes] = {}
    kids, n = [], 10
    fonts = b""
    for i, (text, ranges) in enumerate(pages):
        to, codes = cmap(text, ranges)
        direct[n], direct[n + 1] = stream(to), stream(b"BT /T%d 11 Tf 1 0 0 1 50 700 Tm %s Tj ET" % (i, shown(text, codes)))
        packed[n + 2] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode %d 0 R >>" % n
        packed[n + 3] = b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (n + 1)
        fonts += b" /T%d %d 0 R" % (i, n + 2)
        kids.append(b"%d 0 R" % (n + 3))
        n += 4
    packed[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /ProcSet [/PDF] /Font <<%s >> >> >>" % (b" ".join(kids), len(kids), fonts)
    head, body = b"", b""
    for k, o in packed.items():
        head += b"%d %d " % (k, len(body))
        body += o + b"\n"
    direct[n] = stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head)))
    direct[n + 1] = stream(b"\0" * 40, b"/Type /XRef /W [1 2 1] /Root 1 0 R /Size %d" % (n + 2))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in direct.items()) + b"startxref\n0\n%%EOF"


def test_object_streams_and_maps():
    got = SimplePdfExtractor().pages(modern([(BENGALI, False), (HINDI, True), ("Plain 😀 text", False)]))
    assert [p.strip() for p in got] == [BENGALI, HINDI, "Plain 😀 text"]


def test_maps():
    one = UnicodeMap(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <41> <43> <0061> <50><51><D83DDE00> endbfrange 1 beginbfchar <60> <00660069> endbfchar")
    assert one.decode(b"ABC\x60PQ\x99") == "abcfi😀😁�"
    mixed = UnicodeMap(b"begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange beginbfchar <41> <0041> <8041> <0042> endbfchar")
    assert mixed.decode(b"A\x80A") == "AB"
    assert UnicodeMap(None).decode(b"caf\xe9") == "café" and UnicodeMap(None, wide=True).decode(b"\0A") == ""


def test_arrays_nested_strings_and_broken_files():
    x = SimplePdfExtractor()
    assert x._shown(rb"BT /F1 9 Tf [(Wo)-20(rd)-300(next)] TJ T* (a (b) \(c) Tj ET", {}).strip() == "Word next\na (b) (c"
    whole = modern([(HINDI, True)])
    with pytest.raises(ValueError):
        x.pages(whole.replace(b"%PDF-", b"%XYZ-"))
    with pytest.raises(ValueError):
        x.pages(whole.replace(b"/Type /XRef", b"/Encrypt 9 0 R"))
    assert x.pages(whole.replace(b"/Identity-H", b"/Identity-V")) and x.pages(whole) == x.pages(whole + b"\n%%EOF")


def test_ingest_of_such_a_file(spark, tmp_path):
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "a.pdf").write_bytes(modern([(BENGALI, True), (HINDI, False)]))
    (tmp_path / "pdfs" / "b.pdf").write_bytes(modern([(HINDI, True)])[:300])
    engine = Engine(spark, Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=16), extractor=SimplePdfExtractor()).init()
    report = engine.ingest()
    assert (report.books, report.failed) == (1, 1)
    assert [(r["page_number"], r["chunk_text"]) for r in engine.store.read("chunks").orderBy("id").collect()] == [(1, BENGALI), (2, HINDI)]
    assert engine.search("हिन्दी", 1, "words").first()["quote"] == HINDI
