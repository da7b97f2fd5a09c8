"""PDF files of text pages, one for each document, and objects laid out as a file.

Text goes in as two-byte codes of one font whose ToUnicode table says which character
each code is: codes are given to a document's characters in order of first use.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HEIGHT, LINE = 792, 14
ARGUMENTS = ("pages", "title", "titles", "marks", "picture")


def laid_out(objects: list[bytes], trailer: bytes) -> bytes:
    """A file of objects 1, 2, ... (whole bodies), a cross-reference table and a trailer dictionary's entries."""
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer, start))


def stream(data: bytes, entries: bytes = b"") -> bytes:
    raw = zlib.compress(data, 1)
    return b"<< /Filter /FlateDecode /Length %d %s >>\nstream\n%s\nendstream" % (len(raw), entries, raw)


def string(text: str) -> bytes:
    """A text string, in hexadecimal UTF-16."""
    return b"<FEFF" + text.encode("utf-16-be", "surrogatepass").hex().encode() + b">"


def code_table(codes: dict[str, int]) -> bytes:
    rows = [b"<%04x> <%s>" % (c, ch.encode("utf-16-be", "surrogatepass").hex().encode()) for ch, c in codes.items()]
    parts = [b"%d beginbfchar\n%s\nendbfchar\n" % (len(rows[k : k + 100]), b"\n".join(rows[k : k + 100])) for k in range(0, len(rows), 100)]
    return b"begincmap\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n" + b"".join(parts) + b"endcmap\n"


def coded(items: list[str]) -> tuple[dict[str, int], list[bytes]]:
    """The code of each character, in order of first use from 1, and the items in hexadecimal codes of two bytes."""
    text = "".join(items)
    codes = {ch: k for k, ch in enumerate(dict.fromkeys(text), 1)}
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.zeros(int(points.max(initial=0)) + 1, ">u2")
    table[[ord(ch) for ch in codes]] = list(codes.values())
    digits, ends = table[points].tobytes().hex().encode(), np.cumsum([4 * len(item) for item in items]).tolist()
    return codes, [digits[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


def text_file(pages: list[list[str]], title: str | None = None, titles: list[str] | None = None, marks: list[str] | None = None, picture: bytes | None = None) -> bytes:
    """A file whose pages show the given strings, one below the other.

    titles: of an outline with an entry for each page, every other one below the one before;
    marks: further operators of each page; picture: samples of one row, painted on each page.
    """
    codes, strings = coded([item for items in pages for item in items])
    first, bodies, at = 7, [], 0
    for k, items in enumerate(pages):
        shown = [b"<%s> Tj" % s for s in strings[at : at + len(items)]]
        at += len(items)
        content = b"BT /F0 10 Tf 1 0 0 1 40 %d Tm " % (HEIGHT - 40) + (b" 0 -%d Td " % LINE).join(shown) + b" ET"
        content += b"\n" + marks[k].encode() if marks else b""
        content += b" q 100 0 0 10 40 40 cm /I0 Do Q" if picture else b""
        bodies += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * k + 1), stream(content)]
    kids = b" ".join(b"%d 0 R" % (first + 2 * k) for k in range(len(pages)))
    head = [
        b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 %d] /Resources << /Font << /F0 3 0 R >> /XObject << /I0 6 0 R >> >> >>" % (kids, len(pages), HEIGHT),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Text /Encoding /Identity-H /ToUnicode 4 0 R >>",
        stream(code_table(codes)),
        b"<< %s >>" % (b"/Title " + string(title) if title is not None else b""),
        stream(picture, b"/Subtype /Image /Width %d /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8" % len(picture)) if picture else b"null",
    ]
    catalog, entries = b"/Type /Catalog /Pages 2 0 R", []
    if titles:
        top = first + len(bodies)
        catalog += b" /Outlines %d 0 R" % top
        place = lambda k: top + 1 + k
        tops = [k for k in range(len(titles)) if k % 2 == 0]
        entries.append(b"<< /Type /Outlines /First %d 0 R /Last %d 0 R >>" % (place(0), place(tops[-1])))
        for k, t in enumerate(titles):
            links = [b"/Title %s /Dest [%d 0 R /Fit] /Parent %d 0 R" % (string(t), first + 2 * (k % len(pages)), top if k % 2 == 0 else place(k - 1))]
            if k % 2 == 0 and k + 1 < len(titles):
                links.append(b"/First %d 0 R /Last %d 0 R" % (place(k + 1), place(k + 1)))
            if k % 2 == 0 and k + 2 < len(titles):
                links.append(b"/Next %d 0 R" % place(k + 2))
            if k % 2 == 0 and k:
                links.append(b"/Prev %d 0 R" % place(k - 2))
            entries.append(b"<< %s >>" % b" ".join(links))
    return laid_out([b"<< %s >>" % catalog, *head, *bodies, *entries], b"/Root 1 0 R /Info 5 0 R")


def text_files(docs: DataFrame) -> DataFrame:
    """(doc_id, content) from (doc_id, pages array<array<string>>, title string, titles array<string>, marks array<string>, picture binary)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = zip(*(part.column(c).to_pylist() for c in ARGUMENTS), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_file(*r) for r in rows], pa.binary())], ["doc_id", "content"])

    return docs.select("doc_id", *ARGUMENTS).mapInArrow(run, f"doc_id {kind}, content binary")
