"""PDF files built here, read as tables: structure, damage, text, pictures, paths; and ranking by brute force."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.operators import geometry, ranking
from pagemill.sources import pdf, pdf_content, pdf_objects, pdf_syntax, pdf_writer, shared

PAGE = b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"


def read(spark, **files):
    rows = [(n, raw) for n, raw in files.items()]
    objs = shared.written(pdf_objects.objects(spark.createDataFrame(rows, "doc_id string, content binary")), "objects")
    return objs, shared.written(pdf_objects.page_nodes(objs), "pages")


def texts(spark, **files):
    objs, pages = read(spark, **files)
    shown = pdf_content.with_state(pdf_content.operators(objs, pages))
    got = pdf.page_texts(pdf_content.text_items(shown, pdf_content.fonts(objs, pages)))
    return {(r.doc_id, r.page): r.text for r in got.collect()}


def one_page(content, resources=b"", *more):
    head = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 100 200] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << %s >> >>" % resources, pdf_writer.stream(content)]
    return pdf_writer.laid_out([*head, *more], b"/Root 1 0 R")


# ------------------------------------------------------------ syntax


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        (b"<< /A 1 /B [1.5 -2 +3 .5 true false null] /C#20D (a\\(b\\)\\\\\\101\\12(c)) >>", {"A": 1, "B": [1.5, -2, 3, 0.5, True, False, None], "C D": "(a(b)\\A\n(c)"}),
        (b"[12 0 R 12 0 /R <48656C6C6F> <4> (a\\\r\nb\rc) % note\n /N]", ["12 0 R", 12, 0, "/R", "(Hello", "(@", "(ab\nc", "/N"]),
        (b"(\xfe\xff\x00H\xd8\x34\xdd\x1e)", "(H𝄞"),
        (b"(\x8d\xa0\x18)", "(“€˘"),
        (b"(\xef\xbb\xbf\xc3\xa9)", "(é"),
        (b"[--5 1.2.3 4 ]", [-5, 1.2, 4]),
    ],
)
def test_values(raw, value):
    assert json.loads(pdf_syntax.as_json(pdf_syntax.Lexer(raw).value())) == value


def lzw(raw):
    """Plain coding with codes of nine to twelve bits."""
    table, width, bits, w = {bytes([k]): k for k in range(256)}, 9, [format(256, "09b")], b""
    size = 258
    for c in raw:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        bits.append(format(table[w], f"0{width}b"))
        table[w + bytes([c])] = size
        size += 1
        width = max(9, size.bit_length())  # the reader is one entry behind
        if size >= 4094:
            bits.append(format(256, f"0{width}b"))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = bytes([c])
    bits += [format(table[w], f"0{width}b")] if w else []
    width = max(9, (size + 1).bit_length())
    joined = "".join(bits) + format(257, f"0{width}b")
    joined += "0" * (-len(joined) % 8)
    return int(joined, 2).to_bytes(len(joined) // 8, "big")


def predicted(raw, columns, kinds):
    out, above = bytearray(), bytes(columns)
    for k in range(0, len(raw), columns):
        row, how = raw[k : k + columns], kinds[k // columns % len(kinds)]
        out.append(how)
        for i, c in enumerate(row):
            left, corner = (row[i - 1], above[i - 1]) if i else (0, 0)
            p = left + above[i] - corner
            paeth = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))[2]
            out.append((c - [0, left, above[i], (left + above[i]) // 2, paeth][how]) & 255)
        above = row
    return bytes(out)


def test_filters():
    rng = random.Random(2)
    raw = bytes(rng.choices(b"abcabd\x00\xff", k=6000))
    import base64

    run = b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100)) + bytes([156, 7, 128])
    name = pdf_syntax.Name
    cases = [
        (zlib.compress(raw), name("FlateDecode"), None, raw),
        (zlib.compress(raw)[:-20], name("Fl"), None, None),
        (raw.hex().encode() + b">", name("AHx"), None, raw),
        (base64.a85encode(raw) + b"~>", name("A85"), None, raw),
        (run, name("RL"), None, raw + bytes([7]) * 101),
        (lzw(raw), name("LZW"), None, raw),
        (zlib.compress(predicted(raw, 20, [0, 1, 2, 3, 4])), name("Fl"), {"Predictor": 15, "Columns": 20}, raw),
        (base64.a85encode(zlib.compress(raw)) + b"~>", [name("ASCII85Decode"), name("FlateDecode")], [None, None], raw),
    ]
    for coded, filters, params, want in cases:
        got, left = pdf_syntax.decoded(coded, {"Filter": filters, "DecodeParms": params})
        assert left == [] and (got == want if want is not None else raw.startswith(got) and len(got) > 5000), filters
    assert pdf_syntax.decoded(zlib.compress(b"jpeg"), {"Filter": [name("FlateDecode"), name("DCTDecode")]}) == (b"jpeg", ["DCTDecode"])


def compressed_file():
    """Objects in an object stream, found by a cross-reference stream with differences."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R >>", 7: b"<< /Title (Packed) /Author 8 0 R >>"}
    offsets, at = [], 0
    for n, body in inner.items():
        offsets.append(b"%d %d" % (n, at))
        at += len(body) + 1
    head = b" ".join(offsets) + b" "
    out = bytearray(b"%PDF-1.5\n")
    places = {5: len(out)}
    out += b"5 0 obj\n" + pdf_writer.stream(head + b" ".join(inner.values()), b"/Type /ObjStm /N 4 /First %d" % len(head)) + b"\nendobj\n"
    places[8] = len(out)
    out += b"8 0 obj (A. Uthor) endobj\n"
    start = places[6] = len(out)
    rows = {0: (0, 0, 255), 5: (1, places[5], 0), 8: (1, places[8], 0), 6: (1, start, 0)} | {n: (2, 5, k) for k, n in enumerate(inner)}
    data = b"".join(bytes([rows.get(n, (0, 0, 0))[0]]) + rows.get(n, (0, 0, 0))[1].to_bytes(2, "big") + bytes([rows.get(n, (0, 0, 0))[2]]) for n in range(9))
    raw = zlib.compress(predicted(data, 4, [2]))
    out += b"6 0 obj << /Type /XRef /Size 9 /W [1 2 1] /Root 1 0 R /Info 7 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(raw), raw)
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


def test_files(spark):
    plain = pdf_writer.text_file([["one"], ["two"]], "Old")
    # An update that is appended: another title, and the old table before it.
    info = b"5 0 obj << /Title (New) /CreationDate (D:20240102) >> endobj\n"
    before = int(plain.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    at = len(plain)
    update = plain + info + b"xref\n5 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Info 5 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, before, at + len(info))
    files = dict(
        plain=plain, update=update, packed=compressed_file(), shifted=b"junk\n" + plain, cut=plain[: plain.rindex(b"xref\n0")], moved=plain.replace(b"%PDF-1.7\n", b"%PDF-1.7\n% a note that moves all places\n"),
        packed_cut=compressed_file().split(b"startxref")[0], locked=plain.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), text=b"no file", empty=b"", none=None, head=b"%PDF-1.4",
    )
    objs, pages = read(spark, **files)
    got = {r.doc_id: (r.page_count, r.title, r.error) for r in pdf_objects.metadata(objs, pages).collect()}
    assert got == {
        "plain": (2, "Old", None), "update": (2, "New", None), "packed": (1, "Packed", None), "shifted": (2, "Old", None), "cut": (2, None, "rebuilt"), "moved": (2, "Old", "rebuilt"),
        "packed_cut": (1, "Packed", "rebuilt"), "locked": (0, None, "encrypted"), "text": (0, None, "not a PDF file"), "empty": (0, None, "not a PDF file"), "none": (0, None, "not a PDF file"), "head": (0, None, "rebuilt"),
    }
    more = pdf_objects.metadata(objs, pages).where("doc_id IN ('packed', 'update')").select("doc_id", "author", "created").collect()
    assert {tuple(r) for r in more} == {("packed", "A. Uthor", None), ("update", None, "D:20240102")}
    assert pdf_objects.objects(spark.createDataFrame([], "doc_id string, content binary")).count() == 0


def test_damaged_stream_and_object(spark):
    raw = pdf_writer.laid_out([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>", b"<< /Type /Page >>", b"<< /Filter /FlateDecode /Length 5 >>\nstream\nabcde\nendstream", b"<< /Broken", b"<< /Length 99 >>\nstream\nshort\nendstream"], b"/Root 1 0 R")
    objs, _ = read(spark, f=raw)
    rows = {r.num: r for r in objs.collect()}
    assert rows[4].data is None and rows[4].error.startswith("damaged") and rows[4].value
    assert rows[6].data == b"short" and rows[6].error is None
    assert rows[0].error is None and rows[3].error is None


def test_page_tree(spark):
    """Nested nodes, what they hand down, a node below itself, a kid that is not there."""
    raw = pdf_writer.laid_out(
        [
            b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R] /MediaBox [0 0 10 20] /Resources << /A 1 >> >>", b"<< /Type /Pages /Kids [5 0 R 6 0 R 2 0 R] /MediaBox 8 0 R >>",
            b"<< /Type /Page /MediaBox [1 2 3 4] /Resources << /B 2 >> >>", b"<< /Type /Page >>", b"<< /Type /Pages /Kids [7 0 R] >>", b"<< /Type /Page >>", b"[0 0 30 40]", b"<< /Type /Pages /Kids [] >>",
        ],
        b"/Root 1 0 R",
    )
    _, pages = read(spark, f=raw)
    assert [(r.page, r.node, r.box, r.resources) for r in pages.orderBy("page").collect()] == [(1, 5, [0, 0, 30, 40], '{"A":1}'), (2, 7, [0, 0, 30, 40], '{"A":1}'), (3, 4, [1, 2, 3, 4], '{"B":2}')]


def test_outline(spark):
    """Explicit, old and new named destinations, actions, some that lead nowhere, an item on a cycle."""
    raw = pdf_writer.laid_out(
        [
            b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R /Dests << /old [4 0 R /Fit] >> /Names << /Dests 14 0 R >> >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] >>", b"<< /Type /Page >>", b"<< /Type /Page >>",
            b"<< /First 6 0 R >>", b"<< /Title (a) /Parent 5 0 R /Next 9 0 R /First 7 0 R /Dest [3 0 R /Fit] >>", b"<< /Title (a1) /Parent 6 0 R /Next 8 0 R /Dest /old >>", b"<< /Title 13 0 R /Parent 6 0 R /A << /S /GoTo /D (new) >> >>",
            b"<< /Title (b) /Parent 5 0 R /Next 10 0 R /Dest (none) >>", b"<< /Title (c) /Parent 5 0 R /A 17 0 R /First 11 0 R >>", b"<< /Title (loop) /Parent 10 0 R /Next 12 0 R >>", b"<< /Title (c2) /Parent 10 0 R /Dest [99 0 R] >>",
            b"<FEFF00E9>", b"<< /Kids [15 0 R 16 0 R] >>", b"<< /Names [(new) [4 0 R /XYZ 0 0 0] (other) 18 0 R] >>", b"<< /Names [(z) << /D [3 0 R] >>] >>", b"<< /S /GoTo /D (z) >>", b"[3 0 R]",
        ],
        b"/Root 1 0 R",
    )
    last = b"<< /Title (c2) /Parent 10 0 R /Dest [99 0 R] >>"
    loop = raw.replace(last, b"<< /Title (c2) /Parent 10 0 R /Next 11 0 R >>".ljust(len(last)))
    assert len(loop) == len(raw)
    objs, pages = read(spark, whole=raw, loop=loop, none=pdf_writer.text_file([["x"]]))
    found = pdf_objects.outline(objs, pages, pdf_objects.destinations(objs, pages))
    rows = [(r.ordinal, r.depth, r.title, r.page, r.parent) for r in found.where("doc_id = 'whole'").orderBy("ordinal").collect()]
    assert rows == [(0, 0, "a", 1, None), (1, 1, "a1", 2, 6), (2, 1, "é", 2, 6), (3, 0, "b", None, None), (4, 0, "c", 1, None), (5, 1, "loop", None, 10), (6, 1, "c2", None, 10)]
    assert found.where("doc_id = 'none'").count() == 0
    assert found.where("doc_id = 'loop'").count() == 0  # the chain never ends


@pytest.mark.parametrize("seed", range(4))
def test_preorder_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for doc in range(6):
        n = rng.choice([1, 2, 30, 200])
        parent = {k: rng.choice([None] * 3 + list(range(max(0, k - 3), k)) if k else [None]) if rng.random() < 0.9 else None for k in range(n)}
        kids: dict = {}
        for k, p in parent.items():
            kids.setdefault(p, []).append(k)
        following = {a: b for p, own in kids.items() if p is not None for a, b in zip(own[:-1], own[1:], strict=True)}
        for top in kids[None]:
            todo, place = [(top, 0)], 0
            while todo:
                k, depth = todo.pop()
                want[doc, k] = (place, depth)
                place += 1
                todo += [(c, depth + 1) for c in reversed(kids.get(k, []))]
        rows += [(doc, k, parent[k], kids.get(k, [None])[0], following.get(k)) for k in range(n)]
    rng.shuffle(rows)
    got = ranking.preorder(spark.createDataFrame(rows, "doc_id int, node long, parent long, first long, next long")).collect()
    assert {(r.doc_id, r.node): (r.ordinal, r.depth) for r in got} == want


def test_ranked_cycles(spark):
    rows = [(1, 1, 2, 5), (1, 2, 3, 7), (1, 3, None, 1), (1, 4, 5, 1), (1, 5, 6, 1), (1, 6, 5, 1), (1, 7, 99, 2), (2, 1, 1, 1), (2, 2, None, None)]
    got = ranking.ranked(spark.createDataFrame(rows, "doc_id int, node long, to long, w long"), weight="w")
    assert {(r.doc_id, r.node): (r.tail, r.rank) for r in got.collect()} == {(1, 1): (3, 13), (1, 2): (3, 8), (1, 3): (3, 1), (1, 4): (None, None), (1, 5): (None, None), (1, 6): (None, None), (1, 7): (7, 2), (2, 1): (None, None), (2, 2): (2, 0)}
    assert ranking.ranked(spark.createDataFrame([], "doc_id int, node long, to long")).count() == 0


# ------------------------------------------------------------ contents


def test_strings_and_fonts(spark):
    table = b"begincmap 1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <41> <43> <0061> endbfrange 1 beginbfchar <44> <00660069> endbfchar 1 beginbfrange <45> <46> [<D834DD1E> <0021>] endbfrange endcmap"
    wide = b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0100> <01ff> <0400> endbfrange endcmap"
    fonts = b"/Font << /W << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> /D 5 0 R /U 7 0 R /T 9 0 R /M << /Subtype /TrueType /Encoding /MacRomanEncoding >> >>"
    more = [b"<< /Subtype /Type1 /Encoding 6 0 R >>", b"<< /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni20AC /fi 97 /zero /B.alt /nosuchname] >>", b"<< /Subtype /Type1 /ToUnicode 8 0 R >>", pdf_writer.stream(table), b"<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 10 0 R >>", pdf_writer.stream(wide)]
    content = (
        b"BT /W 10 Tf (caf\\351 \\200) Tj [(A) -300 (B) 20 (C) -100 (D)] TJ /D 9 Tf (ABCabcX) Tj q /U 9 Tf (ABCDEFG) Tj Q (A) ' /T 9 Tf <01000105012F0041> Tj 0 0 (x) \" /M 9 Tf (\\216) Tj /Gone 9 Tf (\\351) Tj ET"
    )
    got = texts(spark, f=one_page(content, fonts, *more))
    # The string after the double quote is read in two-byte codes: one byte is none.
    assert got == {("f", 1): "café € A BCD é€ﬁ0BX abcfi𝄞!G é ЀЅЯA  é é"}


def test_written_texts(spark):
    pages = [["Hello  world", "", "ß\t𝄞 "], [], ["日本", "x" * 300]]
    raw = pdf_writer.text_file(pages, None)
    assert texts(spark, f=raw) == {("f", 1): "Hello  world  ß\t𝄞 ", ("f", 3): "日本 " + "x" * 300}


def test_parts_of_contents(spark):
    """Several streams make one; a reference to an array of them, too."""
    raw = pdf_writer.laid_out(
        [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R 4 0 R] /Resources << /Font << /F << /Subtype /Type1 >> >> >> >>", b"<< /Type /Page /Contents [5 0 R 6 0 R] >>", b"<< /Type /Page /Contents 7 0 R >>", pdf_writer.stream(b"BT /F 1 Tf (a) Tj [(b)"), pdf_writer.stream(b"(c)] TJ ET"), b"[6 0 R 5 0 R 99 0 R]"],
        b"/Root 1 0 R",
    )
    assert texts(spark, f=raw)[("f", 1)] == "a bc"


FORM_RESOURCES = b"/XObject << /X 5 0 R /I 6 0 R /N 8 0 R >> /Font << /F << /Subtype /Type1 /Encoding /WinAnsiEncoding >> >>"
FORMS = [
    pdf_writer.stream(b"/Y Do 0 0 10 10 re S BT /F 1 Tf (in form) Tj ET", b"/Subtype /Form /Matrix [2 0 0 2 5 5] /Resources << /XObject << /Y 7 0 R /X 5 0 R >> /Font << /F << /Subtype /Type1 >> >> >>"),
    pdf_writer.stream(b"\x01\x02\x03\x04\x05\x06", b"/Subtype /Image /Width 2 /Height 3"),
    pdf_writer.stream(b"1 0 0 1 100 0 cm 0 0 30 5 re f /Z Do BT (deep) Tj ET", b"/Subtype /Form"),
    pdf_writer.stream(b"gone", b"/Subtype /Image /Width 0 /Height 3"),
]


def test_forms_pictures_and_paths(spark):
    content = (
        b"q 3 0 0 3 10 0 cm 0 0 10 10 re f* /X Do Q 1 1 m 50 60 l 2 2 70 80 9 9 c h B /I Do /N Do /Gone Do BT /F 1 Tf (end) Tj 0 0 50 50 re S ET q 0 1 -1 0 0 0 cm 10 20 30 40 re b Q Q"
        b" BI /W 2 /H 1 /BPC 8 /CS /G ID ab EI 5 0 m 5 90 l n 0 0 m 9 9 l S"
    )
    objs, pages = read(spark, f=one_page(content, FORM_RESOURCES, *FORMS))
    shown = shared.written(pdf_content.with_state(pdf_content.operators(objs, pages)), "shown")
    pictures = [(r.width, r.height, bytes(r.data)) for r in pdf_content.images(objs, pages, shown).orderBy("seq").collect()]
    assert pictures == [(2, 3, b"\x01\x02\x03\x04\x05\x06"), (2, 1, b"ab")]
    items = pdf_content.text_items(shown, pdf_content.fonts(objs, pages)).orderBy("seq").collect()
    assert [r.text for r in items] == ["deep", "in form", "end"]
    own = geometry.painted_paths(pdf_content.drawn(shown, pages), least=0.0, height=F.col("height")).orderBy("seq").collect()
    assert [(r.min_x, r.min_y, r.max_x, r.max_y, r.has_stroke, r.has_fill, r.path_ops) for r in own] == [
        (0, 190, 10, 200, False, True, 1), (0, 195, 30, 200, False, True, 1), (0, 190, 10, 200, True, False, 1), (1, 120, 70, 199, True, True, 4), (10, 140, 40, 180, True, True, 1), (0, 191, 9, 200, True, False, 2)
    ]
    placed = geometry.painted_paths(pdf_content.drawn(shown, pages, placed=True), least=0.0, height=F.col("height")).orderBy("seq").collect()
    # The form's box: doubled and moved by 5, then tripled and moved by 10; the inner form's moved by 100 before.
    assert [(r.min_x, 200 - r.max_y, r.max_x, 200 - r.min_y) for r in placed] == [(10, 0, 40, 30), (625, 15, 805, 45), (25, 15, 85, 75), (1, 1, 70, 80), (-60, 10, -20, 40), (0, 0, 9, 9)]


def test_states_by_a_plain_loop(spark):
    rng = random.Random(6)
    ops, loop, matrix, saved = [], [], (1, 0, 0, 1, 0, 0), []
    for _ in range(400):
        kind = rng.choice("qQcp")
        if kind == "q":
            ops.append("q")
            saved.append(matrix)
        elif kind == "Q":
            ops.append("Q")
            matrix = saved.pop() if saved else matrix
        elif kind == "c":
            m = [rng.choice([1, 0, -1, 0.5]) for _ in range(4)] + [rng.randrange(9), rng.randrange(9)]
            ops.append(" ".join(map(str, m)) + " cm")
            a, b = m, matrix
            matrix = (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])
        else:
            ops.append("1 2 m 3 4 l S")
            loop.append(tuple(matrix))
    objs, pages = read(spark, f=one_page("\n".join(ops).encode()))
    shown = pdf_content.with_state(pdf_content.operators(objs, pages)).where(F.col("op") == geometry.CONSTRUCT).orderBy("seq")
    assert [tuple(r.matrix) for r in shown.collect()] == loop


def test_many_pages_keep_their_order(spark):
    pages = [[f"page {k}"] for k in range(150)]
    assert texts(spark, f=pdf_writer.text_file(pages)) == {("f", k + 1): f"page {k}" for k in range(150)}


def test_pages_are_read_in_one_walk(spark):
    """Pages with and without forms, in more than one block, by shared and own fonts: as by rows of operators."""
    many = pdf_writer.text_file([[f"page {k} é", "", "𝄞ß"] for k in range(150)], marks=["q 2 0 0 2 10 20 cm 0 0 30 10 re S Q 0 0 m 5 40 l B"] * 150, picture=b"abc")
    formed = one_page(b"BT /F 1 Tf (plain) Tj ET /X Do", b"/XObject << /X 5 0 R >> /Font << /F << /Subtype /Type1 >> >>", pdf_writer.stream(b"BT /F 1 Tf (in form) Tj ET 0 0 10 10 re S", b"/Subtype /Form"))
    other = one_page(b"BT (no font) Tj /G 1 Tf [(A) -300 (B)] TJ ET", b"/Font << /G << /Subtype /Type1 /Encoding << /Differences [65 /fi] >> >> >>")
    empty = one_page(b"0 0 m", b"")
    objs, pages = read(spark, many=many, formed=formed, other=other, empty=empty)
    by_rows = shared.written(pdf_content.with_state(pdf_content.operators(objs, pages)), "shown")
    key = lambda rows: sorted(map(str, rows))
    assert key(pdf_content.shown(objs, pages).collect()) == key(by_rows.collect())
    assert key(pdf_content.shown(objs, pages, (pdf_content.PICTURE,)).collect()) == key(by_rows.where(F.col("op") == pdf_content.PICTURE).collect())
    got = {(r.doc_id, r.page): r.text for r in pdf_content.page_texts(objs, pages).collect()}
    assert got == {(r.doc_id, r.page): r.text for r in pdf.page_texts(pdf_content.text_items(by_rows, pdf_content.fonts(objs, pages))).collect()}
    assert len(got) == 152 and got["formed", 1] == "plain in form" and got["other", 1] == "no font ﬁ B" and got["many", 130] == "page 129 é  𝄞ß"
    alone, pages = read(spark, many=many)
    assert pdf_content.page_texts(alone, pages).count() == 150
    assert key(pdf_content.shown(alone, pages).collect()) == key(by_rows.where("doc_id = 'many'").collect())


def test_nothing_is_broadcast(spark, monkeypatch):
    """Written tables are small as files; their rows would not fit the driver of a large run."""
    plans, seen = [], lambda df: plans.append(df._jdf.queryExecution().toString())
    raw = pdf_writer.text_file([["one", "two"], ["three"], ["four"]], "Title", ["a", "b", "c"], ["0 0 30 10 re S"] * 3, b"abc")
    objs, pages = read(spark, f=raw)

    def told(df, name):
        seen(df)
        return shared.written(df, name)

    for module in (pdf_objects, pdf_content, ranking):
        monkeypatch.setattr(module, "written", told)
    seen(pdf_objects.page_nodes(objs))
    seen(pdf_objects.metadata(objs, pages))
    seen(pdf_objects.outline(objs, pages, pdf_objects.destinations(objs, pages)))
    seen(pdf_content.page_texts(objs, pages))
    shown = pdf_content.shown(objs, pages)
    seen(pdf_content.images(objs, pages, shown))
    seen(geometry.painted_paths(pdf_content.drawn(shown, pages, placed=True), height=F.col("height")))
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not [p for p in plans if "Broadcast" in p]
