"""What PDF pages show, from object rows: text items, pictures and drawn paths.

The graphics state (matrix and font, saved and restored) is carried along a page's
operators, and the characters of strings are looked up in their font's intervals of
codes.  A page without forms is read in one walk from its streams, which stand behind
the fonts of their block of pages in sorted partitions (``shown``, ``page_texts``); a
page's streams and a block's fonts are held in memory.  Of pages with forms, content
streams become rows of operators, forms are spliced in by joins, a level at a time, and
both walks go over sorted rows, so that no page is held in memory.

Defined cases: pages without contents have no rows; names without a resource paint
nothing; a string in an unknown font is read as Latin-1; what cannot be parsed ends its
stream; restores without a save are ignored; a form within itself is left out.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.operators import geometry
from pagemill.sources import pdf, pdf_syntax
from pagemill.sources.pdf_objects import field, number_of, resolved
from pagemill.sources.shared import written

#: Operators of the page description and the numbers that they go by (fixed values).
SHOW, PICTURE, INLINE = 44, 85, 86
CONSTRUCTS = {"m": (13, 2), "l": (14, 2), "c": (15, 6), "v": (16, 4), "y": (17, 4), "h": (18, 0), "re": (19, 4)}
PAINTS = {"S": 20, "s": 21, "f": 22, "F": 22, "f*": 23, "B": 24, "B*": 25, "b": 26, "b*": 27, "n": 28}
KEPT = {"q", "Q", "cm", "BT", "ET", "Tf", "Tj", "TJ", "'", '"', "Do"}
GAP = -200  #: thousandths by which a string goes on further to the right than this is a space
LEVELS = 16  #: of forms within forms
SALTS = 16  #: tasks that a font's strings are dealt to
BLOCK = 64  #: pages that stay together behind their fonts
ROW = "seq int, op string, nums array<double>, texts array<binary>, name string, subs array<int>"


def instructions(data: bytes):
    """(op, nums, texts, name, subs) of a content stream; a null text is a gap; op "path" holds all of a path's parts."""
    lex, operands, subs, coords = pdf_syntax.Lexer(data), [], [], []
    numbers = lambda: [float(x) for x in operands if isinstance(x, (int, float)) and not isinstance(x, bool)]
    while True:
        try:
            v = lex.value(references=False)
        except pdf_syntax.Damage:
            return
        if not isinstance(v, tuple):
            operands.append(v)
            continue
        op = v[0].decode("latin-1")
        nums = numbers()
        if op in CONSTRUCTS:
            number, n = CONSTRUCTS[op]
            if len(nums) >= n:
                subs.append(number)
                coords += nums[len(nums) - n :]
        elif op in PAINTS:
            if subs:
                yield "path", coords, [], None, subs
                subs, coords = [], []
            yield op, [], [], None, []
        elif op == "BI":
            yield from inline(lex)
        elif op in KEPT:
            texts, name = [], next((str(x) for x in operands if isinstance(x, pdf_syntax.Name)), None)
            for x in operands:
                if isinstance(x, bytes):
                    texts.append(x)
                elif isinstance(x, list):
                    texts += [y if isinstance(y, bytes) else None for y in x if isinstance(y, bytes) or isinstance(y, (int, float)) and y < GAP]
            yield op, nums, texts, name, []
        operands = []


def inline(lex: pdf_syntax.Lexer):
    """A picture within the stream: its size, and its data as the only text."""
    entries, key = {}, None
    while True:
        v = lex.value(references=False)
        if v == (b"ID",):
            break
        if key is None:
            key = str(v)
        else:
            entries[key], key = v, None
    end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r /]|$)").search(lex.raw, lex.at)
    if end is None:
        raise pdf_syntax.Damage("a picture without an end")
    raw, lex.at = lex.raw[lex.at + 1 : end.start()], end.end()
    size = [entries.get(a, entries.get(b)) for a, b in (("W", "Width"), ("H", "Height"))]
    if all(isinstance(x, int) for x in size):
        try:
            raw = pdf_syntax.decoded(raw, entries)[0]
        except (pdf_syntax.Damage, ValueError, TypeError):
            return
        yield "BI", [float(x) for x in size], [raw], None, []


def parsed(streams: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, op, nums, texts, name, subs): the operators of streams (keys, data)."""
    types = ", ".join(f"{k} {streams.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        names = [*keys, "seq", "op", "nums", "texts", "name", "subs"]
        kinds = [pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.string(), pa.list_(pa.int32())]
        for b in batches:
            for k in range(b.num_rows):
                found = [(s, *row) for s, row in enumerate(instructions(b.column("data")[k].as_py() or b""))]
                for lo in range(0, len(found), 4096):
                    part = found[lo : lo + 4096]
                    own = [pa.array([b.column(c)[k].as_py()] * len(part), b.schema.field(c).type) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True))], names)

    return streams.select(*keys, "data").mapInArrow(run, f"{types}, {ROW}")


def forms_of(objs: DataFrame) -> DataFrame:
    return objs.where(F.col("value").contains('"/Form"') & (field("value", "Subtype") == "/Form"))


def named_resources(objs: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """(doc_id, scope, name, num, value): the entries of one kind in the resources of pages (scope "p" and the page) and forms ("f" and the object)."""
    forms = forms_of(objs).select("doc_id", F.concat(F.lit("f"), F.col("num")).alias("scope"), field("value", "Resources").alias("of"))
    own = pages.select("doc_id", F.concat(F.lit("p"), F.col("page")).alias("scope"), F.col("resources").alias("of")).unionByName(resolved(forms, objs, "of"))
    own = resolved(own.select("doc_id", "scope", field("of", kind).alias("of")), objs, "of")
    each = own.select("doc_id", "scope", F.explode(F.from_json("of", "map<string,string>")).alias("name", "value"))
    return resolved(each.withColumn("num", number_of(F.col("value"))), objs, "value")


def page_parts(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, k, data): the streams that pages consist of, in the order of k."""
    data = objs.where("data IS NOT NULL").select("doc_id", "num", "data")
    parts = F.when(F.col("contents").startswith("["), F.from_json("contents", "array<string>")).otherwise(F.array("contents"))
    # A reference may also lead to an array of streams.
    listed = resolved(pages.withColumn("inner", F.col("contents")), objs, "inner")
    parts = F.when(F.col("inner").startswith("["), F.from_json("inner", "array<string>")).otherwise(parts)
    streams = listed.where("contents IS NOT NULL").select("doc_id", "page", F.posexplode(parts).alias("k", "part")).withColumn("num", number_of(F.col("part")))
    return streams.join(data.hint("merge"), ["doc_id", "num"]).select("doc_id", "page", "k", "data")


def operators(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, scope, at, op, nums, texts, name, subs): pages' operators, forms spliced in; at puts them in order."""
    whole = page_parts(objs, pages).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("s"))
    # A page's parts make one stream, with white space between.
    joined = F.aggregate("s", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["data"], F.lit(b"\n")))
    rows = parsed(whole.select("doc_id", "page", joined.alias("data")), "doc_id", "page")
    rows = rows.withColumn("scope", F.concat(F.lit("p"), F.col("page"))).withColumn("at", F.array("seq")).withColumn("above", F.array().cast("array<long>"))
    columns = ["doc_id", "page", "scope", "at", "op", "nums", "texts", "name", "subs"]
    form = forms_of(objs).where("data IS NOT NULL").select("doc_id", F.col("num").alias("form"), "data", F.from_json(field("value", "Matrix"), "array<double>").alias("matrix"), field("value", "Resources").isNotNull().alias("own"))
    inside = parsed(form, "doc_id", "form").unionByName(form.select("doc_id", "form", F.lit(-1).alias("seq"), F.lit("cm").alias("op"), "matrix").where("matrix IS NOT NULL").select("doc_id", "form", "seq", "op", F.col("matrix").alias("nums")), allowMissingColumns=True)
    for op, seq in (("q", -2), ("Q", 2**31 - 1)):
        inside = inside.unionByName(form.select("doc_id", "form", F.lit(seq).alias("seq"), F.lit(op).alias("op")), allowMissingColumns=True)
    known = named_resources(objs, pages, "XObject").where(field("value", "Subtype") == "/Form").select("doc_id", "scope", "name", F.col("num").alias("form"))
    known = known.join(form.select("doc_id", "form", "own").hint("merge"), ["doc_id", "form"])
    rows = written(rows.select(*columns, "above"), "operators")
    out = rows.select(*columns)
    if known.isEmpty():
        return out
    inside = written(inside, "forms")
    for _ in range(LEVELS):
        calls = rows.where("op = 'Do'").select("doc_id", "page", "scope", "name", "at", "above").join(known.hint("merge"), ["doc_id", "scope", "name"]).where(~F.array_contains("above", F.col("form")))
        calls = calls.select("doc_id", "page", "form", F.col("at").alias("from"), F.when(F.col("own"), F.concat(F.lit("f"), F.col("form"))).otherwise(F.col("scope")).alias("scope"), F.concat("above", F.array("form")).alias("above"))
        rows = written(calls.join(inside.hint("merge"), ["doc_id", "form"]).withColumn("at", F.concat("from", F.array("seq"))).select(*columns, "above"), "operators")
        if rows.isEmpty():
            break
        out = out.unionByName(rows.select(*columns))
    return out


def product(a: tuple, b: tuple) -> tuple:
    """The matrix that applies a and then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def on_page(m: tuple, subs: list[int], coords: list[float]) -> dict:
    """A path by a matrix; a rectangle becomes the lines along its corners."""
    parts, points, k = [], [], 0
    for s in subs:
        n = geometry._USED.get(s, 0)
        own = coords[k : k + n]
        k += n
        if s == geometry.RECT:
            x, y, w, h = own
            own = [x, y, x + w, y, x + w, y + h, x, y + h]
            parts += [geometry.MOVE, geometry.LINE, geometry.LINE, geometry.LINE]
        else:
            parts.append(s)
        for x, y in zip(own[::2], own[1::2], strict=True):
            points += [x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]]
    return {"subs": parts, "coords": points}


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
NUMBERS = {"BT": geometry.BEGIN_TEXT, "ET": geometry.END_TEXT, "path": geometry.CONSTRUCT, "Do": PICTURE, "BI": INLINE, "Tj": SHOW, "TJ": SHOW, "'": SHOW, '"': SHOW} | PAINTS
DRAWING = tuple({*NUMBERS.values()} - {SHOW, PICTURE, INLINE})
SHOWN = "page long, seq long, op int, matrix array<double>, font array<string>, scope string, name string, texts array<binary>, subs array<int>, coords array<double>, on_page struct<subs:array<int>,coords:array<double>>"
FIELDS = [("page", pa.int64()), ("seq", pa.int64()), ("op", pa.int32()), ("matrix", pa.list_(pa.float64())), ("font", pa.list_(pa.string())), ("scope", pa.string()), ("name", pa.string()), ("texts", pa.list_(pa.binary())), ("subs", pa.list_(pa.int32())), ("coords", pa.list_(pa.float64())), ("on_page", pa.struct([("subs", pa.list_(pa.int32())), ("coords", pa.list_(pa.float64()))]))]


class Walk:
    """The graphics state along a page's operators."""

    def __init__(self):
        self.matrix, self.font, self.saved, self.seq = UNIT, None, [], 0

    def step(self, op: str, nums: list, name: str | None, scope: str) -> bool:
        """Whether the operator shows something, which is number seq then."""
        if op == "q":
            self.saved.append((self.matrix, self.font))
        elif op == "Q":
            self.matrix, self.font = self.saved.pop() if self.saved else (self.matrix, self.font)
        elif op == "cm":
            self.matrix = product(tuple(nums[:6]), self.matrix) if len(nums) >= 6 else self.matrix
        elif op == "Tf":
            self.font = [scope, name]
        else:
            self.seq += 1
            return True
        return False

    def row(self, op: str, nums: list, texts: list, name: str | None, subs: list, scope: str) -> tuple:
        return self.seq - 1, NUMBERS[op], list(self.matrix), self.font, scope, name, texts, subs, nums, on_page(self.matrix, subs, nums) if op == "path" else None


def shown_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * (len(FIELDS) + 1)
    types = [kind, *(t for _, t in FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", *(n for n, _ in FIELDS)])


def with_state(ops: DataFrame) -> DataFrame:
    """(doc_id, page, seq, op, matrix, font, scope, name, texts, subs, coords, on_page): what pages show, in order.

    matrix and font (its scope and name) are those in force; on_page: a path's parts and
    coordinates by the matrix; op is a number: SHOW, PICTURE, INLINE, or of geometry.
    """
    kind = ops.schema["doc_id"].dataType.simpleString()

    def run(batches):
        page, walk = None, Walk()
        for b in batches:
            out = []
            where = list(zip(b.column("doc_id").to_pylist(), b.column("page").to_pylist(), strict=True))
            for own, op, nums, texts, name, subs, scope in zip(where, *(b.column(c).to_pylist() for c in ("op", "nums", "texts", "name", "subs", "scope")), strict=True):
                if own != page:
                    page, walk = own, Walk()
                if walk.step(op, nums, name, scope):
                    out.append((*own, *walk.row(op, nums, texts, name, subs, scope)))
            yield shown_batch(out, b.schema.field("doc_id").type)

    dealt = ops.withColumn("page", F.col("page").cast("long")).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "at")
    return dealt.mapInArrow(run, f"doc_id {kind}, {SHOWN}")


def parted(objs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """pages without forms among their resources, and the others; None if no file has forms."""
    if forms_of(objs).isEmpty():
        return pages, None
    calls = named_resources(objs, pages, "XObject").where((field("value", "Subtype") == "/Form") & F.col("scope").startswith("p"))
    calls = written(calls.select("doc_id", F.substring("scope", 2, 20).cast("long").alias("page")).distinct(), "calls")
    return tuple(pages.join(calls.hint("merge"), ["doc_id", "page"], how) for how in ("left_anti", "left_semi"))


def block_of(page: str) -> Column:
    return F.floor((F.col(page) - 1) / BLOCK).cast("long")


def whole_pages(batches, font=None):
    """(doc_id, page, data) of sorted parts; font is called with the rows before a block's pages."""
    own, held = None, []
    for b in batches:
        where = list(zip(b.column("doc_id").to_pylist(), b.column("page").to_pylist(), strict=True))
        kinds = b.column("kind").to_pylist() if font else None
        for k, place in enumerate(where):
            if place != own:
                if held:
                    yield *own, b"\n".join(held)
                own, held = place, []
            if kinds and not kinds[k]:
                font(b, k)
            else:
                held.append(b.column("data")[k].as_py() or b"")
    if held:
        yield *own, b"\n".join(held)


def shown(objs: DataFrame, pages: DataFrame, wanted: tuple[int, ...] | None = None) -> DataFrame:
    """As with_state over operators; wanted: the numbers of operators that have rows, all if not given."""
    plain, formed = parted(objs, pages)
    parts = page_parts(objs, plain)
    kind, own = (f(parts.schema["doc_id"].dataType) for f in (lambda t: t.simpleString(), to_arrow_type))

    def run(batches):
        out = []
        for doc_id, page, data in whole_pages(batches):
            walk, scope = Walk(), f"p{page}"
            for op, nums, texts, name, subs in instructions(data):
                if walk.step(op, nums, name, scope) and (wanted is None or NUMBERS[op] in wanted):
                    out.append((doc_id, page, *walk.row(op, nums, texts, name, subs, scope)))
                    if len(out) == 4096:
                        yield shown_batch(out, own)
                        out = []
        yield shown_batch(out, own)

    found = parts.withColumn("block", block_of("page")).repartition("doc_id", "block").sortWithinPartitions("doc_id", "page", "k")
    found = found.select("doc_id", "page", "data").mapInArrow(run, f"doc_id {kind}, {SHOWN}")
    if formed is None:
        return found
    rest = with_state(operators(objs, formed))
    return found.unionByName(rest if wanted is None else rest.where(F.col("op").isin(*wanted)))


# ---------------------------------------------------------------- fonts


#: Glyph names that no rule gives (fixed values).
GLYPHS = dict(
    space=" ", exclam="!", quotedbl='"', numbersign="#", dollar="$", percent="%", ampersand="&", quotesingle="'", parenleft="(", parenright=")", asterisk="*", plus="+", comma=",", hyphen="-", minus="−", period=".", slash="/", colon=":", semicolon=";",
    less="<", equal="=", greater=">", question="?", at="@", bracketleft="[", backslash="\\", bracketright="]", asciicircum="^", underscore="_", grave="`", braceleft="{", bar="|", braceright="}", asciitilde="~", quoteleft="‘", quoteright="’",
    quotedblleft="“", quotedblright="”", quotedblbase="„", quotesinglbase="‚", bullet="•", endash="–", emdash="—", ellipsis="…", dagger="†", daggerdbl="‡", fi="ﬁ", fl="ﬂ", ff="ﬀ", ffi="ﬃ", ffl="ﬄ", germandbls="ß", ae="æ", AE="Æ", oe="œ", OE="Œ",
    oslash="ø", Oslash="Ø", dotlessi="ı", lslash="ł", Lslash="Ł", guillemotleft="«", guillemotright="»", guilsinglleft="‹", guilsinglright="›", Euro="€", sterling="£", yen="¥", cent="¢", section="§", paragraph="¶", copyright="©",
    registered="®", trademark="™", degree="°", plusminus="±", multiply="×", divide="÷", mu="µ", exclamdown="¡", questiondown="¿", ordfeminine="ª", ordmasculine="º", nbspace="\xa0",
)
ACCENTS = dict(grave="̀", acute="́", circumflex="̂", tilde="̃", macron="̄", breve="̆", dotaccent="̇", dieresis="̈", ring="̊", caron="̌", cedilla="̧", ogonek="̨")
DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def glyph_text(name: str) -> str:
    """The text of a glyph by its name; empty if unknown."""
    name = name.split(".")[0] or name
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name)
    if m:
        return "".join(chr(int(m[1][k : k + 4], 16)) for k in range(0, len(m[1]), 4)) if m[1] else chr(int(m[2], 16)) if int(m[2], 16) < 0x110000 else ""
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    if name in DIGITS:
        return str(DIGITS.index(name))
    return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]]) if name[1:] in ACCENTS else ""


def code_map(data: bytes) -> tuple[int, list[tuple[int, int, str]]]:
    """The bytes of a code, and (first code, last code, text of the first one), of a ToUnicode stream."""
    lex, values, width, out = pdf_syntax.Lexer(data), [], 0, []
    text = lambda v: v.decode("utf-16-be", "replace") if isinstance(v, bytes) else ""
    code = lambda v: int.from_bytes(v, "big") if isinstance(v, bytes) else 0
    while True:
        try:
            v = lex.value(references=False)
        except pdf_syntax.Damage:
            break
        if not isinstance(v, tuple):
            values.append(v)
            continue
        if v[0] == b"endcodespacerange":
            width = max([width, *(len(x) for x in values if isinstance(x, bytes))])
        elif v[0] == b"endbfchar":
            out += [(code(a), code(a), text(b)) for a, b in zip(values[::2], values[1::2], strict=False)]
        elif v[0] == b"endbfrange":
            for a, b, to in zip(values[::3], values[1::3], values[2::3], strict=False):
                if isinstance(to, list):
                    out += [(code(a) + k, code(a) + k, text(x)) for k, x in enumerate(to)]
                else:
                    out.append((code(a), code(b), text(to)))
        values = []
    return width, out


def intervals(font: dict, encoding, to_unicode: bytes | None) -> tuple[int, list[int], list[int], list[str]]:
    """(bytes of a code, first codes in order, last codes, texts of the first codes): later intervals of the same code count more."""
    composite = font.get("Subtype") == "/Type0"
    width, found = (2 if composite else 1), []
    base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
    if not composite:
        codec = {"/MacRomanEncoding": "mac_roman", "/WinAnsiEncoding": "cp1252"}.get(base, "latin-1")
        found = [(c, c, bytes([c]).decode(codec, "ignore")) for c in range(256)]
        if codec == "latin-1":
            found += [(0x27, 0x27, "’"), (0x60, 0x60, "‘")] if base == "/StandardEncoding" else []
        at = 0
        for x in (encoding.get("Differences") or []) if isinstance(encoding, dict) else []:
            if isinstance(x, str):
                found.append((at, at, glyph_text(x[1:])))
                at += 1
            else:
                at = int(x)
    if to_unicode:
        own, more = code_map(to_unicode)
        width, found = (own or width) if composite else width, found + more
    return width, *unrolled(found)


def unrolled(found: list[tuple[int, int, str]]) -> tuple[list[int], list[int], list[str]]:
    """Disjoint intervals in order, of intervals of which later ones count more."""
    edges = sorted({x for a, b, _ in found for x in (a, b + 1)})
    holder = [None] * max(len(edges) - 1, 0)
    at = {e: k for k, e in enumerate(edges)}
    for a, b, to in found:
        for k in range(at[a], at[b + 1]) if b >= a else ():
            holder[k] = (a, to)
    lo, hi, text = [], [], []
    for k, own in enumerate(holder):
        if own is not None:
            lo.append(edges[k])
            hi.append(edges[k + 1] - 1)
            text.append(shifted(own[1], edges[k] - own[0]))
    return lo, hi, text


def shifted(text: str, by: int) -> str:
    """A text whose last character is that many further on."""
    if not text or not by:
        return text
    last = ord(text[-1]) + by
    return text[:-1] + (chr(last) if last < 0x110000 and not 0xD800 <= last < 0xE000 else "�")


def reader(width: int, lo: list[int], hi: list[int], texts: list[str], composite: bool):
    """What reads a string's codes by bisection of the intervals; one that is in none is read as itself if codes are composite."""
    lo, hi = np.array([*lo, 1 << 62], np.int64), np.array([*hi, 0], np.int64)
    # Intervals of single characters are read by adding; others one by one.
    single = np.array([ord(t) if len(t) == 1 else -1 for t in [*texts, ""]], np.int64)
    weights = (256 ** np.arange(width - 1, -1, -1)).astype(np.int64)

    def read(raw: bytes) -> str:
        n = len(raw) // width
        codes = np.frombuffer(raw[: n * width], np.uint8).reshape(n, width).astype(np.int64) @ weights
        at = np.searchsorted(lo, codes, "right") - 1
        inside = (at >= 0) & (codes <= hi[at])
        points = single[at] + codes - lo[at]
        if (inside & (single[at] >= 0) & (points < 0x110000) & ((points < 0xD800) | (points >= 0xE000))).all():
            return points.astype("<u4").tobytes().decode("utf-32-le")
        out = []
        for c, k, known in zip(codes.tolist(), at.tolist(), inside.tolist(), strict=True):
            if known:
                out.append(shifted(texts[k], c - int(lo[k])))
            elif composite and c < 0x110000 and not 0xD800 <= c < 0xE000:
                out.append(chr(c))
        return "".join(out)

    return read


def string_text(texts: list[bytes | None], read) -> str:
    """The parts of a shown string, with a space for each gap."""
    return "".join(" " if x is None else read(x) for x in texts)


def latin(raw: bytes) -> str:
    return raw.decode("latin-1")


def font_of(value: str | None, encoding: str | None, to_unicode: bytes | None) -> tuple:
    """(width, lo, hi, texts, composite) of a font's dictionary and what it refers to."""
    font = json.loads(value or "{}")
    font = font if isinstance(font, dict) else {}
    encoding = json.loads(encoding) if encoding and encoding[:1] == "{" else encoding
    return *intervals(font, encoding, to_unicode), font.get("Subtype") == "/Type0"


def font_rows(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, scope, name, value, encoding, num): the fonts of each scope; num: of the stream that says which characters codes are."""
    found = named_resources(objs, pages, "Font").select("doc_id", "scope", "name", "value", field("value", "Encoding").alias("encoding"), number_of(field("value", "ToUnicode")).alias("num"))
    return resolved(found, objs, "encoding")


def fonts(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, scope, name, width, lo, hi, texts, composite): how each font of each scope reads codes."""
    found = font_rows(objs, pages).join(objs.select("doc_id", "num", "data").hint("merge"), ["doc_id", "num"], "left")

    def run(batches):
        for b in batches:
            rows = [font_of(*(b.column(c)[k].as_py() for c in ("value", "encoding", "data"))) for k in range(b.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "scope", "name")), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "scope", "name", "width", "lo", "hi", "texts", "composite"])

    kind = objs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "scope", "name", "value", "encoding", "data").mapInArrow(run, f"doc_id {kind}, scope string, name string, width int, lo array<long>, hi array<long>, texts array<string>, composite boolean")


def text_items(shown: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text): an item for each string that is shown, from rows of with_state and the fonts.

    A font's row is sorted before the strings in it, which follow as a stream.
    """
    salt = lambda c: F.pmod(F.xxhash64(*c), F.lit(SALTS))
    strings = shown.where(F.col("op") == SHOW).select("doc_id", F.get("font", F.lit(0)).alias("scope"), F.get("font", F.lit(1)).alias("name"), salt(("page", "seq")).alias("salt"), F.lit(1).alias("kind"), "page", "seq", "texts")
    first = tables.select("doc_id", "scope", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), F.struct("width", "lo", "hi", "texts", "composite").alias("table"))
    cell = ["doc_id", "scope", "name", "salt"]
    both = strings.withColumn("table", F.lit(None).cast(first.schema["table"].dataType)).unionByName(first, allowMissingColumns=True)
    kind = shown.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, table = None, latin
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in cell), strict=True))
            kinds = b.column("kind").to_pylist()
            out = [[], [], []]
            for k, (key, is_string) in enumerate(zip(keys, kinds, strict=True)):
                if not is_string:
                    t = b.column("table")[k].as_py()
                    own, table = key, reader(*(t[c] for c in ("width", "lo", "hi", "texts", "composite")))
                    continue
                parts = b.column("texts")[k].as_py() or []
                out[0].append(b.column("page")[k].as_py())
                out[1].append(b.column("seq")[k].as_py())
                out[2].append(string_text(parts, table if own == key else latin))
            strings = [k for k, s in enumerate(kinds) if s]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(strings, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "page", "seq", "text"])

    dealt = both.select(*cell, "kind", "page", "seq", "texts", "table").repartition(*cell).sortWithinPartitions(*cell, "kind")
    return dealt.mapInArrow(run, f"doc_id {kind}, page long, seq long, text string")


def page_texts(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): the strings that each page shows, joined by single spaces; pages that show none have no rows."""
    plain, formed = parted(objs, pages)
    parts = page_parts(objs, plain).select("doc_id", block_of("page").alias("block"), F.lit(1).alias("kind"), "page", "k", "data")
    of = font_rows(objs, plain).where(F.col("scope").startswith("p")).withColumn("page", F.substring("scope", 2, 20).cast("long"))
    # A font that several pages of a block name is there once.
    of = of.groupBy("doc_id", block_of("page").alias("block"), "value", "encoding", "num").agg(F.collect_list(F.struct("page", "name")).alias("uses"))
    of = of.join(objs.select("doc_id", "num", "data").hint("merge"), ["doc_id", "num"], "left").select("doc_id", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("page"), F.lit(0).alias("k"), "data", "value", "encoding", "uses")
    kind, own = (f(parts.schema["doc_id"].dataType) for f in (lambda t: t.simpleString(), to_arrow_type))

    def run(batches):
        block, known = None, {}

        def font(b, k):
            nonlocal block, known
            place = b.column("doc_id")[k].as_py(), b.column("block")[k].as_py()
            if place != block:
                block, known = place, {}
            read = reader(*font_of(*(b.column(c)[k].as_py() for c in ("value", "encoding", "data"))))
            known |= {(place[0], u["page"], u["name"]): read for u in b.column("uses")[k].as_py()}

        out, size = [], 0
        for doc_id, page, data in whole_pages(batches, font):
            walk, strings = Walk(), []
            for op, nums, texts, name, _ in instructions(data):
                if walk.step(op, nums, name, "") and NUMBERS[op] == SHOW:
                    strings.append(string_text(texts, known.get((doc_id, page, walk.font[1]), latin) if walk.font else latin))
            if strings:
                out.append((doc_id, page, " ".join(strings)))
                size += len(out[-1][2])
            if size > 4 << 20 or len(out) == 4096:
                yield batch(out)
                out, size = [], 0
        yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((own, pa.int64(), pa.string()))], ["doc_id", "page", "text"])

    both = parts.unionByName(of, allowMissingColumns=True).repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "kind", "page", "k")
    found = both.mapInArrow(run, f"doc_id {kind}, page long, text string")
    if formed is None:
        return found
    items = text_items(with_state(operators(objs, formed)), fonts(objs, formed))
    return found.unionByName(pdf.page_texts(items))


# ---------------------------------------------------------------- pictures and paths


def images(objs: DataFrame, pages: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc_id, page, seq, width, height, data): the pictures that pages paint; data is as far decoded as general filters go."""
    name = F.concat_ws("/", "scope", "name")
    shown = written(shown.where(F.col("op").isin(PICTURE, INLINE)).select("doc_id", "page", "seq", "op", "scope", "name", "texts", "coords"), "pictures")
    ops = shown.where(F.col("op").isin(PICTURE, INLINE)).select("doc_id", "page", "seq", "op", F.when(F.col("op") == PICTURE, name).otherwise(F.concat(F.lit("inline/"), F.col("seq"))).alias("name"))
    known = named_resources(objs, pages, "XObject").where(field("value", "Subtype") == "/Image")
    size = lambda c: field("value", c).try_cast("long").alias(c.lower())
    known = known.select("doc_id", "num", name.alias("name"), size("Width"), size("Height")).join(objs.select("doc_id", "num", "data").hint("merge"), ["doc_id", "num"]).drop("num")
    # One row for each page that paints the picture.
    used = ops.where(F.col("op") == PICTURE).select("doc_id", "page", "name").distinct().join(known.hint("merge"), ["doc_id", "name"])
    own = shown.where(F.col("op") == INLINE).select("doc_id", "page", F.concat(F.lit("inline/"), F.col("seq")).alias("name"), F.get("texts", F.lit(0)).alias("data"), F.get("coords", F.lit(0)).cast("long").alias("width"), F.get("coords", F.lit(1)).cast("long").alias("height"))
    return pdf.embedded_images(ops, used.unionByName(own))


def drawn(shown: DataFrame, pages: DataFrame, placed: bool = False) -> DataFrame:
    """(page_id struct<doc_id,page>, seq, op, sub_ops, coords, height): drawing operators as geometry.painted_paths takes them.

    height: of the page, for its ``height``; placed: whether coordinates are those on the
    page, by the matrices in force, or those of the path itself.
    """
    drawing = shown.where(~F.col("op").isin(SHOW, PICTURE, INLINE))
    if placed:
        drawing = drawing.withColumn("subs", F.col("on_page.subs")).withColumn("coords", F.col("on_page.coords"))
    box = pages.select("doc_id", "page", (F.get("box", F.lit(3)) - F.get("box", F.lit(1))).alias("height"))
    out = drawing.join(box.hint("merge"), ["doc_id", "page"], "left").withColumn("height", F.coalesce("height", F.lit(792.0)))
    return out.select(F.struct("doc_id", "page").alias("page_id"), "seq", "op", F.col("subs").alias("sub_ops"), "coords", "height")
