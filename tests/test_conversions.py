"""Whole conversions against a plain reading of their rules, offline and by live calls."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import execution, live, passes, pipelines, structure
from pagemill.operators import sections as S
from pagemill.operators.providers import Offline
from pagemill.sources import corpus

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import a test module

HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def presence(text):
    low = text.lower()
    counts = [sum(bool(re.search(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])" if w.isascii() else rf"(?<=[A-Za-z0-9_]){w}(?=[A-Za-z0-9_])", low)) for w in ws) for _, ws in T.PRESENCE]
    return T.PRESENCE[counts.index(max(counts))][0] if max(counts) >= 3 else "Unknown"


def frequency(text):
    low = text.lower()[:2000]
    counts = [sum(len(re.findall(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])" if w.isascii() else rf"(?<=[A-Za-z0-9_]){w}(?=[A-Za-z0-9_])", low)) for w in ws) for _, ws in T.FREQUENCY]
    return T.FREQUENCY[counts.index(max(counts))][0] if max(counts) >= 1 else "en"


def trim(t):
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t)


def noted(t, empty=True):
    t = re.sub(r"!\[(.*?)\]\((img_placeholder_[a-zA-Z0-9_]+)\)", r"> *[Image: \1]*", t)
    return re.sub(r"!\[(.*?)\]\(\s*\)", r"> *[Image: \1]*", t) if empty else t


def common(lines):
    if len(lines) < 3:
        return None
    for x in dict.fromkeys(lines):
        if lines.count(x) >= len(lines) * 0.5 and len(x) > 2:
            return x
    return "\\d+" if all(re.fullmatch(r"\d+", x) for x in lines) else None


def edges(pages, k, more):
    n = len(pages)
    if n <= more:
        return None, None
    k = min(k, n)
    firsts, lasts = [], []
    for i in range(1, k + 1):
        ls = [trim(x) for x in pages[-(-i * n // (k + 1)) - 1].split("\n")]
        ls = [x for x in ls if x]
        firsts += ls[:1]
        lasts += ls[-1:] if len(ls) > 1 else []
    return common(firsts), common(lasts)


def merge(parts, edge, tail):
    out = []
    for i, whole in enumerate(parts):
        t = whole
        if edge[0]:
            t = re.sub(rf"(?m)^{re.escape(edge[0])}\s*\n?", "", t)
        if edge[1]:
            t = re.sub(rf"(?m)\n?{re.escape(edge[1])}\s*$", "", t)
        if i < len(parts) - 1:
            following = parts[i + 1].lstrip()
            if tail(whole, t) and (re.match("[a-z]", following) or not following.startswith("#")):
                out.append(t.rstrip() + " ")
                continue
        out.append(trim(t))
    return "\n\n".join(out)


def last_paragraph(t):
    parts = [p for p in re.split(r"\n\n+", t) if trim(p) and not trim(p).startswith("#")]
    return parts[-1][-500:] if parts else ""


def is_open(t):
    return not re.search(r"[.!?:;'\"]$", t)


def light(pages):
    return merge([noted(p) for p in pages], edges(pages, 5, 3), lambda _, t: is_open(t.rstrip())), presence("\n\n".join(pages[:5]))


def full(pages, size=50):
    n, starts = len(pages), [i + 1 for i, p in enumerate(pages) for x in p.split("\n") if HEADING.match(x)]
    at, parts = 1, []
    while at <= n:
        end = min(at + size - 1, n)
        brk = None
        for s in starts:
            if end - 10 <= s <= end and (not brk or s > brk):
                brk = s - 1
        end = brk if brk and brk > at else end
        parts.append("\n\n".join(noted(p, False) for p in pages[at - 1 : end]))
        at = end + 1
    sample = "".join(p + "\n\n" for p in [*pages[:5], *([pages[n // 2 - 1], pages[-1]] if n > 10 else [])])
    tail = lambda whole, _: bool(last_paragraph(whole)) and is_open(last_paragraph(whole))
    return merge(parts, edges(pages, 7, 4), tail), presence(sample)


def extract(pages, style="none", headers=(), numbers=r"^\s*(?:Page\s+)?\d+(?:\s+of\s+\d+)?\s*$", depth=2):
    out = []
    for k, t in enumerate(pages, 1):
        last = last_paragraph(t)
        for h in headers:
            t = re.sub(rf"(?m)^\s*{re.escape(h)}\s*$", "", t)
        t = trim(re.sub(r"\n{3,}", "\n\n", re.sub(f"(?m){numbers}", "", t)))
        notes = {}
        if style != "none":
            rx = S.NOTES[style]
            for i, c in re.findall(rx, t):
                notes.setdefault(i, trim(c))
            t = trim(re.sub(r"\n{3,}", "\n\n", re.sub(rx, "", t)))
        found: list = []
        for line in t.split("\n"):
            m = HEADING.match(line)
            if m:
                found.append({"level": min(len(m[1]), depth), "title": trim(m[2]), "lines": []})
            else:
                if not found:
                    found.append({"level": 0, "title": "", "lines": []})
                found[-1]["lines"].append(line)
        for j, s in enumerate(found, 1):
            s |= {"id": f"section-{k}-{j}", "content": trim("\n".join(s["lines"])), "from": None}
            s["refs"] = [i for i in notes if f"[{i}]" in s["content"]]
        if found and not found[-1]["content"] and not found[-1]["title"]:
            found.pop()
        if out and out[-1]["open"] and out[-1]["sections"]:
            for s in found:
                if out[-1]["last"] and s["content"] and is_open(trim(out[-1]["last"])) and (re.match("[a-z]", s["content"]) or not s["content"].startswith("#")):
                    s["from"] = out[-1]["sections"][-1]["id"]
        body = t.rstrip()
        out.append({"sections": found, "notes": notes, "last": last, "open": bool(body) and is_open(body)})
    return out


def organize(extracted, kind="other", toc=()):
    sections = [s for p in extracted for s in p["sections"]]
    notes = {i: c for p in extracted for i, c in p["notes"].items()}

    def below(i):
        return [x for s in sections if s["from"] == i for x in (s, *below(s["id"]))]

    ids = {s["id"] for s in sections}
    merged = []
    for s in sections:
        if s["from"] not in ids:
            chain = [s, *below(s["id"])]
            merged.append(s | {"content": "\n\n".join(x["content"] for x in chain), "refs": list(dict.fromkeys(r for x in chain for r in x["refs"]))})
    out, last, used, chapter, by_chapter, rest = [], 0, set(), None, {}, []
    if toc:
        out.append("## Table of Contents\n\n" + "\n".join(toc) + "\n")
    where = S.PLACEMENT.get(kind, "inline")
    tell = lambda i: f"[^{i}]: {notes[i]}"
    block = lambda x: "\n\n---\n\n" + "\n".join(map(tell, x))
    for k, s in enumerate(merged):
        level = s["level"]
        if level:
            level = (1 if level > 2 else level) if not last else min(level, last + 1)
            last = level
        if level == 1:
            chapter = s["id"]
        content = s["content"]
        for rx in (r"\[(\d+)\](?!\()", r"\((\d+)\)(?!\[)", r"\^(\d+)(?!\])"):
            content = re.sub(rx, r"[^\1]", content)
        content = re.sub(r"\{\{image:([^}]+)\}\}|\[image:([^\]]+)\]", "", content)
        md = "\n".join([*([f"{'#' * level} {s['title']}", ""] if s["title"] and level else []), *([content] if trim(content) else [])])
        out += [md, ""] if trim(md) else []
        for i in s["refs"]:
            if i not in used and i in notes:
                used.add(i)
                if where == "inline":
                    out += [tell(i), ""]
                elif where == "section-end" and chapter:
                    by_chapter.setdefault(chapter, []).append(i)
                else:
                    rest.append(i)
        if where == "section-end" and level == 1:
            before = [x["id"] for x in merged[:k] if x["level"] == 1]
            if before and before[-1] in by_chapter:
                out.append(block(by_chapter.pop(before[-1])))
    if where == "section-end":
        out += [block(x) for x in by_chapter.values()]
    if where == "document-end" and rest:
        out += ["", "---", "", "## Notes", "", *map(tell, rest)]
    t = re.sub(r"(?m)[ \t]+$", "", re.sub(r"\n{4,}", "\n\n\n", "\n".join(out)))
    t = trim(t) + "\n"
    for rx, to in ((r"(?m)^[-*+]\s*$", ""), (r"(?m)^#{1,6}\s*$", ""), (r"(?m)^(#{1,6})\s+\1\s+", r"\1 "), (r"(?m)^[-*_]{3,}$", "---")):
        t = re.sub(rx, to, t)
    return t


def intelligent(pages):
    got = extract(pages)
    return organize(got), frequency(" ".join([s["content"] for p in got for s in p["sections"]][:5]))


def direct(pages):
    return "\n\n".join(noted(p) for p in pages), presence(pages[0])


ODD = {
    -1: "",
    -2: "\n\n",
    -3: "# Title\nbegins here and\n12\n\ngoes on below\nwith more",
    -4: "\n".join(f"Running Head\nline {i} of text that ends\nand goes on {i}\nfoot {i % 2}" for i in range(9)),
    -5: "\n".join(f"Same Head\n{'# Part ' + str(i) if i % 3 == 0 else 'words ' + str(i)}\nSee [1] and (2) now.\nSame Foot" for i in range(12)),
    -6: "![a](img_placeholder_1)\n![b]( )\n![c](u)\n{{image:x}} [image:y]",
    -7: "\n".join(f"{i}" for i in range(40)),
    -8: "- \n## ## Twice  here\n*****\n\n\n\n\n\nend ",
    -9: "\n".join(f"### Deep {i}\ntext {i}" if i % 5 == 0 else f"page text {i} runs" for i in range(130)),
}


@pytest.fixture(scope="module")
def paged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(ODD.items()), "doc_id long, text string"))
    return corpus.paged_documents(docs).cache()


@pytest.fixture(scope="module")
def pages_of(paged):
    return {r.doc_id: r.pages for r in paged.collect()}


PLAIN = {"direct": direct, "light": light, "full": full, "intelligent": intelligent}


@pytest.mark.parametrize("name", PLAIN)
def test_conversion(paged, pages_of, name):
    got = {r.doc_id: r for r in pipelines.convert(paged, name).collect()}
    assert set(got) == set(pages_of)
    for i, pages in pages_of.items():
        assert (got[i].markdown, got[i].language) == PLAIN[name](pages), i
        assert got[i].n_pages == len(pages) and len(got[i].contents) == (1 if name == "intelligent" else len(got[i].contents))


def test_full_with_small_windows(paged, pages_of):
    got = {r.doc_id: r.markdown for r in pipelines.convert(paged, "full", size=12).collect()}
    assert all(got[i] == full(p, 12)[0] for i, p in pages_of.items())


def test_adaptive(paged, pages_of):
    rows = pipelines.adaptive(paged).collect()
    assert {r.pipeline for r in rows} >= {"direct", "intelligent"} and {r.level for r in rows} <= {"simple", "moderate", "complex"}
    for r in rows:
        assert (r.markdown, r.language) == PLAIN[r.pipeline](pages_of[r.doc_id])


def test_legacy(paged, pages_of):
    for r in pipelines.convert(paged, "legacy").collect():
        assert r.markdown == "".join(re.sub(r"!\[(.*?)\]\(\s*\)", r"> *[Image missing: \1]*", re.sub(r"!\[(.*?)\]\((img_placeholder_[a-zA-Z0-9_]+)\)", r"> *[Image extraction failed or coordinates missing for: \1]*", p)) + "\n\n" for p in pages_of[r.doc_id])


class Told(Offline):
    """Answers with a given layout and structure."""

    def __init__(self, style, kind, depth, toc=()):
        self.answers = json.dumps({"headerText": "Head 7", "footnoteStyle": style}), json.dumps({"documentType": kind, "hierarchy": {"maxDepth": depth}, "toc": {"explicit": True, "entries": list(toc)}})

    def layout_answer(self, text, page, total):
        from pagemill.operators import layout

        return layout.page_profile(F.lit(self.answers[0]))

    def structure_answer(self, prompt):
        return F.lit(self.answers[1])


NOTED = [
    ["# One\ntext [1] that runs\n1. first note\nHead 7", "on with [1] and\n## Two\nmore [2].\n2. second\n2. again"],
    ["### Deep\nx [1]\n1. n1", "# A\ny [2] open\n2. n2", "goes on [3]\n# B\nz [1] [4].\n3. n3\n4. n4\n1. n1 new", "# C\nno notes", "# D\nw [9] [1]\n9. n9\n1. last one"],
    ["plain [1]\n1. only", "## S\n[1] [2] and [12]\n2. two\n12. twelve"],
    ["* star note\ntext [*] open", "more\n† dagger\n[†] end."],
]


@pytest.mark.parametrize("kind", ["other", "academic", "book", "manual"])
@pytest.mark.parametrize("style", ["numbered", "symbolic"])
def test_footnotes_by_type(spark, kind, style):
    df = spark.createDataFrame([(k, len(p), p) for k, p in enumerate(NOTED)], "doc_id long, n long, pages array<string>")
    toc = [{"level": 1, "title": "One!", "page": 1, "children": [{"title": "Sub", "page": 99}, {"level": 4, "title": "Gone", "children": [{"level": 2, "title": "Gone, too"}]}]}, {"level": 2, "title": "Last"}]
    lines = ["- [One!](#one)", "  - [Sub](#sub)", "- [Last](#last)"]
    got = {r.doc_id: r for r in pipelines.convert(df, "intelligent", Told(style, kind, 3, toc)).collect()}
    for k, p in enumerate(NOTED):
        assert got[k].markdown == organize(extract(p, style, ["Head 7"], depth=3), kind, lines), (k, kind)
        assert got[k].has_toc


def test_links_and_pending(spark):
    pages = ["# A\n\nopen end", "# B\n\nclosed.", "tail\n# C\nrest"]
    df = spark.createDataFrame([(1, 3, pages)], "doc_id long, n long, pages array<string>")
    raw = pipelines.organized_documents(df, Offline()).select("_raw").first()[0]
    assert raw.pending == ["section-1-1", "section-3-2"]
    assert [(s.id, s.continues_from) for s in raw.sections] == [("section-1-1", None), ("section-2-1", "section-1-1"), ("section-3-1", None), ("section-3-2", None)]


def test_structure_profile(spark):
    answer = json.dumps({"toc": {"entries": [{"title": "a", "level": 9, "children": [{"children": [{"title": "c", "page": 3}]}]}, None]}})
    got = spark.range(1).select(structure.profile(F.lit(answer), F.lit(5)).alias("p")).first().p
    assert [(e.level, e.title, e.page, e.depth) for e in got.toc] == [(6, "a", 1, 0), (7, "Untitled", 1, 1), (8, "c", 3, 2)]
    assert spark.range(1).select(passes.filter_pattern(F.array(F.lit("a.b"), F.lit("c"))).alias("p"), passes.filter_pattern(F.array().cast("array<string>")).alias("q")).first() == ("a\\.b|c", None)


# ------------------------------------------------------------ live calls


class Echo:
    """Answers by calls as the offline provider does by expressions, and keeps what it was told."""

    name, native_pages = "echo", None

    def analyze(self, text):
        return {"language": presence(text), "tables": 0, "has_code": False, "has_math": False, "has_toc": False}

    def extract_structure(self, text, analysis):
        return []

    def convert_page(self, page, context):
        if "BROKEN" in page:
            raise RuntimeError("status: 400 bad page")
        return {"content": page, "summary": page[:300], "last_paragraph": last_paragraph(page), "images": None}

    def convert_window(self, pages, context):
        return {"content": f"<{context['start']}-{context['end']} after {context['previous'][-3:]}>", "last_paragraph": "end.", "summary": "s"}

    def summarize(self, text, most=500):
        return text[:most]

    def chat(self, prompt):
        return "no JSON"


LIVE = [["The head and the of to in", "text goes on\nand", "x.\n12\nmore"], ["one"], ["a", "b", "BROKEN", "d"]]


@pytest.mark.parametrize("name", ["direct", "light", "full", "intelligent", "legacy"])
def test_live(spark, name):
    df = spark.createDataFrame([(k, len(p), p) for k, p in enumerate(LIVE)], "doc_id long, n long, pages array<string>")
    got = {r.doc_id: r for r in live.convert(df, Echo(), name, waits=()).collect()}
    want = {r.doc_id: r for r in pipelines.convert(df, name).collect()}
    for k in (0, 1):
        assert got[k].markdown == want[k].markdown and got[k].errors == []
        assert name == "legacy" or got[k].language == want[k].language
    assert [(e.step, e.error.kind, e.error.status) for e in got[2].errors] == [("windows" if name == "full" else "converted", "api", 400)]
    assert "BROKEN" not in got[2].markdown


def test_native_windows(spark):
    class Native(Echo):
        native_pages = 100

    df = spark.createDataFrame([(1, 5, list("abcde"))], "doc_id long, n long, pages array<string>")
    got = live.convert(df, Native(), "full", waits=(), size=2).first()
    assert got.markdown == "<1-2 after > \n\n<3-4 after nd.> \n\n<5-5 after nd.>"


    got = live.convert(df, Native(), "full", waits=(), size=2, parallel=3).first()
    assert got.markdown == "<1-2 after > \n\n<3-4 after > \n\n<5-5 after >"


def test_earlier_answers(spark):
    df = spark.createDataFrame([("x [Content] body \n[COORDINATES] ```json {\"a\": [1, 2, 3, 4]}```",), ("plain",)], "t string")
    got = [tuple(r) for r in df.select(*structure.parsed_legacy("t")).collect()]
    assert got == [("body", {"a": [1.0, 2.0, 3.0, 4.0]}), ("plain", None)]


def test_windows_with_failures(spark):
    def call(pages):
        if "c" in pages:
            raise RuntimeError("Rate limit")
        return "+".join(pages)

    df = spark.createDataFrame([(1, list("abcd"), [(1, 1, 2), (2, 3, 3), (3, 4, 4)])], "doc_id long, pages array<string>, plan array<struct<window:int,start:int,end:int>>")
    got = live.processed_windows(df, call, delay=0, waits=()).first().content
    assert [(w.window, w.content, w.error and w.error.kind) for w in got] == [(1, "a+b", None), (2, "", "rate_limit"), (3, "d", None)]


def test_calls_that_hang(spark):
    import time

    def call(row):
        time.sleep(60 if row["id"] == 1 else 0)
        return str(row["id"])

    began = time.time()
    got = execution.robust_calls(spark.range(3).coalesce(1), call, timeout=1.0, waits=()).orderBy("id").collect()
    assert time.time() - began < 30
    assert [(r.result, r.error and r.error.kind) for r in got] == [("0", None), (None, "timeout"), ("2", None)]


def test_batches_and_progress():
    slept, seen, tries = [], execution.Progress(), []

    def call(batch):
        tries.append(batch)
        if len(tries) == 2:
            raise RuntimeError("status 503")
        return [x * 2 for x in batch]

    got = execution.in_batches(call, list(range(7)), 3, sleep=slept.append, waits=(1.0,), report=lambda done, all_: seen.tell(done, all_, "batches"))
    assert got == [x * 2 for x in range(7)] and slept == [0.5, 1.0, 0.5] and seen.state == (7, 7, "batches")
    assert execution.in_sequence(str, [1, 2, 3], 0.2, slept.append) == ["1", "2", "3"] and slept[-2:] == [0.2, 0.2]


def test_pages_of_long_texts(spark):
    import time

    text = "\n".join(f"line {i}" for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    corpus.paginate(df).count()
    began = time.time()
    assert corpus.paginate(df).where("length(text) > 0").count() == 10_000
    assert corpus.paged_documents(df).select("n").first()[0] == 10_000
    assert time.time() - began < 3
