"""Work on crowded pages and documents: regions of many paths, best matches of many headings, walks over Markdown."""

import json
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import components, geometry, validation
from pagemill.sources import corpus, pdf_objects

PATHS = "page_id long, seq long, min_x double, min_y double, max_x double, max_y double, has_stroke boolean, has_fill boolean, path_ops int"


def boxes(rng, n, room, most, step=None):
    for k in range(n):
        x, y = rng.uniform(-room / 4, room), rng.uniform(-room / 4, room)
        w, h = (rng.choice([0.0, 1.0, float(most), rng.uniform(0, most)]) for _ in range(2))
        if step:
            x, y, w, h = (round(v / step) * float(step) for v in (x, y, w, h))
        yield (k, x, y, x + w, y + h, rng.random() < 0.5, rng.random() < 0.5, rng.randrange(1, 7))


@pytest.mark.parametrize(("seed", "n", "room", "most", "step", "gap"), [(1, 120, 400, 30, None, 15.0), (2, 150, 600, 20, 5, 15.0), (3, 80, 3000, 900, None, 15.0), (4, 100, 300, 20, 10, 10.0), (5, 60, 2000, 1500, 15, 15.0), (6, 80, 200, 10, 5, 0.0), (7, 200, 900, 12, 7.5, 15.0)])
def test_regions_by_fold_and_by_grid(spark, seed, n, room, most, step, gap):
    rng = random.Random(seed)
    df = spark.createDataFrame([(page, *b) for page in range(3) for b in boxes(rng, n, room, most, step)], PATHS)
    told = lambda crowd: sorted(tuple(r) for r in geometry.clusters(df, gap, crowd).collect())
    fold, grid = told(10**9), told(0)
    assert fold == grid and fold


def test_crowded_page(spark):
    """A page of 100,000 paths, in lines that do not touch each other."""
    rng = random.Random(1)
    rows = [(1, k, x := rng.uniform(0, 600), 50.0 * (k % 200), x + 5, 50.0 * (k % 200) + 5, True, False, 1) for k in range(100_000)]
    df = spark.createDataFrame(rows, PATHS).repartition(4)
    begin = time.time()
    got = geometry.clusters(df).orderBy("y").collect()
    assert [(r.y, r.path_count) for r in got] == [(50.0 * k, 500) for k in range(200)]
    assert time.time() - begin < 120


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(150)] + [(7, 7)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            above[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in above}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ headings


def normal(t):
    return re.sub(r"\s", "", re.sub(r"[^A-Za-z0-9_\s]", "", re.sub(r"\s+", " ", t.lower())).strip())


def likeness(a, b):
    p, q = normal(a), normal(b)
    if p == q:
        return 1.0
    if len(p) < 2 or len(q) < 2:
        return 0.0
    x, y = (Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in (p, q))
    return round(2 * sum((x & y).values()) / (len(p) + len(q) - 2), 6)


@pytest.mark.parametrize(("seed", "crowd"), [(0, 0), (1, 0), (2, 0), (0, 1 << 16), (1, 500)])
def test_best_matches_by_brute_force(spark, seed, crowd):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "abab", "baba", "a", "b", "x y", "", "Über", "1", "12"]
    title = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 6)))
    actual = [(d, k, rng.randrange(1, 3), title()) for d in range(4) for k in range(40)]
    expected = []
    for d, k, level, text in actual:
        changed = text if rng.random() < 0.4 else text[:-1] + rng.choice("xyz") if rng.random() < 0.5 else title()
        expected.append((d, k, level, changed))
    expected += [(9, 0, 1, "nothing there"), (0, 99, 7, "no such level")]
    got = {(r.doc_id, r.ord): (r.match, r.similarity, r.matched) for r in validation.best_matches(spark.createDataFrame(expected, "doc_id long, ord long, level int, text string"), spark.createDataFrame(actual, "doc_id long, ord long, level int, text string"), crowd=crowd).collect()}
    for d, k, level, text in expected:
        own = [(likeness(text, t), -o, t) for i, o, lv, t in actual if i == d and lv == level]
        best = max(own, key=lambda x: x[:2]) if own else None
        want = (best[2], best[0], best[0] >= 0.9) if best else (None, 0.0, False)
        assert got[d, k] == want, (text, got[d, k], want)
    assert len(got) == len(expected)


def test_best_matches_broadcast_nothing(spark):
    """Written tables of parts are small as files and large in memory: none of them goes through the driver."""
    rows = [(d, k, 1, f"heading {k} of {d}") for d in range(4) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, level int, text string")
    for crowd in (0, 1 << 20):
        assert "Broadcast" not in validation.best_matches(df, df, crowd=crowd)._jdf.queryExecution().toString()
    assert "Broadcast" not in validation.structure_report(df, df)._jdf.queryExecution().toString()


def test_best_matches_pair_by_pair_are_matrices(spark, monkeypatch):
    """Groups that go on in the next batch, more parts than a block, ties to seven digits, texts without a value."""
    monkeypatch.setattr(validation, "BLOCK", 7)
    texts = ["ab" * 33 + "c" * 62, "x" * 65, None, "", "a", "A", "Kelvin K", "kelvin k", "İx", "ix", "z" * 300_000]
    rows = [(d, k, 1, t) for d in range(3) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, level int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.doc_id, r.ord): (r.match, r.similarity) for r in validation.best_matches(df.where("ord <> 6").withColumn("text", F.concat("text", F.lit("b"))), df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for d, k, _, t in rows:
        if k != 6:
            own = [(likeness(t + "b", x), -o, x) for i, o, _, x in rows if i == d and x is not None] if t is not None else None
            assert got[d, k] == ((max(own)[2], max(own)[0]) if own else (texts[0], 0.0)), (t, got[d, k])


def test_dice_of_many_lines(spark):
    """100,000 pairs of lines of some hundred letters."""
    line = lambda s: F.repeat(F.concat_ws(" ", F.md5((F.col("id") * s).cast("string")), F.lit("the same words")), 7)
    begin = time.time()
    got = spark.range(0, 100_000, 1, 4).select(T.dice(line(1), line(3)).alias("s")).agg(F.count("s").alias("n"), F.min("s").alias("least"), F.max("s").alias("most")).first()
    assert got.n == 100_000 and 0.2 < got.least < 0.9 and got.most == 1.0
    assert time.time() - begin < 12


def test_many_headings_of_one_level(spark):
    """20,000 of one document and level, most of them changed a little: not all pairs are compared."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 9))) for _ in range(7))
    titles = [text() for _ in range(20_000)]
    changed = [t if k % 3 == 0 else t[:10] + "q" + t[11:] for k, t in enumerate(titles)]
    schema = "doc_id long, ord long, level int, text string"
    a, e = (spark.createDataFrame([(1, k, 2, t) for k, t in enumerate(x)], schema).repartition(4) for x in (titles, changed))
    begin = time.time()
    got = validation.best_matches(e, a).collect()
    assert sum(r.match == titles[r.ord] for r in got) == len(titles) and all(r.matched for r in got)
    assert time.time() - begin < 120


# ------------------------------------------------------------ Markdown


MARKDOWN = [
    ("| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |\n\nx", [(3, 2)], []),
    ("a | b\n--|--\n1 | 2\n# h\n| x |", [(2, 2)], []),
    ("text\n| a | b | c |\n| - | - |\n", [], []),
    ("| a\\|b | c |\n|---|---|\n| d | e\\| |", [(2, 2)], []),
    ("|a|\n|-|\n|1|\n> quote\n|a|\n|-|", [(2, 1), (1, 1)], []),
    ("```python\n| a | b |\n|---|---|\n```\n~~~\n```\n~~~\n````md\n```\n````", [], ["python", "", "md"]),
    ("```\nnot closed\n| a |\n|---|", [], [""]),
    ("``` a`b\n| a | b |\n|---|---|", [(1, 2)], []),
    ("    | a | b |\n|---|---|\n", [], []),
    ("---\n***\n| a | b |\n|---|---|\n| 1 |\n\n| 2 | 3 |", [(2, 2)], []),
    ("```JSON extra words\n{}\n```   \n| a | b |\n|:--|--:|", [(1, 2)], ["JSON"]),
    ("", [], []),
    (None, None, None),
]


def test_blocks(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(MARKDOWN)], "k int, t string")
    got = {r.k: r.b for r in df.select("k", validation.blocks("t").alias("b")).collect()}
    for k, (text, tables, languages) in enumerate(MARKDOWN):
        found = got[k]
        if text is None:
            assert found is None or found.tables is None
            continue
        assert ([(t.rows, t.columns) for t in found.tables], found.languages) == (tables, languages), text


def test_against_expectation_files(spark, tmp_path):
    content = lambda images, tables, code: {"content": {"images": {"count": images}, "tables": {"count": tables, "details": [{"rows": 2, "columns": 2}]}, "codeBlocks": {"count": code, "languages": ["python"]}}}
    for name, x in (("a", content(1, 1, 1)), ("b", content(3, 0, 0)), ("gone", content(0, 0, 0))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "expected.json").write_text(json.dumps(x))
    text = "![p](x.png)\n\n| a | b |\n|---|---|\n\n```python\n![no](y)\n```\n"
    docs = spark.createDataFrame([("a", text), ("b", text), ("more", text)], "name string, markdown string")
    got = {r.name: r for r in validation.fixture_report(docs, corpus.read_fixtures(spark, str(tmp_path))).collect()}
    assert tuple(got["a"].actual) == (1, 1, 1) and got["a"].content_ok
    assert (got["b"].images_ok, got["b"].tables_ok, got["b"].content_ok) == (False, True, False)
    assert not got["gone"].content_ok and got["gone"].actual is None and not got["more"].content_ok


def test_ends_are_ascii_white_space_only(spark):
    """A regular expression's end also lies before a last line separator."""
    got = spark.createDataFrame([(" \t\x0ba \u2028",), ("\r\n\f",), (None,)], "t string").select(T.trimmed("t")).collect()
    assert [r[0] for r in got] == ["a \u2028", "", None]


def test_columns_without_references_are_not_joined(spark):
    objs = spark.createDataFrame([(1, 0, "{}"), (1, 2, '"(x"')], "doc_id long, num long, value string")
    df = spark.createDataFrame([(1, "(plain", "2 0 R"), (1, None, "3 0 R")], "doc_id long, a string, b string")
    assert "Join" not in pdf_objects.resolved(df, objs, "a")._jdf.queryExecution().toString()
    got = pdf_objects.resolved(df, objs, "a", "b")
    assert {tuple(r) for r in got.collect()} == {(1, "(plain", "(x"), (1, None, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_long_markdown(spark):
    text = "\n".join(f"| a{k} | b |\n|---|---|\n| 1 | 2 |\n" for k in range(2000))
    got = spark.createDataFrame([(text,)], "t string").select(validation.blocks("t").alias("b")).select(F.size("b.tables").alias("n")).first()
    assert got.n == 2000
