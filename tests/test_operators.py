"""Hand-computed cases of single operators."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import execution, features, geometry, layout, providers, sampling, structure, validation, windows
from pagemill.operators import sections as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("levels", "fixed"), [([1, 3], [1, 2]), ([3], [1]), ([2], [2]), ([0, 3, 0], [0, 1, 0]), ([1, 4, 6], [1, 2, 3]), ([1, 2, 1, 2], [1, 2, 1, 2])])
def test_hierarchy(spark, levels, fixed):
    got = one(spark, S.repaired_levels(F.array(*map(lit, levels))))
    assert got == fixed
    assert one(spark, S.repaired_levels(F.array(*map(lit, got)))) == fixed


@pytest.mark.parametrize(
    ("text", "out"),
    [("See [1].", "See [^1]."), ("See (1).", "See [^1]."), ("See ^1.", "See [^1]."), ("See [^1].", "See [^1]."), ("[1](url)", "[1](url)"), ("(1)[x]", "(1)[x]"), ("See [12].", "See [[^1]2].")],
)
def test_footnote_markers(spark, text, out):
    assert one(spark, T.footnote_markers(lit(text))) == out


@pytest.mark.parametrize(("text", "out"), [("a\n\n\n\n\nb", "a\n\n\nb\n"), ("a  \nb\t", "a\nb\n"), ("", "\n"), ("## ## T", "## T\n"), ("a\n*****\nb", "a\n---\nb\n"), ("a\n- \nb", "a\n\nb\n")])
def test_cleanup(spark, text, out):
    assert one(spark, T.cleaned_markdown(lit(text))) == out


def test_merge(spark):
    rows = "array(named_struct('id','a','level',1,'title','A','content','x','continues_from',cast(null as string)), named_struct('id','b','level',0,'title','','content','y','continues_from','a'), named_struct('id','c','level',0,'title','','content','z','continues_from','b'), named_struct('id','d','level',0,'title','','content','o','continues_from','gone'))"
    got = one(spark, S.merged(F.expr(rows)))
    assert [(r.id, r.content, r.parts) for r in got] == [("a", "x\n\ny\n\nz", 3), ("d", "o", 1)]


def test_parse(spark):
    got = one(spark, S.parse(lit("pre\n# A\nx\n## B")))
    assert [(s.n, s.level, s.title, s.content) for s in got] == [(1, 0, "", "pre"), (2, 1, "A", "x"), (3, 2, "B", "")]
    assert one(spark, S.parse(lit(""))) == []
    assert one(spark, S.parse(lit(None).cast("string"))) is None


def test_footnotes(spark):
    text = lit("body [1]\n1. first\n1. again\n2. second")
    assert [(x.id, x.content) for x in one(spark, S.footnotes(text))] == [("1", "first"), ("2", "second")]
    assert one(spark, S.without_footnotes(text)) == "body [1]"
    assert one(spark, S.footnotes(text, "none")) == []


def test_images(spark):
    images = F.expr("map('a', named_struct('description','D','url','u','decorative',false), 'l', named_struct('description','L','url','v','decorative',true))")
    df = spark.range(1).select(lit("{{image:a}} [image:l] {{image:zz}}").alias("t"), images.alias("images"))
    assert df.select(structure.images_resolved("t", "images")).first()[0] == "![D](u)  "


@pytest.mark.parametrize(("n", "pct", "fml"), [(1, [1], [1]), (2, [1], [1, 2]), (10, [1, 3, 5, 7, 9], [1, 5, 10])])
def test_samples(spark, n, pct, fml):
    assert one(spark, sampling.at_percentiles(lit(n))) == pct
    assert one(spark, sampling.first_middle_last(lit(n))) == fml


@pytest.mark.parametrize("n", [1, 7, 23, 50, 51, 180])
def test_windows_tile(spark, n):
    starts = F.expr("array(3, 8, 9, 21, 44, 48, 95, 140)")
    got = one(spark, windows.plan(lit(n), starts))
    assert [w.window for w in got] == list(range(1, len(got) + 1))
    assert [p for w in got for p in range(w.start, w.end + 1)] == list(range(1, n + 1))


@pytest.mark.parametrize(("a", "b", "x"), [("night", "nacht", 0.25), ("abc", "abc", 1.0), ("a", "b", 0.0), ("aaaa", "aa", 0.5)])
def test_dice(spark, a, b, x):
    assert one(spark, T.dice(lit(a), lit(b))) == pytest.approx(x)


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa", "abababa ba", "a\U0001f600b\U0001f600b", "\u00e4\u00e4 \u00e4x" * 40])
def test_numbered_bigrams(spark, text):
    plain, seen, want = "".join(text.split()), {}, []
    for a, b in zip(plain, plain[1:]):
        k = seen[a + b] = seen.get(a + b, -1) + 1
        want.append((ord(a) * T.CODES + ord(b)) * T.TIMES + k)
    assert one(spark, T.numbered_bigrams(lit(text))) == sorted(want)


def test_once():
    calls = []
    made = T.once(lambda *a: calls.append(a) or len(calls))
    assert (made("x"), made("x"), made("y"), made([1]), made([1])) == (1, 1, 2, 3, 4)  # a list has no hash


def test_headings_are_all_lines_but_blank_ones(spark, tmp_path):
    from pagemill.plans import content_queries as Q

    long = "a" * 5000
    rows = [(4, f"One\n\n \t\x0b\n{long}\n# two"), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in Q.headings(spark, str(tmp_path)).orderBy("doc_id", "ord").collect()]
    assert got == [(4, 0, 1, "One", 1), (4, 3, 3, long, 1), (4, 4, 1, "# two", 2)]
    assert [r.doc_id for r in Q.hierarchy_fix(spark, str(tmp_path)).collect()] == [4]
    assert [tuple(r) for r in Q.hierarchy_errors(spark, str(tmp_path)).collect()] == [(4, 3, 3, 1)]


def test_similarity(spark):
    assert one(spark, T.similarity_ratio(lit("abc"), lit("xabcx"))) == pytest.approx(0.6)
    assert one(spark, T.similarity_ratio(lit(""), lit(""))) == 1.0


def test_errors(spark):
    assert execution.classified(RuntimeError("Rate limit")).kind == "rate_limit"
    assert execution.classified(RuntimeError("status 500")).retryable
    assert not execution.classified(RuntimeError("status 400")).retryable
    assert execution.classified(TimeoutError()).kind == "timeout"
    assert list(execution.delays()) == [1, 2, 4, 8]
    slept, calls = [], iter([RuntimeError("429"), RuntimeError("503"), None])

    def call():
        e = next(calls)
        if e:
            raise e
        return "ok"

    assert execution.with_retry(call, sleep=slept.append) == "ok" and slept == [1, 2]
    with pytest.raises(execution.CallError):
        execution.with_retry(lambda: 1 / 0, sleep=slept.append)


def test_limiter():
    import threading
    import time

    limiter, now, most, lock = execution.Limiter(2, 0.0), [0], [0], threading.Lock()

    def work(_):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1

    execution.in_order(lambda i: limiter.run(work, i), list(range(5)), 5)
    assert most[0] <= 2


def test_registry():
    r = providers.Registry()
    assert r.get() is r.get("offline")
    with pytest.raises(providers.NotConfigured):
        r.configure("none")


def test_geometry(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 50.0, True, True, 3), (1, 2, 60.0, 0.0, 90.0, 50.0, True, False, 4), (1, 3, 300.0, 300.0, 330.0, 330.0, True, False, 1)], "page_id long, seq long, min_x double, min_y double, max_x double, max_y double, has_stroke boolean, has_fill boolean, path_ops int")
    got = geometry.clusters(df).collect()
    assert [(r.cluster, r.width, r.height, r.path_count, r.kind) for r in got] == [(1, 90.0, 50.0, 7, "logo")]


def test_layout(spark):
    assert one(spark, layout.page_number_pattern(F.array(lit("- 3 -")))) == r"^\s*-\s*\d+\s*-\s*$"
    assert one(spark, layout.common_line(F.array(lit("Head"), lit("Head"), lit("x")))) == "Head"
    assert one(spark, layout.common_line(F.array(lit("1"), lit("2"), lit("3")))) == r"\d+"
    assert one(spark, layout.common_line(F.array(lit("Head"), lit("Head")))) is None


def test_formats(spark):
    row = spark.range(1).select(*validation.format_warnings(lit("![a]() [b"))).first()
    assert (row.parseable, row.broken_images, row.open_brackets) == (True, 1, 1)
    assert one(spark, T.table_runs(lit("|a|b|\n|-|-|\n|1|2|\nx\n|a|b|"))) == 1
    assert one(spark, T.structure_depth(lit("1.2.3. x\n# y"))) == 3


def test_forced_plan(spark):
    paged = spark.createDataFrame([(1, 1, ["text"])], "doc_id long, n long, pages array<string>")
    assert features.planned(features.factors(paged), force="full").first().pipeline == "full"


def test_stream(spark, sf_dir, tmp_path):
    from pagemill.streaming import ingest

    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(20).write.parquet(str(tmp_path / "in/a"))
    q = ingest.run_to_parquet(ingest.planned_stream(ingest.document_stream(spark, str(tmp_path / "in/a"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_markdown_sink(spark, tmp_path):
    from pagemill.sources import corpus

    df = spark.createDataFrame([(1, "# A\ntext"), (2, "b")], "doc_id long, markdown string")
    corpus.write_markdown(df, str(tmp_path / "md"), folders=True)
    assert (tmp_path / "md/doc_id=1").exists()
    corpus.write_markdown(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    assert corpus.read_pdf_bytes(spark, str(tmp_path)).count() == 1
