"""Budgets of time, kept answers, lanes, and deep contents."""

import json
import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill.operators import execution, live, structure
from pagemill.operators.journal import Journal, Journaled
from pagemill.sources import corpus

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not have the tests


class Counted:
    """Answers at once or slowly, and leaves a file for each call that it is paid for; fails on a word."""

    name, native_pages = "counted", None

    def __init__(self, folder, wait=0.0, poison=None):
        self.folder, self.wait, self.poison = folder, wait, poison

    def _paid(self, what):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(what)
        time.sleep(self.wait)

    def paid(self):
        return [open(f"{self.folder}/{x}").read() for x in os.listdir(self.folder)]

    def analyze(self, text):
        self._paid("analyze")
        return {"language": "en", "tables": 0, "has_code": False, "has_math": False, "has_toc": False}

    def extract_structure(self, text, analysis):
        self._paid("structure")
        return [{"level": 1, "title": "One", "page": 1}]

    def convert_page(self, page, context):
        if self.poison and self.poison in page:
            os._exit(1)  # the executor's worker is gone in the middle of its task
        self._paid(f"page {page[:20]}")
        return {"content": f"# {page[:10]}", "summary": "s", "last_paragraph": ""}

    def convert_window(self, pages, context):
        raise NotImplementedError

    def summarize(self, text, most=500):
        self._paid("summary")
        return "s"

    def chat(self, prompt):
        self._paid("chat")
        return "{}"


def documents(spark, n=4, lines=9):
    return corpus.paged_documents(spark.createDataFrame([(k, "\n".join(f"doc {k} line {i}" for i in range(lines))) for k in range(n)], "doc_id long, text string").repartition(2))


def test_budget():
    now = [0.0]
    clock = lambda: now[0]
    budget = execution.Budget(10, timeout=4, waits=(), clock=clock)
    assert budget.run(lambda: "x") == "x"
    now[0] = 9.0
    assert budget.left() == 1.0
    now[0] = 10.0
    with pytest.raises(execution.CallError, match="time is up"):
        budget.run(lambda: "x")
    tries = []

    def failing():
        tries.append(now[0])
        now[0] += 1
        raise RuntimeError("status: 503")

    waiting = execution.Budget(5, waits=(1.0, 2.0, 30.0), clock=clock)
    waited = []
    with pytest.raises(execution.CallError, match="503"):
        execution.with_retry(failing, sleep=lambda s: (waited.append(s), now.__setitem__(0, now[0] + s)), waits=waiting.waits, until=waiting.end, clock=clock)
    assert waited == [1.0] and len(tries) == 2  # the second wait would go beyond the end


def test_documents_share_their_time(spark, tmp_path):
    provider = Counted(str(tmp_path), wait=0.4)
    got = {r.doc_id: r for r in live.convert(documents(spark, 2, 40), provider, "light", total=1.5, waits=(), at_once=1).collect()}
    for r in got.values():
        assert r.markdown == "" and [e.step for e in r.errors].count("document") == 1
        assert {e.error.kind for e in r.errors} == {"timeout"}
    assert len(provider.paid()) <= 2 * 5  # two calls before the pages; none after the time is up
    again = live.convert(documents(spark, 2, 9), Counted(str(tmp_path)), "light", total=60).collect()
    assert all(r.markdown and not r.errors for r in again)


def test_answers_are_asked_for_once(spark, tmp_path):
    """Two actions on one result, and the calls of each step."""
    provider = Counted(str(tmp_path))
    got = live.convert(documents(spark), provider, "light")
    assert got.count() == 4 and len(got.collect()) == 4
    paid = provider.paid()
    assert len(paid) == 4 * (2 + 3) and paid.count("analyze") == paid.count("structure") == 4


def test_no_call_is_paid_twice(spark, tmp_path):
    """A worker is lost amid its task; the job that is started again asks only for what is missing."""
    (tmp_path / "paid").mkdir()
    journal = Journal(f"file://{tmp_path}/journal")
    lost = Counted(str(tmp_path / "paid"), poison="doc 3 line 4")
    with pytest.raises(Exception):  # noqa: B017 whatever Spark makes of a lost worker
        live.convert(documents(spark), Journaled(lost, journal), "light", at_once=1).collect()
    before = lost.paid()
    assert before
    whole = Counted(str(tmp_path / "paid"))
    got = live.convert(documents(spark), Journaled(whole, journal), "light").collect()
    assert len(got) == 4 and all(r.markdown and not r.errors for r in got)
    pages = [p for p in whole.paid() if p.startswith("page")]
    assert len(pages) == len(set(pages)) == 12
    n = len(whole.paid())
    assert live.convert(documents(spark), Journaled(whole, journal), "light").count() == 4
    assert len(whole.paid()) == n  # all answers are there
    kept = journal.table(spark)
    assert kept.count() == kept.select("key").distinct().count() == len({(r.call, r.key) for r in kept.collect()})
    # Texts that are alike are asked for once, other providers' answers are not taken.
    other = Counted(str(tmp_path / "paid"))
    other.name = "another"
    Journaled(other, journal).chat("x"), Journaled(other, journal).chat("x"), Journaled(whole, journal).chat("x")
    assert len(whole.paid()) == n + 2
    with pytest.raises(AttributeError):
        _ = Journaled(other, journal).nothing


def test_pictures_and_connection(spark, tmp_path):
    class Sees(Counted):
        def classify_image(self, data, prompt):
            if data == b"bad":
                raise RuntimeError("status: 400")
            return {b"c": 'So: {"type": "chart", "description": "bars", "isPureVector": true, "complexity": 0.9} .', b"p": '{"type": "photo"}', b"n": "no idea"}[data]

        def validate_connection(self):
            if self.poison:
                raise OSError("unreachable")
            return True

    rows = [(1, b"c"), (2, b"p"), (3, b"n"), (4, b"bad"), (5, None)]
    got = {r.k: r for r in live.classified_images(spark.createDataFrame(rows, "k int, data binary"), Sees(str(tmp_path)), waits=()).collect()}
    assert tuple(got[1].kind) == ("chart", "bars", True, 0.9) and tuple(got[2].kind) == ("photo", "Unknown image", False, 0.5)
    assert all(tuple(got[k].kind) == ("other", "Unknown image", False, 0.5) for k in (3, 4, 5))
    assert got[4].error.status == 400 and all(got[k].error is None for k in (1, 2, 3, 5))
    assert live.connected(Sees(str(tmp_path))) and not live.connected(Sees(str(tmp_path), poison="x"))


def test_failed_calls_are_not_kept(tmp_path):
    class Failing(Counted):
        def chat(self, prompt):
            raise RuntimeError("no")

    journal = Journal(f"file://{tmp_path}/j")
    for _ in range(2):
        with pytest.raises(RuntimeError):
            Journaled(Failing(str(tmp_path)), journal).chat("x")
    (tmp_path / "p").mkdir()
    assert Journaled(Counted(str(tmp_path / "p")), journal).chat("x") == "{}"


@pytest.mark.parametrize(("lanes", "at_once"), [(1, 1), (2, 1), (2, 2)])
def test_lanes_bound_calls_over_all_tasks(spark, tmp_path, lanes, at_once):
    folder = str(tmp_path)

    def call(row):
        mine = f"{folder}/now-{uuid.uuid4().hex}"
        open(mine, "w").close()
        time.sleep(0.05)
        n = sum(x.startswith("now-") for x in os.listdir(folder))
        os.remove(mine)
        return str(n)

    df = spark.range(40).repartition(8)
    got = execution.robust_calls(df, call, at_once=at_once, lanes=lanes)
    most = max(int(r.result) for r in got.collect())
    assert most <= lanes * at_once and got.count() == 40


@pytest.mark.parametrize("depth", [1, 6, 12, 40])
def test_contents_of_any_depth(spark, depth):
    """Pre-order kept; entries without a level are one below their parent, at each depth."""
    entry, want = None, []
    for k in reversed(range(depth)):
        entry = {"title": f"t{k}", "page": k + 1, "children": [x for x in (entry, {"title": f"s{k}"}) if x]}
    todo = [(entry, 0, 0)]
    while todo:
        e, d, above = todo.pop(0)
        level = min(6, max(1, e["level"])) if "level" in e else above + 1
        want.append((level, e["title"], min(99, e.get("page", 1)), d))
        todo = [(c, d + 1, level) for c in e.get("children", [])] + todo
    df = spark.createDataFrame([(json.dumps({"toc": {"entries": [entry, {"title": "last", "level": 2, "page": 500}]}}),)], "a string")
    got = df.select(structure.profile("a", F.lit(99)).alias("p")).first()["p"].toc
    assert [(e.level, e.title, e.page, e.depth) for e in got] == [*want, (2, "last", 99, 0)]


def test_odd_contents(spark):
    answers = ['{"toc":{"entries":[{"title":"a","children":"x"},{"title":"b","children":{"title":"c"}},null,{"children":[]}]}}', '{"toc":{}}', "no", "{", None, '{"toc":{"entries":[]}}']
    got = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").orderBy("k").select(structure.profile("a", F.lit(9)).alias("p")).collect()
    assert [[e.title for e in r.p.toc] for r in got][1:] == [[], [], [], [], []]
    assert [e.title for e in got[0].p.toc][:2] == ["a", "b"] and got[0].p.toc[-1].title == "Untitled"
