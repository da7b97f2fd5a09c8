"""Conversions with a live provider: its calls run row by row, and the conversions' expressions read their answers.

Each kind of call is one pass of ``execution.robust_calls`` over the documents, in
the order in which a conversion needs the answers: analysis and headings, layout of
sampled pages, structure, then pages or windows.  Pages of a document are called for
one after the other, each told what came before.  What fails leaves an empty answer
and an entry in ``errors``.  All calls for a document share a budget of time, which is
handed on from step to step; a document whose time is up gets no further calls, an
empty result and an error of step ``document``.  Tasks can run again: a provider behind
``journal.Journaled`` pays for no call twice.  Answers are written once, before they are read.
"""

from __future__ import annotations

import json
import time
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import execution, passes, pipelines, prompts, sampling, structure
from pagemill.operators.providers import Recorded
from pagemill.sources.shared import written

ANALYSIS = "struct<language:string,tables:int,has_code:boolean,has_math:boolean,has_toc:boolean>"
HEADINGS = "array<struct<level:int,title:string,page:bigint>>"
FAILURE = "struct<kind:string,message:string,status:bigint,retryable:boolean>"
CONVERTED = f"array<struct<content:string,summary:string,last_paragraph:string,images:{structure.PLACED},error:{FAILURE}>>"
ERROR = f"struct<step:string,at:bigint,error:{FAILURE}>"


class LiveProvider(Protocol):
    """Calls that reach a model; native_pages: pages that fit a call on a window as a whole, None: there is no such call."""

    name: str
    native_pages: int | None

    def analyze(self, text: str) -> dict: ...

    def extract_structure(self, text: str, analysis: dict) -> list[dict]: ...

    def convert_page(self, page: str, context: dict) -> dict: ...

    def convert_window(self, pages: list[str], context: dict) -> dict: ...

    def summarize(self, text: str, most: int = 500) -> str: ...

    def chat(self, prompt: str) -> str: ...

    def classify_image(self, data: bytes, prompt: str) -> str: ...

    def validate_connection(self) -> bool: ...


def _empty(error: dict | None) -> dict:
    return {"content": "", "summary": "", "last_paragraph": "", "images": None, "error": error}


def _plain(x):
    """What pandas makes of nested values, as lists and dicts."""
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def expected(headings: list[dict], page: int) -> list[dict]:
    return [h for h in headings if h["page"] == page]


def section_at(headings: list[dict], page: int) -> str | None:
    """The last heading of level 1 or 2 that begins on the page or before."""
    current = None
    for h in headings:
        if h["page"] > page:
            break
        if h["level"] <= 2:
            current = h["title"]
    return current


def _pages(provider: LiveProvider, retry, pages: list[str], first: int, shared: dict, headings: list[dict], previous: str = "", tail: int = 800) -> list[dict]:
    """Pages converted one after the other, each told of the one before."""
    out, summary = [], ""
    for k, text in enumerate(pages, first):
        context = shared | {"page": k, "previous": previous[-tail:], "summary": summary, "headings": expected(headings, k), "section": section_at(headings, k)}
        got, error = execution.captured(retry, provider.convert_page, text, context | {"prompt": prompts.page(context)})
        one = _empty(error) | {x: y for x, y in (got or {}).items() if x in ("content", "summary", "last_paragraph", "images")}
        out.append(one)
        previous, summary = one["content"], one["summary"] or ""
    return out


def _windows(provider: LiveProvider, retry, row: dict, gap: float, parallel: int = 0) -> list[dict]:
    """Windows converted as a whole where the provider can, else page by page: one after the other, each told of the one
    before, or so many together, told of none; in order either way."""
    pages, plan, headings = row["pages"], row["_plan"], row["_headings"] or []
    total, previous, summary = len(pages), "", ""
    starts = [h["page"] for h in headings]

    def one(w: dict) -> dict:
        nonlocal previous, summary
        first, last = w["start"], w["end"]
        inside = [h for h in headings if first <= h["page"] <= last]
        following = [p for p in starts if p > last]
        context = {
            "window": w["window"], "windows": len(plan), "start": first, "end": last, "total": total, "percent": int(w["window"] / len(plan) * 100 + 0.5), "language": (row["_analysis"] or {}).get("language"),
            "headings": inside, "continued": section_at(headings, first - 1) if first > 1 else None, "goes_on": bool(starts) and last < total and (not following or following[0] > last + 1),
            "header": row["_edges"]["header"], "footer": row["_edges"]["footer"], "previous": previous, "summary": summary,
        }
        own = pages[first - 1 : last]
        if provider.native_pages and len(own) <= provider.native_pages:
            got, error = execution.captured(retry, provider.convert_window, own, context | {"prompt": prompts.window(context)})
            done = _empty(error) | (got or {})
        else:
            parts = _pages(provider, retry, own, first, {x: context[x] for x in ("total", "language", "header", "footer")}, headings, previous, 500)
            text = "\n\n".join(p["content"] for p in parts)
            told, error = execution.captured(retry, provider.summarize, text, 300)
            failed = next((p["error"] for p in parts if p["error"]), error)
            done = _empty(failed) | {"content": text, "summary": told or ""}
        if not parallel:
            previous, summary = done.get("last_paragraph") or done["content"][-500:], done["summary"] or ""
        return done

    return execution.in_order(one, plan, parallel) if parallel else execution.in_sequence(one, plan, gap)


def _step(df: DataFrame, name: str, call, kind: str | None, timeout: float, waits: tuple[float, ...] | None, **limits) -> DataFrame:
    """df with the answer of call(row, budget), JSON of a kind, its failure among the errors, and what it leaves of the document's time (_left)."""

    def run(row: dict) -> str:
        budget = execution.Budget(row["_left"], timeout, waits)
        answer, error = execution.captured(call, row, budget)
        return json.dumps({"answer": answer, "error": error, "left": budget.left()})

    # The budget holds; the row as a whole has no further limit.
    got = written(execution.robust_calls(df, run, "_told", timeout=1e9, waits=(), **limits).drop("error"), "answers")
    told = F.from_json("_told", f"struct<answer:string,error:{FAILURE},left:double>")
    got = got.withColumn("_told", told)
    failed = F.when(F.col("_told.error").isNotNull(), F.array(F.struct(F.lit(name[1:]).alias("step"), F.lit(None).cast("long").alias("at"), F.col("_told.error").alias("error")).cast(ERROR))).otherwise(F.array().cast(f"array<{ERROR}>"))
    answer = F.col("_told.answer")
    return got.withColumn("errors", F.concat("errors", failed)).withColumn(name, F.from_json(answer, kind) if kind else answer).withColumn("_left", F.coalesce("_told.left", "_left")).drop("_told")


def _told(df: DataFrame, name: str) -> DataFrame:
    """df with the failures of single pages or windows among the errors."""
    failed = F.filter(F.transform(F.coalesce(F.col(name), F.array().cast(CONVERTED)), lambda c, i: F.struct(F.lit(name[1:]).alias("step"), (i + 1).cast("long").alias("at"), c["error"].alias("error")).cast(ERROR)), lambda e: e["error"].isNotNull())
    return df.withColumn("errors", F.concat("errors", failed))


def recorded(paged: DataFrame, provider: LiveProvider, pipeline: str, size: int = 50, parallel: int = 0, gap: float = 0.0, timeout: float = 120.0, waits: tuple[float, ...] | None = None, at_once: int = 3, lanes: int = 0, total: float = 600.0) -> DataFrame:
    """paged with the answers that a pipeline's expressions read (see providers.Recorded), and errors.

    timeout: of a call; total: of all calls for a document; lanes: see execution.robust_calls.
    """
    pages, n = F.col("pages"), F.col("n")
    limits = {"at_once": at_once, "gap": gap, "timeout": timeout, "waits": waits, "lanes": lanes}
    df = paged.withColumn("errors", F.array().cast(f"array<{ERROR}>")).withColumn("_left", F.lit(float(total)))
    df = _called(df, provider, pipeline, size, parallel, gap, pages, n, limits)
    late = F.struct(F.lit("document").alias("step"), F.lit(None).cast("long").alias("at"), F.struct(F.lit("timeout").alias("kind"), F.lit("the document's time is up").alias("message"), F.lit(None).cast("long").alias("status"), F.lit(False).alias("retryable")).alias("error"))
    return df.withColumn("errors", F.when(F.col("_left") <= 0, F.concat("errors", F.array(late.cast(ERROR)))).otherwise(F.col("errors"))).drop("_left")


def _called(df: DataFrame, provider: LiveProvider, pipeline: str, size: int, parallel: int, gap: float, pages, n, limits: dict) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)

    def page_calls(df: DataFrame, shared) -> DataFrame:
        def call(row: dict, budget: execution.Budget) -> str:
            row = _plain(row)
            return json.dumps(_pages(provider, budget.run, row["pages"], 1, {"total": len(row["pages"])} | shared(row), row["_headings"] or []))

        return _told(_step(df, "_converted", call, CONVERTED, **limits), "_converted")

    if pipeline == "intelligent":

        def layouts(row: dict, budget: execution.Budget) -> str:
            out = {}
            for p in _plain(row["_numbers"]):
                text = row["pages"][p - 1]
                prompt = prompts.LAYOUT.format(page=p, total=len(row["pages"])) + text[: prompts.SAMPLE]
                answer, _ = execution.captured(budget.run, provider.chat, prompt)
                out[p] = answer or "{}"
            return json.dumps(out)

        df = df.withColumn("_numbers", sampling.at_percentiles(n))
        df = _step(df, "_layout", layouts, "map<string,string>", **limits)
        df = df.withColumn("_prompt", T.let(passes.layout_pass(pages, n, Recorded()), lambda x: prompts.structure(passes.structure_samples(pages, n, x), n)))
        df = _step(df, "_structure", lambda row, budget: budget.run(provider.chat, row["_prompt"]), None, **limits).withColumn("_structure", F.coalesce("_structure", F.lit("{}")))
        df = df.withColumn("_found", structure.profile(F.col("_structure"), n)).withColumn("_headings", F.transform(F.col("_found")["toc"], lambda e: F.struct(e["level"], e["title"], e["page"])))
        df = df.withColumn("_filters", T.let(passes.layout_pass(pages, n, Recorded()), lambda x: F.struct(passes.filter_pattern(x["headers"]).alias("header"), passes.filter_pattern(x["footers"]).alias("footer"))))
        df = page_calls(df.drop("_found"), lambda row: {"language": "auto", **row["_filters"]})
        return df.withColumn("_analysis", none(ANALYSIS)).drop("_numbers", "_prompt", "_filters")
    text = {"direct": F.get(pages, F.lit(0)), "light": sampling.head_text(pages, 5), "full": sampling.head_middle_tail_text(pages), "legacy": sampling.head_text(pages, 3)}[pipeline]
    if pipeline == "direct":
        df = df.withColumn("_analysis", none(ANALYSIS)).withColumn("_headings", none(HEADINGS))
        return page_calls(df, lambda row: {"language": "auto"})
    df = _step(df.withColumn("_text", text), "_analysis", lambda row, budget: json.dumps(budget.run(provider.analyze, row["_text"])), ANALYSIS, **limits)
    if pipeline == "legacy":
        return page_calls(df.withColumn("_headings", none(HEADINGS)), lambda row: {"language": (row["_analysis"] or {}).get("language")}).drop("_text")
    df = _step(df, "_headings", lambda row, budget: json.dumps(budget.run(provider.extract_structure, row["_text"], _plain(row["_analysis"]) or {})), HEADINGS, **limits)
    df = df.withColumn("_headings", F.coalesce("_headings", F.array().cast(HEADINGS))).drop("_text")
    edges = pipelines.edges(pages, n, *((5, 3) if pipeline == "light" else (7, 4)))
    df = df.withColumn("_edges", edges)
    if pipeline == "light":
        return page_calls(df, lambda row: {"language": (row["_analysis"] or {}).get("language"), **row["_edges"]}).drop("_edges")
    df = df.withColumn("_plan", pipelines.window_plan(pages, n, F.col("_headings"), size))
    return _told(_step(df, "_windows", lambda row, budget: json.dumps(_windows(provider, budget.run, _plain(row), gap, parallel)), CONVERTED, **limits), "_windows").drop("_edges", "_plan")


def convert(paged: DataFrame, provider: LiveProvider, pipeline: str, **limits) -> DataFrame:
    """All documents by one pipeline with a live provider, and errors: array<struct<step,at,error>>."""
    told = recorded(paged, provider, pipeline, **limits)
    out = pipelines.convert(told, pipeline, Recorded(), keep=("errors",))
    late = F.exists("errors", lambda e: e["step"] == "document")
    return out.withColumn("markdown", F.when(late, F.lit("")).otherwise(F.col("markdown")))


def classified_images(images: DataFrame, provider: LiveProvider, data: str = "data", **limits) -> DataFrame:
    """images with kind: struct<type,description,is_pure_vector,complexity>, and the error of a failed call.

    A call that fails, an answer without a JSON object and missing parts of one give type
    other, "Unknown image", false and 0.5; pictures without data are not asked for.  limits: of execution.robust_calls.
    """
    kept = images.columns
    told = execution.robust_calls(images.withColumn("_data", F.col(data)), lambda row: "" if row["_data"] is None else provider.classify_image(bytes(row["_data"]), prompts.IMAGE), "_answer", **limits)
    j = F.from_json(F.regexp_extract(F.coalesce("_answer", F.lit("")), r"(?s)\{.*\}", 0), "type string, description string, isPureVector boolean, complexity double")
    parts = {"type": (j["type"], "other"), "description": (j["description"], "Unknown image"), "is_pure_vector": (j["isPureVector"], False), "complexity": (j["complexity"], 0.5)}
    return told.select(*kept, F.struct(*(F.coalesce(x, F.lit(d)).alias(k) for k, (x, d) in parts.items())).alias("kind"), "error")


def connected(provider: LiveProvider, timeout: float = 120.0) -> bool:
    """Whether the provider can be reached with its key; what fails counts as no."""
    return execution.captured(execution.within, timeout, provider.validate_connection)[0] is True


def processed_windows(df: DataFrame, call, name: str = "content", delay: float = 0.5, waits: tuple[float, ...] | None = None, timeout: float = 120.0, sleep=time.sleep) -> DataFrame:
    """df (pages, plan: array<struct<window,start,end>>) with array<struct<window,content,error>>: call(pages of a window) one
    after the other, each failure in its place."""

    def run(row: dict) -> str:
        row = _plain(row)

        def one(w: dict) -> dict:
            got, error = execution.captured(lambda: execution.with_retry(execution.within, timeout, call, row["pages"][w["start"] - 1 : w["end"]], waits=waits))
            return {"window": w["window"], "content": got or "", "error": error}

        return json.dumps(execution.in_sequence(one, row["plan"], delay, sleep))

    got = execution.robust_calls(df, run, name, timeout=1e9, waits=())
    return got.withColumn(name, F.from_json(name, f"array<struct<window:int,content:string,error:{FAILURE}>>")).drop("error")
