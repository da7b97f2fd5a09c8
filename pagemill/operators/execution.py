"""Calls to the outside from executors: retries, limits, and errors as columns.

A provider call may fail, be slow or be limited in rate; a row's failure becomes
the row's ``error`` struct and never fails the job.  Tasks can run again, so calls
have to be idempotent.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

ERROR = StructType([StructField("kind", StringType()), StructField("message", StringType()), StructField("status", LongType()), StructField("retryable", BooleanType())])


@dataclass
class CallError(Exception):
    kind: str
    message: str
    status: int | None = None
    retryable: bool = False


def classified(error: BaseException) -> CallError:
    if isinstance(error, CallError):
        return error
    message = str(error)
    low = message.lower()
    if "rate limit" in low or "429" in low:
        return CallError("rate_limit", message, None, True)
    if isinstance(error, (TimeoutError, Late)) or "timeout" in low:
        return CallError("timeout", message or "timeout", None, True)
    found = re.search(r"status[:\s]*(\d{3})", low)
    if found:
        status = int(found[1])
        return CallError("api", message, status, status == 429 or status >= 500)
    return CallError("api", message, None, any(s in low for s in ("503", "econnreset", "network")))


def delays(base: float = 1.0, cap: float = 30.0, within: float = 30.0, most: int = 5) -> Iterable[float]:
    """Waits between attempts: doubling, each at most cap, until so many retries or seconds."""
    spent, wait = 0.0, base
    for _ in range(most):
        wait = min(wait, cap)
        if spent + wait > within:
            return
        yield wait
        spent += wait
        wait *= 2


def with_retry(call: Callable, *args, sleep=time.sleep, waits: Iterable[float] | None = None, until: float = float("inf"), clock=time.monotonic):
    """call(*args), again after each wait while what fails may succeed; no wait goes beyond until."""
    for wait in [*(delays() if waits is None else waits), None]:
        try:
            return call(*args)
        except Exception as e:  # noqa: BLE001 every failure is classified
            known = classified(e)
            if wait is None or not known.retryable or clock() + wait >= until:
                raise known from e
            sleep(wait)


@dataclass
class Budget:
    """The time that all calls for one document may take together."""

    seconds: float
    timeout: float = 120.0
    waits: tuple[float, ...] | None = None
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self.end = self.clock() + self.seconds

    def left(self) -> float:
        return self.end - self.clock()

    def run(self, call: Callable, *args):
        """A call with its own limit and tries, within what is left; none is made once all is spent."""
        if self.left() <= 0:
            raise CallError("timeout", "the document's time is up", None, False)
        return with_retry(lambda *a: within(max(0.0, min(self.timeout, self.left())), call, *a), *args, waits=self.waits, until=self.end, clock=self.clock)


@dataclass
class Limiter:
    """At most so many calls at a time, and a least time between the end of one and the begin of the next."""

    at_once: int = 3
    gap: float = 0.2
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float = field(default=float("-inf"), init=False)

    def __post_init__(self):
        self._free, self._lock = threading.Semaphore(self.at_once), threading.Lock()

    def run(self, call: Callable, *args):
        with self._free:
            with self._lock:
                wait = self._last + self.gap - self.clock()
            if wait > 0:
                self.sleep(wait)
            try:
                return call(*args)
            finally:
                with self._lock:
                    self._last = self.clock()


def in_order(call: Callable, items: list, at_once: int = 3) -> list:
    """call over items, at most at_once together, results in the items' order."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(call, items))


def within(seconds: float, call: Callable, *args):
    """call(*args), or a timeout so many seconds after it began; a call that hangs is left behind and holds nobody up."""
    got: list = []

    def run():
        try:
            got.append((call(*args), None))
        except BaseException as e:  # noqa: BLE001 raised again where it is waited for
            got.append((None, e))

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if not got:
        raise CallError("timeout", "timeout", None, True)
    result, error = got[0]
    if error is not None:
        raise error
    return result


def in_sequence(call: Callable, items: Iterable, delay: float = 0.5, sleep=time.sleep) -> list:
    """call over items one after the other, with a delay between two."""
    out = []
    for k, x in enumerate(items):
        if k:
            sleep(delay)
        out.append(call(x))
    return out


def in_batches(call: Callable, items: list, size: int = 5, delay: float = 0.5, sleep=time.sleep, waits: Iterable[float] | None = None, report: Callable[[int, int], None] = lambda done, total: None) -> list:
    """call(batch) over slices of items, each tried again as a whole, with a delay between two; results in one list."""
    batches = [items[i : i + size] for i in range(0, len(items), size)]
    out: list = []

    def one(batch):
        out.extend(with_retry(call, batch, sleep=sleep, waits=waits))
        report(len(out), len(items))

    in_sequence(one, batches, delay, sleep)
    return out


@dataclass
class Progress:
    """The last state told by any thread."""

    state: tuple[int, int, str] = (0, 0, "")

    def __post_init__(self):
        self._lock = threading.Lock()

    def tell(self, current: int, total: int, status: str = "") -> None:
        with self._lock:
            self.state = (current, total, status)


def captured(call: Callable, *args) -> tuple:
    """(result, None), or (None, the error as a dict with the fields of ERROR)."""
    try:
        return call(*args), None
    except Exception as e:  # noqa: BLE001 every failure is classified
        c = classified(e)
        return None, {"kind": c.kind, "message": c.message, "status": c.status, "retryable": c.retryable}


def robust_calls(df: DataFrame, call: Callable[[dict], str], name: str = "result", at_once: int = 3, gap: float = 0.0, timeout: float = 120.0, waits: tuple[float, ...] | None = None, lanes: int = 0) -> DataFrame:
    """df with the string result of call(row) and an error struct, one of which is null, for each row.

    at_once and gap hold in each task.  lanes, if any, is the number of tasks of this stage, however many rows and
    executors there are: then lanes * at_once calls run at a time in all, and lanes calls a gap begin.
    timeout holds for each attempt, from its begin; one that is late counts as failed and is tried again as other failures are.
    """
    schema = StructType([*(f for f in df.schema.fields if f.name not in (name, "error")), StructField(name, StringType()), StructField("error", ERROR)])
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches):
        limiter = Limiter(at_once, gap)
        one = lambda row: captured(limiter.run, lambda r: with_retry(within, timeout, call, r, waits=waits), row)
        for pdf in batches:
            done = in_order(one, pdf[kept].to_dict("records"), at_once)
            yield pdf[kept].assign(**{name: [d[0] for d in done], "error": [d[1] for d in done]})

    return (df.repartition(lanes) if lanes else df).mapInPandas(run, schema)


def error_rollup(rows: DataFrame, key: str = "doc_id", order: str = "page") -> DataFrame:
    """(key, pages, errors, full_success): an error's kind and place for each failed row, in order."""
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(F.col(order).alias("at"), F.col("error.kind").alias("kind")))))
    got = rows.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("pages"), failed.alias("e"))
    return got.select(key, "pages", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["at"].cast("string"), x["kind"])), ",").alias("errors"), (F.size("e") == 0).alias("full_success"))
