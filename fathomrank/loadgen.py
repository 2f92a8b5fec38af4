"""Load figures: quantiles, windows, saturation, and an open-loop driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quantile is given only with this many samples beyond it.
BEYOND = 100


def quantile_allowed(n: int, q: float) -> bool:
    return n * (1 - q) >= BEYOND - 1e-6


def quantiles(samples: DataFrame, value: str, of: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row of nearest-rank quantiles, null where too few samples lie beyond one."""
    names = {q: f"p{q * 100:g}".replace(".", "_") for q in of}
    row = samples.agg(F.count(value).alias("n"), *[F.expr(f"percentile_disc({q}) within group (order by {value})").alias(names[q]) for q in of])
    return row.select("n", *[F.when(F.col("n") * F.lit(1 - q) >= BEYOND - 1e-6, F.col(names[q])).alias(names[q]) for q in of])


def window_split(samples: DataFrame, at: Column, start, end) -> DataFrame:
    """Samples due in [start, end) and outside it: side, n, mean."""
    inside = (at >= start) & (at < end)
    return samples.groupBy(F.when(inside, "during").otherwise("outside").alias("side")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def without_pauses(latency: Column, pause: Column) -> Column:
    return F.greatest(latency - pause, F.lit(0.0))


def saturation(rungs: list[tuple[float, float]], unloaded: float) -> float | None:
    """The first rate whose median is over twice the unloaded median; rungs are (rate, median)."""
    return next((rate for rate, p50 in rungs if p50 > 2 * unloaded), None)


def ladder(request: Callable[[int], object], rates: tuple[float, ...], count: int, inflight: int) -> list[tuple[float, float, int]]:
    """(rate, median latency, shed) of each rate, least first; the climb ends where over half the requests are shed."""
    out = []
    for rate in sorted(rates):
        run = drive(request, rate, count, inflight)
        out.append((rate, sorted(run.latencies)[(len(run.latencies) - 1) // 2] if run.latencies else float("inf"), run.shed))
        if run.shed * 2 > count:
            break
    return out


def under_write(request: Callable[[int], object], write: Callable[[], object], rate: float, count: int, inflight: int) -> tuple[list[float], list[float]]:
    """Latencies of requests that were due while ``write`` ran and of the others; it begins a third of the way in."""
    run, span = Run(), [0.0, 0.0]

    def job() -> None:
        span[0] = time.monotonic()
        write()
        span[1] = time.monotonic()

    writer = threading.Timer(count / rate / 3, job)
    writer.start()
    run = drive(request, rate, count, inflight)
    writer.join()
    during = [x for due, x in zip(run.due, run.latencies) if span[0] <= due < span[1]]
    return during, [x for due, x in zip(run.due, run.latencies) if not span[0] <= due < span[1]]


def headline(rungs: list[tuple[float, float]], saturated: float) -> float:
    """The rung nearest half the saturated rate, ties to the lower."""
    return min(rungs, key=lambda r: (abs(r[0] - saturated / 2), r[0]))[0]


@dataclass
class Run:
    latencies: list[float] = field(default_factory=list)
    due: list[float] = field(default_factory=list)
    shed: int = 0


def drive(request: Callable[[int], object], rate: float, count: int, inflight: int) -> Run:
    """Send ``count`` requests at fixed times whatever the answers take; those beyond ``inflight`` are shed.

    Latency runs from when a request was due, so a late start counts against the server.
    """
    run, lock, slots, threads = Run(), threading.Lock(), threading.Semaphore(inflight), []
    began = time.monotonic()

    def one(i: int, due: float) -> None:
        try:
            request(i)
            with lock:
                run.latencies.append(time.monotonic() - due)
                run.due.append(due)
        finally:
            slots.release()

    for i in range(count):
        due = began + i / rate
        time.sleep(max(0.0, due - time.monotonic()))
        if not slots.acquire(blocking=False):
            run.shed += 1
            continue
        threads.append(threading.Thread(target=one, args=(i, due)))
        threads[-1].start()
    for t in threads:
        t.join()
    return run
