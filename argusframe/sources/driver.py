"""What a job asks of its surroundings before it starts, and says at its end: on the driver, with plain files."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

import numpy as np

from argusframe.sources.readers import BadSource


def one_database(folder: str) -> Path:
    """The only database file below a folder; none, or several, are an error."""
    found = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".sqlite", ".db") and p.is_file())
    if len(found) != 1:
        raise BadSource(f"{len(found)} database files below {folder}: {[str(p) for p in found]}")
    return found[0]


def fetched(path: str, announced: int | None) -> Path:
    """A file that came from elsewhere, if it is as long as was announced; a shorter or longer one is an error."""
    found = Path(path)
    if not found.is_file():
        raise BadSource(f"{path} was not fetched")
    if announced is not None and found.stat().st_size != announced:
        raise BadSource(f"{path} has {found.stat().st_size} bytes, but {announced} were announced")
    return found


def write_report(text: str, path: str, outside: str) -> Path:
    """Write a report, but never below the folder ``outside``, wherever links lead."""
    target = Path(path).expanduser().resolve()
    if target.is_relative_to(Path(outside).resolve()):
        raise ValueError(f"{target} lies inside {outside}")
    target.write_text(text)
    return target


def numbers(text: str, low: float, high: float) -> tuple[float, ...]:
    """A comma-separated list of numbers between two bounds, both excluded. An empty list is an error."""
    try:
        found = tuple(float(x) for x in text.split(",") if x.strip())
    except ValueError:
        raise ValueError(f"not a list of numbers: {text!r}") from None
    bad = [x for x in found if not low < x < high]
    if not found or bad:
        raise ValueError(f"{text!r}: {bad or 'nothing'} is out of ({low}, {high})")
    return found


def counts(text: str) -> tuple[int, ...]:
    """A comma-separated list of positive whole numbers; 1e5 is one too."""
    return tuple(int(x) for x in numbers(text, 0.999999, float("inf")))


def latency(call: Callable[[], object], runs: int = 1000, warm_up: int = 50) -> dict[str, float]:
    """Mean, 95th and 99th percentile of the milliseconds a call takes, after calls that don't count."""
    for _ in range(warm_up):
        call()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        call()
        took.append((time.perf_counter() - began) * 1000)
    return {"mean_ms": float(np.mean(took)), "p95_ms": float(np.percentile(took, 95)), "p99_ms": float(np.percentile(took, 99))}
