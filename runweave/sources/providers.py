"""The seam to services outside: recognisers, catalogues, downloads, codecs.

A provider handles one request at a time or a batch; operators call it inside ``mapInPandas`` and keep the retry rule,
the throttle and the order of sources here, so that a table can stand in for a service in tests. The rate of requests is
per task: ``tasks`` bounds how many run at once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from runweave.functions.rows import RATE_WORDS

ATTEMPTS = 5
FIRST_WAIT = 30.0
JITTER = 0.1


class Provider(Protocol):
    def call(self, request: str) -> str | bytes | None:
        """The answer to one request; raises on failure."""


def waits(attempts: int = ATTEMPTS, first: float = FIRST_WAIT) -> list[float]:
    """Seconds before each further attempt, without jitter: doubling, none after the last attempt."""
    return [first * 2**k for k in range(attempts - 1)]


def with_retry(call: Callable[[str], object], request: str, *, attempts: int = ATTEMPTS, first: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> tuple[object, int, str | None]:
    """(answer, attempts made, last failure). Failures of rate are tried again, all others end at once."""
    pauses = waits(attempts, first)
    message = None
    for k in range(attempts):
        try:
            return call(request), k + 1, None
        except Exception as e:  # noqa: BLE001 - a provider may raise anything
            message = str(e)
            if not any(w in message.lower() for w in RATE_WORDS):
                return None, k + 1, message
            if k < attempts - 1:
                sleep(pauses[k] * (1 + JITTER * chance()))
    return None, attempts, message


def ask(df: DataFrame, request: str, make: Callable[[], Provider], *, answer: str = "answer", binary: bool = False, delay: float = 0.0, tasks: int | None = None, **retry) -> DataFrame:
    """``df`` with the answer to each request, the attempts made and the last failure. A null request is not sent."""
    kind = "binary" if binary else "string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{answer}` {kind}, attempts int, failure string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            rows = []
            for r in f[request]:
                rows.append(with_retry(provider.call, r, **retry) if r is not None else (None, 0, None))
                if delay:
                    time.sleep(delay)
            yield f.assign(**{answer: [r[0] for r in rows], "attempts": [r[1] for r in rows], "failure": [r[2] for r in rows]})

    source = df if tasks is None else df.coalesce(tasks)
    return source.mapInPandas(run, schema)


def waterfall(df: DataFrame, candidates: str, make: Callable[[], Provider]) -> DataFrame:
    """``df`` with source, address and data of the first candidate whose answer is not empty. Candidates are addresses of what is wanted itself;
    where a search has to be read first, ``operators.covers`` goes source by source. They are tried one
    after the other, and those after the first success are not asked."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", source string, address string, data binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            got = []
            for row in f[candidates]:
                hit = (None, None, None)
                for c in row if row is not None else ():
                    try:
                        data = provider.call(c["address"])
                    except Exception:  # noqa: BLE001 - a failed source falls through to the next
                        data = None
                    if data:
                        hit = (c["source"], c["address"], data.encode() if isinstance(data, str) else data)
                        break
                got.append(hit)
            yield f.assign(source=[g[0] for g in got], address=[g[1] for g in got], data=[g[2] for g in got])

    return df.mapInPandas(run, schema)


class TableProvider:
    """Answers from a dictionary; for tests and for replaying recorded answers. A value that is an exception is raised."""

    def __init__(self, answers: dict[str, object]) -> None:
        self.answers = answers

    def call(self, request: str):
        answer = self.answers.get(request)
        if isinstance(answer, Exception):
            raise answer
        return answer
