"""Outside services behind small interfaces: a translator and a label endpoint."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Busy(Exception):
    """The service asks to wait."""


class Translator(Protocol):
    def translate(self, texts: list[str], target: str, source: str) -> list[str]: ...


class LabelClient(Protocol):
    def bindings(self, query: str) -> list[tuple[str, str]]:
        """(id, label) in the order of the answer."""


def patient(call: Callable, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """Call until the service is no longer busy."""
    while True:
        try:
            return call()
        except Busy:
            sleep(wait)


def translated(questions: DataFrame, make: Callable[[], Translator], target: str, source: str = "en", batch: int = 64) -> DataFrame:
    """(uid, question) through one client per task, ``batch`` texts to a call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for part in parts:
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch]
                yield pd.DataFrame({"uid": some["uid"], "question": patient(lambda some=some: client.translate(list(some["question"]), target, source))})

    return questions.select("uid", "question").mapInPandas(run, "uid int, question string")


class SparqlEndpoint:
    """A label client over HTTP: one GET for each query, JSON back; a busy server says so by status 429."""

    def __init__(self, url: str, agent: str = "tamarack", timeout: float = 60.0):
        self.url, self.agent, self.timeout = url, agent, timeout

    def bindings(self, query: str) -> list[tuple[str, str]]:
        asked = urllib.request.Request(
            f"{self.url}?{urllib.parse.urlencode({'query': query, 'format': 'json'})}", headers={"Accept": "application/sparql-results+json", "User-Agent": self.agent}
        )
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise Busy from e
            raise
        return [(b["id"]["value"], b["label"]["value"]) for b in found["results"]["bindings"]]


def labelled(queries: DataFrame, make: Callable[[], LabelClient], pause: float = 3.0, sleep: Callable[[float], None] = time.sleep, clients: int = 1) -> DataFrame:
    """(chunk, pos, id, label): a request per (chunk, query) row, a pause after each that succeeds.

    ``clients`` tasks ask side by side and share the pace: each pauses that many times as long.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for part in parts:
            for chunk, query in zip(part["chunk"], part["query"], strict=True):
                got = patient(lambda query=query: client.bindings(query), sleep=sleep)
                sleep(pause * clients)
                column = lambda values, kind: pd.Series(list(values), dtype=kind)
                yield pd.DataFrame({"chunk": column([chunk] * len(got), "int64"), "pos": column(range(len(got)), "int64"), "id": column((x for x, _ in got), object), "label": column((y for _, y in got), object)})

    return queries.select("chunk", "query").repartition(clients).mapInPandas(run, "chunk long, pos long, id string, label string")


class TableTranslator:
    """An offline translator: a fixed dictionary, unknown texts unchanged."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def translate(self, texts: list[str], target: str, source: str) -> list[str]:
        return [self.known.get(t, t) for t in texts]
