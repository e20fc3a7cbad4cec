"""Answers of an HTTP interface as a Spark data source: every combination of the parameters' values is a request.

spark.dataSource.register(RequestSource)
spark.read.format("http_requests").option("url", "http://host/prices?d={district}&y={year}")
    .option("district", "7,9").option("year", "2006..2025").load()

The driver counts the combinations and gives each task a range of their numbers; a task works out its own parameters and
asks one after another, so requestsPerTask and the number of cores say how many are asked at once. A request that fails is
asked again after a pause, up to `tries` times; what it gave in the end is a row in any case, so one bad request costs
no other.
"""

from __future__ import annotations

import itertools
import math
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "request map<string, string>, url string, status int, tries int, body string, error string"


def listed_values(text: str) -> range | list[str]:
    """ "a,b,c", or "2006..2025" for whole numbers with both ends."""
    span = re.match(r"\s*(-?\d+)\.\.(-?\d+)\s*$", text)
    return range(int(span[1]), int(span[2]) + 1) if span else [v.strip() for v in text.split(",") if v.strip()]


@dataclass
class Numbers(InputPartition):
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.first, self.last))


class RequestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.url = low["url"]
        self.names = list(dict.fromkeys(re.findall(r"{(\w+)}", self.url)))
        missing = [n for n in self.names if n.lower() not in low]
        if missing:
            raise ValueError(f"no values for {', '.join(missing)}")
        self.values = [listed_values(low[n.lower()]) for n in self.names]
        self.tries, self.timeout = int(low.get("tries", "3")), float(low.get("timeout", "120"))
        self.pauses = [float(x) for x in low.get("pauses", "5,10").split(",")]
        self.between, self.per_task = float(low.get("between", "0")), int(low.get("requestspertask", "20"))

    def partitions(self) -> list[InputPartition]:
        n = math.prod(len(v) for v in self.values)
        return [Numbers(a, min(a + self.per_task, n)) for a in range(0, n, self.per_task)] or [Numbers(0, 0)]

    def parameters(self, number: int) -> dict[str, str]:
        out = {}
        for name, values in reversed(list(zip(self.names, self.values))):
            number, at = divmod(number, len(values))
            out[name] = str(values[at])
        return {n: out[n] for n in self.names}

    def read(self, part: Numbers) -> Iterator[tuple]:
        for i in range(part.first, part.last):
            if i > part.first:
                time.sleep(self.between)
            given = self.parameters(i)
            url = self.url.format(**{k: urllib.parse.quote(v, safe="") for k, v in given.items()})
            yield (given, url, *self.asked(url))

    def asked(self, url: str) -> tuple[int | None, int, str | None, str | None]:
        """status, tries, body, error. Only what may pass is asked again: no connection, no answer in time, a busy or broken server."""
        status, error = None, None
        for n in itertools.count(1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return answer.status, n, answer.read().decode("utf-8", "replace"), None
            except urllib.error.HTTPError as e:
                status, error = e.code, f"HTTP {e.code}"
                again = e.code in (408, 425, 429) or e.code >= 500
            except (OSError, ValueError) as e:
                status, error, again = None, f"{type(e).__name__}: {e}", isinstance(e, OSError)
            if not again or n >= self.tries:
                return status, n, None, error
            time.sleep(self.pauses[min(n, len(self.pauses)) - 1])


class RequestSource(DataSource):
    """options: url with {names}, values of each name ("a,b" or "1..9"), tries (3), timeout (120 s), pauses between tries ("5,10" s),
    between (seconds between a task's requests), requestsPerTask (20)."""

    @classmethod
    def name(cls) -> str:
        return "http_requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return RequestReader(dict(self.options))


def ask(spark: SparkSession, url: str, values: dict[str, str], **options: str) -> DataFrame:
    """request, url, status, tries, body, error: one row for each combination of the values, failed ones with an error."""
    spark.dataSource.register(RequestSource)
    return spark.read.format("http_requests").options(url=url, **values, **options).load()


def ask_each(requests: DataFrame, url: str, tasks: int, **options: str) -> DataFrame:
    """The same for the requests of a table, whose columns are the url's names: what is outstanding, say. Dealt to `tasks` tasks."""
    names = list(dict.fromkeys(re.findall(r"{(\w+)}", url)))
    reader = RequestReader({"url": url, **{n: "" for n in names}, **options})

    def answers(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                given = {n: str(v) for n, v in zip(names, row)}
                full = url.format(**{k: urllib.parse.quote(v, safe="") for k, v in given.items()})
                rows.append((given, full, *reader.asked(full)))
                time.sleep(reader.between)
            yield pd.DataFrame(rows, columns=["request", "url", "status", "tries", "body", "error"])

    return requests.select(*names).repartition(tasks).mapInPandas(answers, SCHEMA)
