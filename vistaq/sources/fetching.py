"""A data source of fetched pages: a partition per address, tries again, and errors as rows; as a batch and as a stream."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, ord long, url string, body string, fetched_at double, error string"
#: Times that an address is tried, seconds before the second try (then twice as many), seconds that a try may take, and bytes of an answer.
TRIES, WAIT, TIMEOUT, MOST = 3, 0.2, 30.0, 16 << 20


class Address(InputPartition):
    def __init__(self, source: str, ord: int, url: str):
        self.source, self.ord, self.url = source, ord, url


def fetched(one: Address, tries: int = TRIES, wait: float = WAIT, timeout: float = TIMEOUT, most: int = MOST, open_=urllib.request.urlopen) -> tuple:
    """A row of SCHEMA: the body, or after the last try the error. What a server says is wrong with the request itself (400 to 428) isn't tried again."""
    error = None
    for k in range(tries):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            with open_(one.url, timeout=timeout) as answer:
                body = answer.read(most + 1)
            if len(body) > most:
                error = f"more than {most} bytes"
                break
            return one.source, one.ord, one.url, body.decode("utf-8", "replace"), time.time(), None
        except Exception as e:  # one address that fails is a row, not a failed job
            error = f"HTTP {e.code}" if hasattr(e, "code") else str(e) or type(e).__name__
            if 400 <= getattr(e, "code", 0) < 429:
                break
    return one.source, one.ord, one.url, None, time.time(), error


class _Fetch:
    def __init__(self, options: dict):
        self.how = {"tries": int(options.get("tries", TRIES)), "wait": float(options.get("wait", WAIT)), "timeout": float(options.get("timeout", TIMEOUT)), "most": int(options.get("most", MOST))}
        self.addresses = [Address(a.get("source", ""), i, a["url"]) for i, a in enumerate(json.loads(options["addresses"]))]

    def read(self, partition: Address) -> Iterator[tuple]:
        yield fetched(partition, **self.how)


class FetchReader(_Fetch, DataSourceReader):
    def partitions(self) -> list[Address]:
        return self.addresses


class FetchStream(_Fetch, DataSourceStreamReader):
    """All addresses again in each round. An offset is a round's number: rounds are every seconds long and numbered by the clock, so a stream that starts again goes on with the round that it is then. With rounds there are so many and no more, at once."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.every, self.rounds = float(options.get("every", 60.0)), int(options.get("rounds", 0))
        if not self.rounds and self.every <= 0:
            raise ValueError("a round has to take some time")

    def _now(self) -> int:
        return int(time.time() / self.every)

    def initialOffset(self) -> dict:
        return {"round": 0 if self.rounds else self._now() - 1}

    def latestOffset(self) -> dict:
        return {"round": self.rounds or self._now()}

    def partitions(self, start: dict, end: dict) -> list[Address]:
        # of rounds that were missed the last one alone is fetched: pages say what is, not what was
        return [Address(a.source, end["round"] * len(self.addresses) + a.ord, a.url) for a in self.addresses] if end["round"] > start["round"] else []

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """Format fetched_pages. Option addresses: a JSON list of objects with url and source."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)

    def streamReader(self, schema) -> FetchStream:
        return FetchStream(self.options)


def register(spark: SparkSession) -> None:
    from .scratch import ship

    ship(spark)
    spark.dataSource.register(Pages)


def addresses(rows) -> str:
    """The option's value for (source, url) pairs: a row of configuration each, thousands, not millions."""
    return json.dumps([{"source": s, "url": re.sub(r"^file:/(?!/)", "file:///", u)} for s, u in rows])


def told(pages):
    """What a fan-out gives (see web.with_errors): the rows that came, or the errors (source, error) if none did."""
    from .web import with_errors

    return with_errors(pages.where("error is null").drop("error"), pages.where("error is not null").select("source", "error"))
