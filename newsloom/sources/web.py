"""A Python data source that fetches pages: one partition for each address, errors give no rows.

An address may name mirrors, with | between them: they are tried in order until one answers.  As a stream with a `log` folder, every poll is
fetched by tasks, which keep what they got there, so a batch that is run again gives the rows of its first run.
"""

from __future__ import annotations

import contextlib
import http.client
import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


class Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


def fetched(address: str, timeout: float) -> tuple[str, str] | None:
    """(address that answered, body) of the first of an address's mirrors that answers."""
    for url in address.split("|"):
        with contextlib.suppress(OSError, ValueError, http.client.HTTPException):
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                if getattr(answer, "status", 200) in (200, None):
                    return url, answer.read().decode("utf-8", "replace")
    return None


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.timeout = float(options.get("timeout", "15"))

    def partitions(self):
        return [Address(u) for u in self.urls] or [Address("")]

    def read(self, partition: Address):
        if not partition.url:
            return
        page = fetched(partition.url, self.timeout)
        if page:
            yield page


class WebPolls(SimpleDataSourceStreamReader):
    """All addresses once a trigger: the offset counts polls."""

    def __init__(self, options: dict):
        self.reader = WebReader(options)

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def read(self, start: dict):
        rows = [row for p in self.reader.partitions() for row in self.reader.read(p)]
        return iter(rows), {"polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([row for p in self.reader.partitions() for row in self.reader.read(p)])


class Asked(InputPartition):
    """One address in one poll."""

    def __init__(self, number: int, address: str, poll: int):
        self.number, self.address, self.poll = number, address, poll


MOST_SKIPPED = 5  # an address that keeps failing is asked every 2 ** MOST_SKIPPED polls at least


class WebStream(DataSourceStreamReader):
    """Polls whose pages are fetched by tasks, one partition an address.

    An offset is {"poll": n, "ask": numbers of the addresses to ask}.  Each task keeps its page, or that there is none and for how many polls, in
    the folder `log`, which the driver and all executors share; a task that runs again takes the page from there.  An address that
    failed f times in a row is left out of 2 ** f - 1 polls.  Pages of polls before the last committed one are removed.
    """

    def __init__(self, options: dict):
        self.addresses = options.get("urls", "").split()
        self.timeout = float(options.get("timeout", "15"))
        self.uri = options["log"]

    def _folder(self, number: int) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        return files, f"{path}/{number}"

    def _polls(self, number: int) -> list[int]:
        files, path = self._folder(number)
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def _kept(self, number: int, poll: int) -> dict:
        files, path = self._folder(number)
        with files.open_input_stream(f"{path}/{poll}.json") as kept:
            return json.loads(kept.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0, "ask": []}

    def latestOffset(self) -> dict:  # noqa: N802
        last = {n: (self._polls(n) or [0])[-1] for n in range(len(self.addresses))}
        poll = max(last.values(), default=0) + 1
        due = [n for n, p in last.items() if not p or poll - p >= 2 ** min(self._kept(n, p)["failures"], MOST_SKIPPED)]
        if self.addresses and not due:  # a poll that asks nobody still passes
            soonest = min(p + 2 ** min(self._kept(n, p)["failures"], MOST_SKIPPED) for n, p in last.items())
            poll, due = soonest, [n for n, p in last.items() if p + 2 ** min(self._kept(n, p)["failures"], MOST_SKIPPED) == soonest]
        return {"poll": poll, "ask": due}

    def partitions(self, start: dict, end: dict):
        return [Asked(n, self.addresses[n], end["poll"]) for n in end["ask"] if n < len(self.addresses)]

    def read(self, partition: Asked):
        polls = self._polls(partition.number)
        if partition.poll not in polls:
            before = [p for p in polls if p < partition.poll]
            failures = self._kept(partition.number, before[-1])["failures"] if before else 0
            page = fetched(partition.address, self.timeout)
            files, path = self._folder(partition.number)
            files.create_dir(path, recursive=True)
            aside = f"{path}/{uuid.uuid4().hex}"
            with files.open_output_stream(aside) as out:
                out.write(json.dumps({"page": page, "failures": 0 if page else failures + 1}).encode())
            files.move(aside, f"{path}/{partition.poll}.json")
        page = self._kept(partition.number, partition.poll)["page"]
        if page:
            yield tuple(page)

    def commit(self, end: dict) -> None:
        for n in range(len(self.addresses)):
            files, path = self._folder(n)
            for poll in self._polls(n)[:-1]:
                if poll < end["poll"]:
                    files.delete_file(f"{path}/{poll}.json")


class WebSource(DataSource):
    """spark.read or spark.readStream.format("newsloom_web").option("urls", "a b").load(): columns url, body.  Addresses stand apart by blanks.

    As a stream, the option `log` names a shared folder and lets tasks fetch; without it polls are fetched by the driver and a batch that runs again asks again.
    """

    @classmethod
    def name(cls) -> str:
        return "newsloom_web"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)

    def streamReader(self, schema) -> WebStream:  # noqa: N802
        if "log" not in self.options:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "polls by tasks without a log"})
        return WebStream(self.options)

    def simpleStreamReader(self, schema) -> WebPolls:
        return WebPolls(self.options)


def register(spark) -> None:
    spark.dataSource.register(WebSource)


def fetched_pages(links: DataFrame, timeout: float = 15.0, fetch: Callable[[str, float], tuple[str, str] | None] = fetched) -> DataFrame:
    """(url, html) of the distinct links (url) that answer, each fetched once by a task; links that fail give no row."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = [(u, fetch(u, timeout)) for u in frame["url"]]
            yield pd.DataFrame([(u, page[1]) for u, page in pages if page], columns=["url", "html"], dtype=object)

    return links.select("url").filter("url <> ''").distinct().mapInPandas(ask, "url string, html string")
