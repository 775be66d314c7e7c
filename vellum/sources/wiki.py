"""Pages of a wiki as a data source, in batches and as a stream.

`spark.dataSource.register(WikiPages)`, then `spark.read.format("wiki").option("url", ...).option("token", ...).load()` reads ranges of pages, each in a
task of its own; `spark.readStream` reads the pages that have come since the last offset, which the checkpoint keeps.  A wiki answers
`<url>/total` with a number and `<url>/content?start=N&limit=M` with the pages N to N + M, one JSON object a line, oldest change first.  A `file:` url
is an export of the same pages, as export_pages() writes it.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = "page_id long, title string, space string, version int, url string, html string"
NAMES = ("page_id", "title", "space", "version", "url", "html")
#: Options that a wiki needs; an export needs the first alone.
NEEDED = ("url", "token")
#: Attempts at a request, and the seconds before the second, which double.
ATTEMPTS, PAUSE = 3, 0.5


@dataclass
class Wiki:
    """Requests to one wiki; made anew in each task."""

    url: str
    token: str | None
    limit: int

    @classmethod
    def of(cls, options: dict[str, str]) -> Wiki:
        """From options (cases alike); all that are missing or wrong are told at once."""
        given = {k.lower(): v for k, v in options.items()}
        export = given.get("url", "").startswith("file:")
        wrong = [f"option {name} is missing" for name in NEEDED if not given.get(name, "").strip() and not (export and name != "url")]
        limit = given.get("limit", "50")
        if not limit.isdigit() or int(limit) < 1:
            wrong.append(f"option limit must be a whole number from 1 on, not {limit!r}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return cls(given["url"].rstrip("/"), given.get("token"), int(limit))

    def lines(self, path: str, **query: int) -> list[str]:
        """The lines of an answer; failures that may pass are tried again."""
        if self.url.startswith("file:"):
            folder = urllib.request.url2pathname(urllib.parse.urlparse(self.url).path) + f"/{path}" + (f"/start={query['start']}" if query else "")
            names = sorted(n for n in os.listdir(folder) if n[0] not in "._") if os.path.isdir(folder) else []
            return [line for n in names for line in open(f"{folder}/{n}", encoding="utf-8")]
        request = urllib.request.Request(f"{self.url}/{path}" + ("?" + urllib.parse.urlencode(query) if query else ""), headers={"Authorization": f"Bearer {self.token}"})
        for attempt in range(1, ATTEMPTS + 1):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return answer.read().decode().splitlines()
            except urllib.error.HTTPError as error:
                if attempt == ATTEMPTS or error.code < 500 and error.code != 429:
                    raise
            except OSError:
                if attempt == ATTEMPTS:
                    raise
            time.sleep(PAUSE * 2 ** (attempt - 1))
        return []

    def total(self) -> int:
        return int("".join(self.lines("total")).strip() or 0)

    def ranges(self, start: int, end: int) -> list[Range]:
        """Ranges that begin at multiples of the limit, where requests and exports do, clipped to start and end."""
        return [Range(at, max(at, start), min(at + self.limit, end)) for at in range(start - start % self.limit, end, self.limit)]

    def pages(self, part: Range) -> Iterator[tuple]:
        for line in self.lines("content", start=part.at, limit=self.limit):
            if line.strip():
                page = json.loads(line)
                if part.low <= page["seq"] < part.high:
                    yield tuple(page.get(name) for name in NAMES)


@dataclass
class Range(InputPartition):
    """The pages from `low` to before `high` of the answer that begins at `at`."""

    at: int
    low: int
    high: int


class WikiReader(DataSourceReader):
    def __init__(self, wiki: Wiki):
        self.wiki = wiki

    def partitions(self) -> list[Range]:
        return self.wiki.ranges(0, self.wiki.total())

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.wiki.pages(partition) if partition else iter(())


class WikiStream(DataSourceStreamReader):
    def __init__(self, wiki: Wiki):
        self.wiki = wiki

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.wiki.total()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.wiki.ranges(start["pages"], end["pages"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.wiki.pages(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offsets."""


class WikiPages(DataSource):
    """`wiki`: options url, token and limit (pages of a request and of a task, 50)."""

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> WikiReader:
        return WikiReader(Wiki.of(dict(self.options)))

    def streamReader(self, schema) -> WikiStream:
        return WikiStream(Wiki.of(dict(self.options)))


def export_pages(pages: DataFrame, path: str, limit: int = 50) -> None:
    """Writes an export of `pages` (seq from 0 on without gaps, and PAGE) to a folder that all executors share: a file for each `limit` pages, and their number."""
    start = (F.floor(F.col("seq") / limit) * limit).alias("start")
    lines = pages.select(start, F.to_json(F.struct("seq", *NAMES)).alias("value"))
    lines.repartition("start").sortWithinPartitions("start").write.mode("overwrite").partitionBy("start").text(f"{path}/content")
    pages.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/total")
