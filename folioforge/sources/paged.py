"""A source that is read page by page: ``spark.read.format("paged")``, a partition a page, and a stream of what is appended.

A page is JSON with ``total``, ``version`` (which may be absent) and ``items``: a list of objects with ``key`` and ``data``. Pages come from an address that
takes ``start`` and ``limit``, with retries on the states that pass, or lie in a folder as ``start=N`` in any file system that Arrow or
Spark's own path names reach. Options: ``address``, ``pageSize`` (100), ``mode``: with ``exact`` (the default) every page
has to be as full as the declared total asks, with one total and one version; with ``lenient`` a short page
ends nothing but itself.

Rows: start, place, key, version, item_type, date_modified, data (as JSON). ``exact_read`` adds what no single page can tell: that
no key is repeated, and that the rows are as many as was declared."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.order import running
from ..session import kept

PAGE = 100
SCHEMA = "start long, place long, key string, version long, item_type string, date_modified string, data string"
#: States that pass, tries, and the first wait in seconds, doubled each time.
PASSING, TRIES, WAIT = frozenset({429, 500, 502, 503, 504}), 4, 0.2
CHILD_TYPES = ("attachment", "note", "annotation")


class Incomplete(ValueError):
    """A paged source does not hold what it says it holds."""


def fetched(address: str, tries: int = TRIES, wait: float = WAIT) -> bytes:
    """What an address answers; states that pass, and lost connections, are tried again."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(address, timeout=30) as answer:  # noqa: S310
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or n == tries - 1:
                raise
        except urllib.error.URLError:
            if n == tries - 1:
                raise
        time.sleep(wait * 2**n)
    raise AssertionError


def page_at(address: str, start: int, limit: int) -> dict:
    """One page, checked for its form."""
    if address.startswith(("http://", "https://")):
        joint = "&" if "?" in address else "?"
        raw = fetched(f"{address}{joint}{urllib.parse.urlencode({'start': start, 'limit': limit})}")
    else:
        system, base = pafs.FileSystem.from_uri(address)
        found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(f"{base}/start={start}", allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
        raw = b"".join(system.open_input_stream(f).read() for f in found)
        if not raw:
            return {"total": None, "version": None, "items": []}
    page = json.loads(raw)
    if not isinstance(page, dict) or not isinstance(page.get("items"), list) or not all(isinstance(i, dict) and isinstance(i.get("data"), dict) for i in page["items"]):
        raise Incomplete(f"page {start} is not a list of items")
    total = page.get("total")
    if isinstance(total, bool) or not isinstance(total, int) or total < 0:
        raise Incomplete(f"page {start} declares no total")
    return page


def rows_of(page: dict, start: int) -> Iterator[tuple]:
    seen = set()
    for place, item in enumerate(page["items"]):
        data, outer, inner = item["data"], item.get("key"), item["data"].get("key")
        if outer is not None and inner is not None and outer != inner:
            raise Incomplete(f"an item of page {start} has two keys, {outer} and {inner}")
        key = outer if outer is not None else inner
        if not isinstance(key, str) or not key.strip():
            raise Incomplete(f"an item of page {start} has no key")
        if key in seen:
            raise Incomplete(f"key {key} is repeated on page {start}")
        seen.add(key)
        yield start, start + place, key, item.get("version"), data.get("itemType"), data.get("dateModified"), json.dumps(data, sort_keys=True, ensure_ascii=False)


@dataclass
class Page(InputPartition):
    start: int
    upto: int
    total: int
    version: int | None


class _Pages:
    """What the reader and the stream share."""

    def __init__(self, options: dict) -> None:
        self.address, self.size = options["address"], int(options.get("pagesize", PAGE))
        self.exact = options.get("mode", "exact") == "exact"

    def _first(self) -> dict:
        page = page_at(self.address, 0, self.size)
        return page | {"total": page["total"] or 0}

    def _split(self, lo: int, hi: int, total: int, version: int | None) -> list[Page]:
        return [Page(s, min(s + self.size, hi), total, version) for s in range(lo - lo % self.size, hi, self.size)]

    def _rows(self, page: Page, since: int = 0) -> Iterator[tuple]:
        got = page_at(self.address, page.start, self.size)
        if self.exact:
            if (got["total"], got.get("version")) != (page.total, page.version):
                raise Incomplete(f"the source changed while it was read: page {page.start} declares {got['total']} rows, version {got.get('version')}")
            want = min(self.size, page.total - page.start)
            if len(got["items"]) != want:
                raise Incomplete(f"page {page.start} has {len(got['items'])} rows, not {want}")
        for row in rows_of(got, page.start):
            if since <= row[1] < page.upto or not self.exact and row[1] >= since:
                yield row


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        first = self._first()
        return self._split(0, first["total"], first["total"], first.get("version")) or [Page(0, 0, 0, first.get("version"))]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.total:
            yield from self._rows(partition)


class PagedStream(_Pages, DataSourceStreamReader):
    """Rows are appended and stay where they are; an offset is how many there are."""

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self._first()["total"]}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.exact = False  # more may be appended meanwhile
        return [Page(p.start, p.upto, start["rows"], None) for p in self._split(start["rows"], end["rows"], 0, None)]

    def read(self, partition: Page) -> Iterator[tuple]:
        self.exact = False
        for row in self._rows(partition, since=partition.total):
            if row[1] < partition.upto:
                yield row

    def commit(self, end: dict) -> None:
        return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> PagedStream:
        return PagedStream({k.lower(): v for k, v in self.options.items()})


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PagedSource)
    return spark


def exact_read(spark: SparkSession, address: str, page_size: int = PAGE) -> DataFrame:
    """Every row of the source, read once and kept; an error if they are not as many as declared, or a key is there twice."""
    total = _Pages({"address": address, "pagesize": page_size})._first()["total"]
    rows = kept(registered(spark).read.format("paged").option("address", address).option("pageSize", page_size).load(), "paged")
    told = rows.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).first()  # one row
    if told["n"] != total:
        raise Incomplete(f"{told['n']} of {total} rows")
    if told["keys"] != told["n"]:
        raise Incomplete(f"{told['n'] - told['keys']} keys are repeated")
    return rows


def top_level(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Items without the types that hang from others. With a ``limit``, reading stops after the first page by which so
    many are kept, and the rest of that page is cut."""
    kept_rows = rows.filter(~F.coalesce(F.lower("item_type").isin(*CHILD_TYPES), F.lit(False)))
    if limit is None:
        return kept_rows
    return running(kept_rows, F.lit(1), [F.col("place")], name="_before").filter(F.col("_before") < limit).drop("_before")


def write_pages(items: DataFrame, folder: str, page_size: int = PAGE, version: int = 1) -> int:
    """Captured pages of ``items`` (place from 0, key, data as JSON) as a folder that this source reads; how many rows they declare."""
    total = items.count()
    item = F.concat(F.lit('{"key":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(f',"version":{version},"data":'), F.col("data"), F.lit("}"))
    pages = items.select((F.floor(F.col("place") / page_size) * page_size).alias("start"), "place", item.alias("item")).groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]), ",").alias("items"))
    line = F.concat(F.lit(f'{{"total":{total},"version":{version},"items":['), "items", F.lit("]}"))
    pages.select("start", line.alias("value")).repartition("start").write.partitionBy("start").text(folder)
    return total
