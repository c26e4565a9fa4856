"""A Spark data source over folders of captured list responses.

    spark.dataSource.register(CapturedLists)
    spark.read.format("captured_lists").option("path", folder).load().where("channel_id = '3'")

The folder is one that every worker can open by its path (a mounted share; for object stores use ``captures.read_captures``). It has
one sub-folder per channel and one JSON file per page, named by its number. Each channel is a partition of
the read; an equality on the channel is pushed down and leaves out the other folders before anything is opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "channel_id string, requested_page int, item_index int, api_id string, title string, url string, display_date string, total_count bigint"


class Channel(InputPartition):
    def __init__(self, channel_id: str, path: str):
        super().__init__(channel_id)
        self.channel_id, self.path = channel_id, path


class ListReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel_id",) and self.only in (None, f.value):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        folders = sorted(p for p in Path(self.path).iterdir() if p.is_dir())
        return [Channel(p.name, str(p)) for p in folders if self.only in (None, p.name)]

    def read(self, partition: Channel) -> Iterator[tuple]:
        for page in sorted(Path(partition.path).glob("*.json"), key=lambda p: int(p.stem)):
            data = (json.loads(page.read_text()) or {}).get("data") or {}
            for i, r in enumerate(data.get("list") or []):
                text = lambda *names, r=r: next((str(r[n]) for n in names if r.get(n) not in (None, "")), "")
                yield partition.channel_id, int(page.stem), i, text("id"), text("title", "name"), text("url", "link", "linkUrl", "website"), text("display_date", "displayDate"), data.get("totalCount")


class CapturedLists(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_lists"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListReader:  # noqa: ARG002
        return ListReader(self.options["path"])
