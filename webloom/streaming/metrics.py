"""Counters of running streams that cost no job: metrics observed while a batch is processed, kept by a listener."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from webloom.sources.pagestore import _open


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """The stream with aggregates over each batch's rows, which Counters(name) keeps."""
    return stream.observe(name, *[m.alias(k) for k, m in metrics.items()])


class Counters(StreamingQueryListener):
    """Keeps the observed metrics of a name, one small file a batch in folder, so that they outlive the driver; a batch that is tried
    again replaces its own."""

    def __init__(self, name: str, folder: str):
        self.name, self.folder = name, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows:
            system, root = _open(self.folder)
            system.create_dir(root)
            with system.open_output_stream(f"{root}/{event.progress.batchId:010d}") as out:
                out.write(json.dumps(row.asDict(), default=str).encode())

    def batches(self) -> list[dict]:
        """The metrics of each batch, in order."""
        system, root = _open(self.folder)
        files = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        out = []
        for info in sorted(files, key=lambda x: x.base_name):
            with system.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
        return out

    def totals(self) -> dict:
        """Sums over all batches."""
        out: dict = {}
        for b in self.batches():
            for k, v in b.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


class LastPassed:
    """The digest of what was passed on last, in a file of folder: a restarted stream doesn't repeat it."""

    def __init__(self, folder: str | None):
        self.folder, self.now = folder, None
        if folder:
            system, root = _open(folder)
            files = sorted((x.base_name, x.path) for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name[0] != ".")
            if files:
                with system.open_input_stream(files[-1][1]) as f:
                    self.now = json.loads(f.read())

    def differs(self, digest: list) -> bool:
        return digest != self.now

    def keep(self, digest: list, batch_id: int) -> None:
        self.now = digest
        if self.folder:
            system, root = _open(self.folder)
            system.create_dir(root)
            aside = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write(json.dumps(digest).encode())
            system.move(aside, f"{root}/{batch_id:010d}")
