"""Frames as a Python data source: folders of raw images, or a synthetic camera that fails now and then.

Register with spark.dataSource.register(FrameSource) and read format("frames"). A file source ends at its first failed read;
a camera reconnects within a budget for its whole life, and the first frame after that carries reconnected. As a stream the
source is a camera: frames are taken as they appear in its folder, and a folder that is away is a failed read.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "video string, frame bigint, fps double, width int, height int, should_detect boolean, reset boolean, reconnected boolean, pixels binary"


@dataclass
class Capture:
    """Reads until a failure; cameras reconnect, files don't. attempts is a lifetime budget."""

    read: object
    camera: bool
    attempts: int = 3

    def __post_init__(self) -> None:
        self.opened, self.failures, self.reconnects = 1, 0, 0

    def frames(self) -> Iterator[tuple[bytes, bool]]:
        again = False
        while True:
            pixels = self.read()
            if pixels is not None:
                yield pixels, again
                again = False
                continue
            self.failures += 1
            if not self.camera or self.reconnects >= self.attempts:
                return
            self.reconnects += 1
            self.opened += 1
            again = True

    def stats(self) -> dict[str, int]:
        return {"open_count": self.opened, "read_failures": self.failures, "reconnects": self.reconnects}


class FrameSource(DataSource):
    """Options: path (a folder with one folder of .rgb files per video), width, height, fps, every, max_frames."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FrameReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return CameraReader(self.options)


class FrameReader(DataSourceReader):
    """One partition a video, so that a video's frames come in order."""

    def __init__(self, options) -> None:  # noqa: ANN001
        self.root = options["path"]
        self.width, self.height = int(options.get("width", 64)), int(options.get("height", 48))
        self.fps, self.every, self.most = float(options.get("fps", 30)), int(options.get("every", 1)), int(options.get("max_frames", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.root).iterdir()) if p.is_dir()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = Path(partition.value)
        files = iter(sorted(folder.glob("*.rgb")))
        capture = Capture(lambda: next((f.read_bytes() for f in files), None), camera=False)
        for n, (pixels, again) in enumerate(capture.frames(), 1):
            if self.most and n > self.most:
                return
            yield folder.name, n, self.fps, self.width, self.height, (n - 1) % self.every == 0, again, again, pixels


class CameraReader(SimpleDataSourceStreamReader):
    """Options: path (the folder of one camera), width, height, fps, every, attempts and delay_ms of reconnects, most (frames a batch).

    The offset is the name of the last frame, its number, and how many reconnects there have been, so a restart goes on with
    the same budget. A batch that is read again is the same: frames stay in the folder.
    """

    def __init__(self, options) -> None:  # noqa: ANN001
        self.folder = Path(options["path"])
        self.width, self.height = int(options.get("width", 64)), int(options.get("height", 48))
        self.fps, self.every, self.most = float(options.get("fps", 30)), int(options.get("every", 1)), int(options.get("most", 64))
        self.attempts, self.delay = int(options.get("attempts", 3)), int(options.get("delay_ms", 250)) / 1000

    def initialOffset(self) -> dict:  # noqa: N802
        return {"name": "", "number": 0, "reconnects": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lost, again = int(start["reconnects"]), False
        while not self.folder.is_dir():
            if lost >= self.attempts:
                raise ConnectionError(f"{self.folder} is away after {lost} reconnects")
            lost, again = lost + 1, True
            time.sleep(self.delay)
        names = sorted(f.name for f in self.folder.glob("*.rgb") if f.name > start["name"])[: self.most]
        rows = [self._row(n, start["number"] + k, again and k == 1) for k, n in enumerate(names, 1)]
        return iter(rows), {"name": names[-1] if names else start["name"], "number": start["number"] + len(names), "reconnects": lost}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        names = sorted(f.name for f in self.folder.glob("*.rgb") if start["name"] < f.name <= end["name"])
        again = end["reconnects"] > start["reconnects"]
        return iter([self._row(n, start["number"] + k, again and k == 1) for k, n in enumerate(names, 1)])

    def _row(self, name: str, number: int, again: bool) -> tuple:
        return self.folder.name, number, self.fps, self.width, self.height, (number - 1) % self.every == 0, again, again, (self.folder / name).read_bytes()
