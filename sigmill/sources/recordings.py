"""Multichannel recordings as Spark data sources: European Data Format, EEGLAB and Brain Products files.

``recordings`` reads samples (stream, t, channel, value), ``recording_markers`` markers (stream, t,
seconds, marker); a stream is a
header file. Headers are read when the scan is planned; the data of each recording is cut into ranges of whole records of
about ``split`` bytes (an option), and each range is a task that reads its bytes and no others, whatever the length of the
recording. Files of markers are cut in the same way, at lines: what planning hands to a task doesn't grow with them. Filters on channel and stream are taken over: other channels aren't decoded, other files aren't read. (Spark
hands filters over only where ``spark.sql.python.filterPushdown.enabled`` is set; ``read`` tells the source, by the option
pushdown, which Spark asks for.)

``recording_pieces`` writes: each task writes multiplexed samples (of 16 bits, where they fit) and their markers as pieces of a Brain Products
recording, and the headers that make pieces visible are written when the whole job commits. What a failed task or job wrote
goes. Paths are those of the store that pyarrow's file systems open: local and shared folders, object stores, HDFS.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sigmill.sources import matfile
from sigmill.sources.edf import ANNOTATIONS
from sigmill.sources.edf import header as edf_header
from sigmill.sources.files import ini_sections

SPLIT = 64 << 20
#: Markers that go on together.
AT_ONCE = 10_000
SAMPLES, MARKERS = "stream string, t long, channel string, value double", "stream string, t long, seconds double, marker string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def content(path: str, size: int | None = None) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        return f.read() if size is None else f.read(size)


def found(path: str) -> list[str]:
    """The header files at or below a path, in order, as paths of the form they were asked for."""
    system, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(head + x.path for x in every if x.is_file and x.path.lower().endswith((".edf", ".set", ".vhdr")))


@dataclass
class Recording:
    """How to read one recording: where its data is, records of so many bytes, and samples in a record; each channel's name,
    first value and number of values in a record, and its line from numbers to values; the file of its markers. Every task
    gets a copy, so it holds nothing that grows with the recording."""

    stream: str
    data: str
    start: int
    record: int
    records: int
    rate: int  # samples of the fastest channel in a record
    kind: str
    channels: list[tuple[str, int, int, float, float]]
    annotations: list[tuple[int, int]] = field(default_factory=list)
    seconds: float = 1.0  # of a record
    markers: str | None = None  # a text with a line for each, or the header with its events
    first: int = 0  # t of the first sample
    codes: tuple[float, float] | None = None  # numbers that stand for no sample and for no value


def size_of(path: str) -> int:
    system, at = opened(path)
    info = system.get_file_info(at)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def beside(path: str, name: str) -> str:
    return path.rsplit("/", 1)[0] + "/" + name


def each(x) -> list[dict]:
    return [x] if isinstance(x, dict) else list(x) if isinstance(x, list) else []


def eeglab(path: str) -> dict:
    variables = matfile.read(content(path))
    return variables.get("EEG", variables)


def described(path: str, name: str | None = None) -> Recording:
    """From the header alone."""
    stream, kind = name or path, path.rsplit(".", 1)[1].lower()
    if kind == "edf":
        n = int(content(path, 256)[252:256])
        h = edf_header(content(path, 256 * (n + 1)))
        size = np.array(h["samples"])
        first, record = np.cumsum(size) - size, int(size.sum()) * 2
        real = [k for k, x in enumerate(h["label"]) if x != ANNOTATIONS]
        records = h["records"] if h["records"] >= 0 else (size_of(path) - h["bytes"]) // record
        line = []
        for k in real:
            low, high, dlow, dhigh = (float(h[x][k]) for x in ("physical_min", "physical_max", "digital_min", "digital_max"))
            gain = (high - low) / (dhigh - dlow)
            line.append((h["label"][k], int(first[k]), int(size[k]), gain, low - dlow * gain))
        return Recording(stream, path, h["bytes"], record, records, max((int(size[k]) for k in real), default=0), "<i2", line, [(int(first[k]), int(size[k])) for k, x in enumerate(h["label"]) if x == ANNOTATIONS], h["seconds"])
    if kind == "set":
        eeg = eeglab(path)
        if not isinstance(eeg["data"], str):
            raise ValueError(f"{path}: the samples are in the header file; a data file beside it is needed")
        if int(eeg["trials"][0]) != 1:
            raise ValueError(f"{path}: the recording is cut into trials")
        n = int(eeg["nbchan"][0])
        labels = [c["labels"] for c in each(eeg["chanlocs"])] or [str(k + 1) for k in range(n)]
        data = beside(path, eeg["data"].rsplit("/", 1)[-1].rsplit("\\", 1)[-1])
        return Recording(stream, data, 0, 4 * n, size_of(data) // (4 * n), 1, "<f4", [(c, k, 1, 1.0, 0.0) for k, c in enumerate(labels)], [], 1 / float(eeg["srate"][0]), path)
    info = ini_sections(content(path).decode("utf-8", "replace"))
    common = info["Common Infos"]
    lines = [v.split(",") for _, v in sorted(info["Channel Infos"].items(), key=lambda x: int(x[0][2:]))]
    kind = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}[info["Binary Infos"]["BinaryFormat"]]
    record, data, first = np.dtype(kind).itemsize * len(lines), beside(path, common["DataFile"]), int(common.get("FirstSample", 0))
    codes = (float(common["NoSample"]), float(common["NoValue"])) if "NoSample" in common else None
    markers = beside(path, common["MarkerFile"]) if "MarkerFile" in common else None
    return Recording(stream, data, 0, record, size_of(data) // record, 1, kind, [(x[0].replace("\\1", ","), k, 1, float(x[2] or 1), 0.0) for k, x in enumerate(lines)], [], float(common["SamplingInterval"]) / 1e6, markers, first, codes)


class Range(InputPartition):
    def __init__(self, recording: Recording, first: int, count: int):
        self.recording, self.first, self.count = recording, first, count

    def raw(self) -> np.ndarray:
        """Its records, a row each."""
        r = self.recording
        system, at = opened(r.data)
        with system.open_input_file(at) as f:
            data = f.read_at(self.count * r.record, r.start + self.first * r.record)
        return np.frombuffer(data, r.kind, count=len(data) // r.record * (r.record // np.dtype(r.kind).itemsize)).reshape(-1, r.record // np.dtype(r.kind).itemsize)


class Lines(InputPartition):
    """The lines of a text of markers that begin within a range of its bytes; inside: the range begins among the markers."""

    def __init__(self, recording: Recording, start: int, end: int, inside: bool):
        self.recording, self.start, self.end, self.inside = recording, start, end, inside

    def read(self) -> Iterator[bytes]:
        system, at = opened(self.recording.markers)
        with system.open_input_file(at) as raw:
            raw.seek(max(0, self.start - 1))
            f, place = io.BufferedReader(raw, 1 << 20), self.start
            if self.start:
                place += len(f.readline()) - 1  # the end of a line that began before
            while place < self.end and (line := f.readline()):
                place += len(line)
                yield line

    def marks(self) -> Iterator[tuple[int, str]]:
        inside = self.inside
        for raw in self.read():
            line = raw.decode("utf-8", "replace").strip()
            if m := re.fullmatch(r"\[(.+)\]", line):
                inside = m[1] == "Marker Infos"
            elif inside and "=" in line and not line.startswith(";"):
                _, name, at, *_ = line.split("=", 1)[1].split(",")
                if name.strip():
                    yield int(at) - 1 + self.recording.first, re.sub(r"\s+", " ", name.replace("\\1", ",")).strip()


def marker_parts(r: Recording, split: int) -> list[Lines]:
    """The text of a recording's markers in ranges. Other sections may follow the markers, so a text of several ranges is
    looked through for where sections begin, a line at a time."""
    size = size_of(r.markers)
    if size <= split:
        return [Lines(r, 0, size, False)]
    out, at, spans = [], 0, []
    for line in Lines(r, 0, size, False).read():
        if m := re.fullmatch(rb"\[(.+)\]", line.strip()):
            spans.append((at, m[1] == b"Marker Infos"))
        at += len(line)
    for (start, markers), (end, _) in zip(spans, [*spans[1:], (size, False)]):
        if markers:
            out += [Lines(r, k, min(k + split, end), k > start) for k in range(start, end, split)]
    return out


class _Reader(DataSourceReader):
    """Partitions, and the filters that the source takes over."""

    own = ("channel", "stream")

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.only: dict[str, set | None] = {c: None for c in self.own}

    def wanted(self, column: str, value: str) -> bool:
        return self.only.get(column) is None or value in self.only[column]

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in found(self.path):
            if self.wanted("stream", path):
                out += self.parts(described(path))
        return out

    def parts(self, r: Recording) -> list[InputPartition]:
        step = max(1, self.split // r.record)
        return [Range(r, k, min(step, r.records - k)) for k in range(0, r.records, step)] or [Range(r, 0, 0)]


class _Pushed:
    """What a reader has more where filters are handed over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.only:
                values, c = {f.value} if isinstance(f, EqualTo) else set(f.value), f.attribute[0]
                self.only[c] = values if self.only[c] is None else self.only[c] & values
            else:
                yield f


class SampleReader(_Reader):
    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # as Spark asks where there are no partitions
            return
        r = partition.recording
        data = partition.raw()
        for name, at, n, gain, offset in r.channels:
            if self.wanted("channel", name) and len(data):
                number = np.repeat(data[:, at : at + n].ravel().astype(float), r.rate // n)
                t = np.arange(len(number)) + partition.first * r.rate + r.first
                empty = None
                if r.codes is not None:  # samples that were never there make no row
                    there = number != r.codes[0]
                    number, t = number[there], t[there]
                    empty = number == r.codes[1]
                value = number * gain + offset
                same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(value), np.int8)), pa.array([x])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([same(r.stream), pa.array(t, pa.int64()), same(name), pa.array(value, mask=empty)], names=["stream", "t", "channel", "value"])


class MarkerReader(_Reader):
    own = ("stream",)

    def parts(self, r: Recording) -> list[InputPartition]:
        if r.markers is None:
            return super().parts(r) if r.annotations else [Range(r, 0, 0)]
        return [Range(r, 0, 0)] if r.markers.lower().endswith(".set") else marker_parts(r, self.split)

    def read(self, partition: Range | Lines | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # as Spark asks where there are no partitions
            return
        r = partition.recording
        if isinstance(partition, Lines):
            marks = ((t, t * r.seconds, m) for t, m in partition.marks())
        else:
            marks = self.events(r) if r.markers is not None else self.annotated(partition)
        while some := list(islice(marks, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array([r.stream] * len(some)), *(pa.array([m[k] for m in some], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.string())))], names=["stream", "t", "seconds", "marker"])

    def events(self, r: Recording) -> Iterator[tuple[int, float, str]]:
        for e in each(eeglab(r.markers).get("event", [])):
            if len(e["latency"]):
                t = int(round(float(e["latency"][0]))) - 1
                yield t, t * r.seconds, (e["type"] if isinstance(e["type"], str) else f"{e['type'][0]:g}").strip()

    def annotated(self, partition: Range) -> Iterator[tuple[int, float, str]]:
        r = partition.recording
        for at, n in r.annotations:
            for record in partition.raw()[:, at : at + n]:
                for entry in record.tobytes().split(b"\x00"):
                    onset, *texts = entry.split(b"\x14")
                    at_s = float(onset.split(b"\x15")[0] or 0) if texts else 0.0
                    yield from ((int(round(at_s / r.seconds * r.rate)), at_s, x.decode("utf-8").strip()) for x in texts if x.strip())


class PushedSampleReader(_Pushed, SampleReader):
    pass


class PushedMarkerReader(_Pushed, MarkerReader):
    pass


class Recordings(DataSource):
    readers = (SampleReader, PushedSampleReader)

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.readers[self.options.get("pushdown") == "true"](self.options)


class RecordingMarkers(Recordings):
    readers = (MarkerReader, PushedMarkerReader)

    @classmethod
    def name(cls) -> str:
        return "recording_markers"

    def schema(self) -> str:
        return MARKERS


#: By the kind of a piece: its name in the header, numbers for no sample and for no value, and the largest number of a value.
KINDS = {"<i2": ("INT_16", -(1 << 15), 1 - (1 << 15), (1 << 15) - 2), "<f4": ("IEEE_FLOAT_32", -float(1 << 127), -float(1 << 126), float("inf"))}


@dataclass
class Pieces(WriterCommitMessage):
    """What a task wrote: names without ending, the first t and the kind of each."""

    names: list[tuple[str, int, str]]


class PieceWriter(DataSourceArrowWriter):
    """Rows have t, marker (null for none) and a column for each channel, and come in the order of t. Gaps are filled with a
    number that the header names and that reads as no sample, a null value with another one; a gap longer than ``gap``
    samples begins a new piece; of rows with the same t the first counts. Where values are beyond 16 bits at the resolution,
    a piece of 32-bit floats begins: they hold multiples of it exactly up to 2^24, and NaN and infinite values."""

    def __init__(self, schema: StructType, options: dict):
        self.channels = [f.name for f in schema if f.name not in ("t", "marker")]
        self.path, self.rate, self.scale, self.gap = options["path"], float(options["rate"]), float(options.get("resolution", 0.1)), int(options.get("gap", 10_000))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Pieces:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, str]] = []
        data = marks = None
        last = number = 0
        try:
            for b in batches:
                at = np.asarray(b.column("t")).astype(np.int64)
                if not b.num_rows:
                    continue
                x = np.stack([np.asarray(b.column(c).cast(pa.float64()).fill_null(0.0)) for c in self.channels], 1)
                x = np.round(x / self.scale)
                kind = "<i2" if (np.abs(x) <= KINDS["<i2"][3]).all() else "<f4"
                _, nothing, null, _ = KINDS[kind]
                x[np.stack([np.asarray(b.column(c).is_null()) for c in self.channels], 1)] = null
                x, filler = x.astype(kind), np.array([nothing], kind).tobytes()
                for t, row, marker in zip(at.tolist(), x, b.column("marker").to_pylist()):
                    if data is None or t - last > self.gap or (t > last and done[-1][2] != kind):
                        for f in (data, marks):
                            if f is not None:
                                f.close()
                        name = f"piece-{t:015d}-{uuid.uuid4().hex}"
                        done.append((name, t, kind))
                        data, marks, last, number = system.open_output_stream(f"{root}/{name}.eeg"), system.open_output_stream(f"{root}/{name}.vmrk"), t - 1, 1
                        marks.write(f"Brain Vision Data Exchange Marker File, Version 1.0\n\n[Common Infos]\nDataFile={name}.eeg\n\n[Marker Infos]\n".encode())
                    if t > last:
                        data.write(filler * ((t - last - 1) * len(self.channels)) + row.tobytes())
                        last = t
                    if marker is not None:
                        sort = "Response" if "R" in marker else "Stimulus" if "S" in marker else "Label"
                        marks.write(f"Mk{number}={sort},{marker.replace(',', chr(92) + '1')},{t - done[-1][1] + 1},1,0\n".encode())
                        number += 1
            for f in (data, marks):
                if f is not None:
                    f.close()
        except BaseException:
            self._away(done)
            raise
        return Pieces(done)

    def _away(self, names: list[tuple[str, int, str]]) -> None:
        system, root = opened(self.path)
        for name, *_ in names:
            for end in (".eeg", ".vmrk", ".vhdr"):
                try:
                    system.delete_file(f"{root}/{name}{end}")
                except FileNotFoundError:
                    pass

    def commit(self, messages: list[Pieces | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        lines = "".join(f"Ch{k + 1}={c.replace(',', chr(92) + '1')},,{self.scale!r},µV\n" for k, c in enumerate(self.channels))
        for name, first, kind in (x for m in messages if m is not None for x in m.names):
            with system.open_output_stream(f"{root}/{name}.vhdr") as f:
                f.write(f"Brain Vision Data Exchange Header File Version 1.0\n\n[Common Infos]\nDataFile={name}.eeg\nMarkerFile={name}.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels={len(self.channels)}\nSamplingInterval={1e6 / self.rate!r}\nFirstSample={first}\nNoSample={KINDS[kind][1]!r}\nNoValue={KINDS[kind][2]!r}\n\n[Binary Infos]\nBinaryFormat={KINDS[kind][0]}\n\n[Channel Infos]\n{lines}".encode())

    def abort(self, messages: list[Pieces | None]) -> None:
        self._away([x for m in messages if m is not None for x in m.names])


class RecordingPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_pieces"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PieceWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (Recordings, RecordingMarkers, RecordingPieces):
        spark.dataSource.register(source)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Samples and markers of the recordings at or below a path."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return tuple(spark.read.format(f).options(split=split, pushdown=pushdown).load(path) for f in ("recordings", "recording_markers"))


def write(df: DataFrame, path: str, rate: float, pieces: int | None = None, resolution: float = 0.1, gap: int = 10_000) -> None:
    """df(t, marker, channels..) as pieces of a recording, each a range of t; equal times go to one piece."""
    register(df.sparkSession)
    dealt = df.repartitionByRange(*([pieces] if pieces else []), "t").sortWithinPartitions("t", F.col("marker").asc_nulls_last())
    dealt.write.format("recording_pieces").mode("append").options(rate=rate, resolution=resolution, gap=gap).save(path)
