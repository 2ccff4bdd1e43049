"""The header of recordings in the European Data Format: fixed-width text. Samples are read by ``recordings``, a range of
records as a task: channels slower than the fastest are repeated by their integer factor, and the annotations of EDF+ files
become markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Width of each field of a channel's header, in their order.
FIELDS = [("label", 16), ("transducer", 80), ("dimension", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32)]
ANNOTATIONS = "EDF Annotations"


def header(raw: bytes) -> dict:
    """Number of records, seconds of each, and the channels' fields."""
    n = int(raw[252:256])
    out, at = {"bytes": int(raw[184:192]), "records": int(raw[236:244]), "seconds": float(raw[244:252])}, 256
    for name, width in FIELDS:
        out[name] = [raw[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
        at += n * width
    out["samples"] = [int(x) for x in out["samples"]]
    return out


def read_edf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stream, t, channel, value) and (stream, seconds, marker) of all recordings below a path; a stream is a file."""
    from sigmill.sources import recordings

    samples, markers = recordings.read(spark, path)
    return samples, markers.select("stream", "seconds", "marker")
