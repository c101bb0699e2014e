"""Image files as DataFrames through Spark's binaryFile source, so any file system and any number of files will do."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ana, fits

HEADER = "file string, format string, dims array<int>, element string, n_frames int, header string, cards array<string>, error string"
#: pixels after which decoded images go on to the JVM
BATCH_PIXELS = 1 << 19
FRAMES = "file string, format string, frame_in_file int, h int, w int, px array<double>, header string, error string"


def format_by_magic(content: Column) -> Column:
    """ANA, FITS or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 6))
    return F.when(head.startswith("AAAA5555") | head.startswith("5555AAAA"), "ANA").when(head == "53494D504C45", "FITS")


def format_by_name(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("f0", "fz"), "ANA").when(ext.isin("fits", "fit", "fts"), "FITS").when(ext == "momfbd", "MOMFBD")


def file_type(path: Column, content: Column) -> Column:
    """Magic first, then the name; empty if unknown."""
    return F.coalesce(format_by_magic(content), format_by_name(path), F.lit(""))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length: contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def decode(content: bytes) -> tuple[np.ndarray | None, str, str, list[str]]:
    """Pixels, format, header text and cards of a file's bytes."""
    if content[:6] == b"SIMPLE":
        px, cards = fits.decode(content)
        return px, "FITS", "\n".join(c.rstrip() for c in cards), cards
    px, head = ana.decode(content)
    text = head["text"]
    return px, "ANA", text, [text[i : i + 80].ljust(80) for i in range(0, len(text), 80)]


def describe(content: bytes) -> tuple[str, list[int], str | None, str, list[str]]:
    """Format, dimensions, element type, header text and cards of a file's bytes; pixels are not decoded."""
    if content[:6] == b"SIMPLE":
        dims, element, cards = fits.describe(content)
        return "FITS", dims, element, "\n".join(c.rstrip() for c in cards), cards
    dims, element, text = ana.describe(content)
    return "ANA", dims, element, text, [text[i : i + 80].ljust(80) for i in range(0, len(text), 80)]


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file; a file that can't be read has its error instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    kind, dims, element, text, cards = describe(content)
                    rows.append((file, kind, dims, element, dims[0] if len(dims) == 3 else int(bool(dims)), text, cards, None))
                except (ValueError, KeyError) as e:
                    rows.append((file, None, None, None, None, None, None, str(e)))
            types = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in HEADER.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, HEADER)


def decoded(contents: DataFrame, discard: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row for each image of each file (2-D files one, cubes one for each plane), less the first and last ``discard`` planes of cubes.

    contents: path and the bytes of a file, wherever they come from.

    A file that can't be read gives one row with null pixels and its error; nothing stops the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.string()]
        names = [x.split()[0] for x in FRAMES.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            rows, pixels = [], 0
            for file, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    px, kind, text, _ = decode(content)
                    cube = px if px is not None and px.ndim == 3 else None if px is None else px.reshape(1, *px.shape[-2:])
                    n = 0 if cube is None else len(cube)
                    first, last = discard if n > 1 else (0, 0)
                    rows += [(file, kind, i, cube.shape[1], cube.shape[2], cube[i].astype(float).ravel(), text, None) for i in range(first, n - last)]
                    pixels += 0 if cube is None else cube.size
                except (ValueError, KeyError) as e:
                    rows.append((file, None, None, None, None, None, None, str(e)))
                if pixels >= BATCH_PIXELS:
                    if rows:
                        yield made(rows)
                    rows, pixels = [], 0
            if rows:
                yield made(rows)

    return contents.select("path", "content").mapInArrow(run, FRAMES)


def read_frames(spark: SparkSession, path: str, discard: tuple[int, int] = (0, 0)) -> DataFrame:
    """``decoded`` over the files of a path."""
    return decoded(spark.read.format("binaryFile").load(path), discard)


def encoded(frames: DataFrame, kind: str, dtype: str = "float32", low_bits: int | None = None, rice: bool = False) -> DataFrame:
    """The frames (h, w, px, header) with a column ``content``: the bytes of an ANA or FITS file each."""
    def bytes_of(px: np.ndarray | None, h: int, w: int, header: str | None) -> bytes | None:
        if px is None:
            return None
        image = np.asarray(px)
        image = (np.rint(image) if np.dtype(dtype).kind in "iu" else image).astype(dtype).reshape(h, w)
        if kind == "ANA":
            return ana.encode(image, header or "", low_bits)
        return fits.encode(image, [c.ljust(80)[:80] for c in (header or "").split("\n") if c], rice)

    @F.pandas_udf("binary")
    def one(px: pd.Series, h: pd.Series, w: pd.Series, header: pd.Series) -> pd.Series:
        return pd.Series([bytes_of(*row) for row in zip(px, h, w, header, strict=True)], dtype=object)

    return frames.withColumn("content", one("px", "h", "w", "header"))


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Write each row's bytes under a folder that all executors share, by rename, so that a repeated task can't leave half a file."""
    def save(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row[name]}.part")
            with open(part, "wb") as f:
                f.write(row[content])
            os.replace(part, os.path.join(folder, row[name]))

    df.select(name, content).where(F.col(content).isNotNull()).foreachPartition(save)
