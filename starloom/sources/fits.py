"""FITS files as tables, from any store that Spark reads: files come as binary rows and are parsed where they lie.
``fits_scan`` reads images by ranges instead.

Headers are 80-byte cards in blocks of 2880 bytes; data are big-endian with BSCALE and BZERO. Gzip files are expanded
in the task. Non-finite values become null. A file is one task's work, as its compression allows no other.
"""

from __future__ import annotations

import gzip
import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

BLOCK, CARD = 2880, 80
#: Fixed values of the format: BITPIX to the type on disk.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while end < len(text):
            if text[end] == "'":
                if text[end + 1 : end + 2] != "'":
                    break
                end += 1
            end += 1
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def units(data: bytes) -> Iterator[tuple[dict, int, int]]:
    """(header, offset and size of the data) of every header-data unit."""
    at = 0
    while at + BLOCK <= len(data):
        start = at
        while not any(data[i : i + 8].rstrip() == b"END" for i in range(at, at + BLOCK, CARD)):
            at += BLOCK
            if at + BLOCK > len(data):
                raise ValueError("a header ends early")
        at += BLOCK
        header, size = _header(data[start:at])
        if at + size > len(data):
            raise ValueError("the data end early")
        yield header, at, size
        at += -(-size // BLOCK) * BLOCK


def image(data: bytes, name: str | None = None) -> tuple[dict, np.ndarray]:
    """Header and array (plane, y, x) of the image named ``name``, or of the first one."""
    for header, at, size in units(data):
        if not size or header.get("XTENSION", "IMAGE") != "IMAGE" or (name and header.get("EXTNAME") != name):
            continue
        axes = [header[f"NAXIS{i + 1}"] for i in range(header["NAXIS"])][::-1]
        raw = np.frombuffer(data, TYPES[header["BITPIX"]], math.prod(axes), at)
        scale, zero = header.get("BSCALE", 1), header.get("BZERO", 0)
        values = raw.astype(raw.dtype.newbyteorder("=")) if (scale, zero) == (1, 0) else raw.astype(np.float64) * scale + zero
        return header, values.reshape(-1, *axes[-2:])
    raise ValueError(f"no image {name or ''}")


def _content(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def first_headers(data: bytes, name: str | None = None) -> Iterator[dict]:
    """Headers up to the first image (or the one of that name): a gzip file is expanded no further than that."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while block := stream.read(BLOCK):
        cards = block
        while not any(cards[i : i + 8].rstrip() == b"END" for i in range(len(cards) - BLOCK, len(cards), CARD)):
            more = stream.read(BLOCK)
            if len(more) < BLOCK:
                raise ValueError("a header ends early")
            cards += more
        header, size = _header(cards)
        yield header
        if size and header.get("XTENSION", "IMAGE") == "IMAGE" and name in (None, header.get("EXTNAME")):
            return
        stream.seek(-(-size // BLOCK) * BLOCK, io.SEEK_CUR)


def _header(cards: bytes) -> tuple[dict, int]:
    """The keys of a header and the bytes of the data behind it."""
    header: dict = {}
    for i in range(0, len(cards), CARD):
        card = cards[i : i + CARD].decode("ascii", "replace")
        if card[8:10] == "= ":
            header.setdefault(card[:8].strip(), parse_value(card[10:]))
    axes = [header[f"NAXIS{i + 1}"] for i in range(header.get("NAXIS", 0))]
    count = math.prod(axes) if axes else 0
    return header, (count * abs(header.get("BITPIX", 8)) // 8 + header.get("PCOUNT", 0)) * header.get("GCOUNT", 1) if count else 0


#: Fixed values of the format: column types of binary tables and what one element is on disk.
COLUMNS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16"}


def _form(text: str) -> tuple[int, str, str]:
    """repeat, type and what follows (the type of a variable array's elements) of a TFORM."""
    form = re.fullmatch(r"\s*(\d*)([A-Z])(\S*).*", text)
    if not form:
        raise ValueError(f"column format {text!r}")
    return int(form[1] or 1), form[2], form[3]


def _elements(raw: np.ndarray, kind: str, header: dict, i: int) -> np.ndarray:
    """The last axis of bytes as values: truth as booleans, scaled numbers as doubles, complex numbers as pairs, bits one by one."""
    if kind == "X":
        return np.unpackbits(raw, axis=-1).astype(bool)
    values = np.ascontiguousarray(raw).view(COLUMNS[kind])
    if kind == "L":
        return values == b"T"
    if kind in "CM":
        return np.stack([values.real, values.imag], axis=-1)
    if f"TSCAL{i}" in header or f"TZERO{i}" in header:
        return values * float(header.get(f"TSCAL{i}", 1)) + header.get(f"TZERO{i}", 0)
    return values


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("ascii").rstrip()


def _bytes_of(repeat: int, kind: str) -> int:
    """What a cell takes in its row; bits fill whole bytes, variable arrays leave two numbers."""
    sizes = {"A": repeat, "X": -(-repeat // 8), "P": 8 * repeat, "Q": 16 * repeat}
    return sizes[kind] if kind in sizes else repeat * np.dtype(COLUMNS[kind]).itemsize


def _shaped(values: np.ndarray, shape: list[int]) -> list:
    return values.reshape(len(values), *shape, *values.shape[2:]).tolist()


def _variable(cell: np.ndarray, kind: str, element: str, heap: bytes, header: dict, i: int) -> list:
    """Arrays of the heap that descriptors (number of elements, offset) name."""
    out = []
    for count, start in cell.view(">i4" if kind == "P" else ">i8").tolist():
        size = _bytes_of(count, element)
        if start < 0 or start + size > len(heap):
            raise ValueError(f"column {i} leaves the heap")
        raw = np.frombuffer(heap, np.uint8, size, start)
        out.append(_text(raw.tobytes()) if element == "A" else _elements(raw, element, header, i)[:count].tolist())
    return out


def binary_table(data: bytes, name: str) -> dict[str, list]:
    """Columns of the binary table ``name``: numbers, truth values, strings, or lists: nested as TDIM says, of any length where they lie in the heap."""
    for header, at, size in units(data):
        if header.get("XTENSION") != "BINTABLE" or header.get("EXTNAME") != name:
            continue
        width, rows = header["NAXIS1"], header["NAXIS2"]
        raw = np.frombuffer(data, np.uint8, width * rows, at).reshape(rows, width)
        heap = data[at + header.get("THEAP", width * rows) : at + size]
        out, start = {}, 0
        for i in range(1, header["TFIELDS"] + 1):
            repeat, kind, rest = _form(header[f"TFORM{i}"])
            cell = np.ascontiguousarray(raw[:, start : start + _bytes_of(repeat, kind)])
            start += cell.shape[1]
            shape = [int(n) for n in re.findall(r"\d+", str(header.get(f"TDIM{i}", "")))][::-1]
            if kind in "PQ":
                values = _variable(cell, kind, rest[:1], heap, header, i) if repeat else [None] * rows
            elif kind == "A":
                values = [_text(c.tobytes()) for c in cell] if len(shape) < 2 else [[_text(p.tobytes()) for p in c.reshape(-1, shape[-1])] for c in cell]
            else:
                numbers = _elements(cell, kind, header, i)[:, :repeat]
                if shape and math.prod(shape) != repeat:
                    raise ValueError(f"column {i}: {shape} isn't {repeat}")
                values = _shaped(numbers, shape) if shape else numbers[:, 0].tolist() if repeat == 1 else numbers.tolist()
            out[str(header.get(f"TTYPE{i}", f"col{i}")).strip()] = values
        return out
    raise ValueError(f"no table {name}")


def read_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """path and the columns of ``schema`` of the binary table ``name`` in each file; array columns stay arrays."""
    wanted = spark.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame.path, frame.content, strict=True):
                found = binary_table(_content(content), name)
                yield pd.DataFrame({"path": p, **{c: found[c] for c in wanted}})

    files = reachable(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {schema}")


#: Header keys that the files of one cube must share: the grid and its world system.
GRID_KEYS = ("NAXIS1", "NAXIS2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "CTYPE1", "CTYPE2")


def read_cube(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """channel (from 1, through all files in order of their paths), y, x, value; files of different grids are refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame.path, frame.content, strict=True):
                *_, h = first_headers(content, name)
                yield pd.DataFrame([[p, h.get("NAXIS3", 1), repr([h.get(k) for k in GRID_KEYS])]], columns=["path", "planes", "grid"])

    files = reachable(spark).read.format("binaryFile").load(path).select("path", "content")
    layout = files.mapInPandas(run, "path string, planes int, grid string").collect()  # a row for each file of one cube
    if len({r.grid for r in layout}) > 1:
        raise ValueError("the files have different grids")
    first, rows = 1, []
    for r in sorted(layout, key=lambda r: r.path):
        rows.append((r.path, first))
        first += r.planes
    offsets = spark.createDataFrame(rows, "path string, first int")
    pixels = read_pixels(spark, path, name).join(F.broadcast(offsets), "path")
    return pixels.select((F.col("first") + F.col("plane")).alias("channel"), "y", "x", "value")


def read_headers(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """path, unit, and the header of each unit as a map of strings; of the units up to the first image only unless ``whole``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame.path, frame.content, strict=True):
                rows = [(p, i, {k: str(v) for k, v in h.items()}) for i, h in enumerate(first_headers(content, "" if whole else None))]
                yield pd.DataFrame(rows, columns=["path", "unit", "header"])

    files = reachable(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, unit int, header map<string,string>")


def read_pixels(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """path, plane, y, x, value of all pixels of the named images, row bands at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, cube = image(_content(content), name)
                planes, height, width = cube.shape
                band = max(1, (1 << 18) // width)
                for k in range(planes):
                    for y in range(0, height, band):
                        part = cube[k, y : y + band].astype(np.float64)
                        yy, xx = np.mgrid[y : y + len(part), 0:width]
                        v = pa.array(part.ravel(), mask=~np.isfinite(part.ravel()))
                        n = part.size
                        cols = [pa.array([p] * n), pa.array(np.full(n, k, np.int32)), pa.array(yy.ravel().astype(np.int32)), pa.array(xx.ravel().astype(np.int32)), v]
                        yield pa.RecordBatch.from_arrays(cols, names=["path", "plane", "y", "x", "value"])

    files = reachable(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, plane int, y int, x int, value double")


def card(key: str, value) -> str:
    """One header card; long strings are cut at the card's end, as the format has no longer ones."""
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        quoted = value.replace("'", "''")[:67]
        text = "'" + (quoted[:-1] if quoted.count("'") % 2 else quoted).ljust(8) + "'"
    elif isinstance(value, int):
        text = f"{value:>20}"
    else:
        text = f"{float(value):>20.13G}" if math.isfinite(value) else ""
    return f"{key:8}= {text}".ljust(CARD)


#: Names of a world system's numbers and the header keys that hold them.
WORLD = {"crval1": "CRVAL1", "crval2": "CRVAL2", "crpix1": "CRPIX1", "crpix2": "CRPIX2", "cd11": "CD1_1", "cd12": "CD1_2", "cd21": "CD2_1", "cd22": "CD2_2"}


def _cards(height: int, width: int, wcs: dict | None, more: dict) -> bytes:
    values = {"SIMPLE": True, "BITPIX": -32, "NAXIS": 2, "NAXIS1": width, "NAXIS2": height}
    if wcs:
        values |= {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CUNIT1": "deg", "CUNIT2": "deg"} | {WORLD[k]: float(wcs[k]) for k in WORLD}
    values |= {k.upper()[:8]: v for k, v in more.items() if v is not None and k.upper()[:8] not in values}
    head = "".join([*[card(k, v) for k, v in values.items()], "END".ljust(CARD)]).encode("ascii", "replace")
    return head.ljust(-(-len(head) // BLOCK) * BLOCK)


def to_fits(pixels: DataFrame, keys: list[str], height: int, width: int, wcs: dict | None = None, metadata: list[str] | None = None) -> DataFrame:
    """keys, content: a FITS file of 32-bit floats for each grid of ``pixels`` (keys, y, x, value); missing pixels are NaN.

    The header has the world system ``wcs`` and the grid's values of the ``metadata`` columns. A grid is one file and one task's work: pixels
    arrive as sorted bands of rows, so the task holds the file and a batch.
    """
    named = list(metadata or [])

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.full((height, width), np.nan, ">f4")
        more: dict = {}
        for frame in frames:
            values[frame.y.to_numpy(), frame.x.to_numpy()] = frame.value.to_numpy(dtype=np.float64, na_value=np.nan)
            if not more and len(frame):
                more = {c: v.item() if hasattr(v, "item") else v for c, v in frame[named].iloc[0].items() if v is not None and v == v}
        body = values.tobytes()
        yield pd.DataFrame([[*key, _cards(height, width, wcs, more) + body + bytes(-len(body) % BLOCK)]], columns=[*keys, "content"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.select(*keys).schema) + ", content binary"
    return pixels.select(*keys, "y", "x", F.col("value").cast("double"), *named).groupBy(*keys).applyInPandas(run, schema)
