"""FITS images by byte ranges: a Spark data source of planes and row bands, and header scans over lists of keys.

``read_images`` reads only the bytes of the planes and rows that filters on key, plane and y leave: a partition is a run of whole rows of an
uncompressed file. A gzip file is one partition, expanded as far as the last row that is wanted. ``scan_headers`` asks for the first bytes of
each object only, in steps, and gives a row with the error where that fails.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions import sky
from ..session import reachable
from .fits import BLOCK, CARD, TYPES, _header
from .store import Store

#: Bytes of a partition of pixels, of a request while a header is read, and of the first part of an object that is scanned for headers.
BAND, STEP, FIRST = 1 << 25, 4 * BLOCK, 1 << 16
PIXELS = "key string, plane int, y int, x int, value double"


@dataclass(frozen=True)
class Layout:
    """Where an image's pixels lie in its file (after expansion), and what they mean."""

    key: str
    at: int
    planes: int
    height: int
    width: int
    kind: str
    scale: float
    zero: float
    blank: int | None
    packed: bool


def headers(read: Callable[[int, int], bytes], most: int | None = None, step: int = STEP) -> Iterator[tuple[dict, int, int]]:
    """(header, offset and size of its data) of each unit, through ``read(offset, size)``; nothing is read beyond ``most`` bytes, nor any data."""
    held, start = b"", 0

    def block(at: int) -> bytes:
        nonlocal held, start
        if not start <= at <= start + len(held) - BLOCK:
            size = step if most is None else min(step, most - at)
            held, start = read(at, size) if size >= BLOCK else b"", at
        return held[at - start : at - start + BLOCK]

    at = 0
    while len(cards := block(at)) == BLOCK:
        while not any(cards[i : i + 8].rstrip() == b"END" for i in range(len(cards) - BLOCK, len(cards), CARD)):
            more = block(at + len(cards))
            if len(more) < BLOCK:
                raise ValueError(f"no end of a header in the first {at + len(cards) + len(more)} bytes")
            cards += more
        at += len(cards)
        header, size = _header(cards)
        yield header, at, size
        at += -(-size // BLOCK) * BLOCK


def _is_image(header: dict, size: int, hdu: str | None) -> bool:
    return bool(size) and header.get("XTENSION", "IMAGE") == "IMAGE" and hdu in (None, header.get("EXTNAME"))


def layout_of(store: Store, key: str, hdu: str | None) -> Layout:
    """The layout of the image named ``hdu``, or of the first one."""
    packed = store.read(key, 0, 2) == b"\x1f\x8b"
    if packed:
        stream = gzip.GzipFile(fileobj=store.open(key))

        def read(at: int, size: int) -> bytes:
            stream.seek(at)
            return stream.read(size)
    else:

        def read(at: int, size: int) -> bytes:
            return store.read(key, at, size)

    for header, at, size in headers(read):
        if _is_image(header, size, hdu):
            axes = [header[f"NAXIS{i + 1}"] for i in range(header["NAXIS"])] + [1, 1]
            kind = TYPES[header["BITPIX"]]
            return Layout(key, at, math.prod(axes[2:]), axes[1], axes[0], kind, header.get("BSCALE", 1), header.get("BZERO", 0), header.get("BLANK") if "i" in kind or "u" in kind else None, packed)
    raise ValueError(f"{key}: no image {hdu or ''}")


@dataclass
class Run(InputPartition):
    """Rows y0 up to y1 of some planes of a file."""

    layout: Layout
    planes: tuple[int, ...]
    y0: int
    y1: int


def decoded(raw: bytes, lay: Layout) -> np.ndarray:
    found = np.frombuffer(raw, lay.kind)
    values = found.astype(np.float64)
    if lay.blank is not None:
        values[found == lay.blank] = np.nan
    return values if (lay.scale, lay.zero) == (1, 0) else values * lay.scale + lay.zero


def pixels_of(store: Store, run: Run, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The pixels of a run, a bounded number at a time."""
    lay = run.layout
    step = max(1, rows // lay.width)
    line = lay.width * np.dtype(lay.kind).itemsize
    stream = gzip.GzipFile(fileobj=store.open(lay.key)) if lay.packed else None
    for plane in sorted(run.planes):
        for y in range(run.y0, run.y1, step):
            n = min(step, run.y1 - y)
            at = lay.at + (plane * lay.height + y) * line
            if stream:
                stream.seek(at)
                raw = stream.read(n * line)
            else:
                raw = store.read(lay.key, at, n * line)
            if len(raw) < n * line:
                raise ValueError(f"{lay.key}: the data end early")
            values = decoded(raw, lay)
            count = len(values)
            columns = [
                pa.array([lay.key]).take(pa.array(np.zeros(count, np.int32))), pa.array(np.full(count, plane, np.int32)), pa.array(np.repeat(np.arange(y, y + n, dtype=np.int32), lay.width)),
                pa.array(np.tile(np.arange(lay.width, dtype=np.int32), n)), pa.array(values, mask=~np.isfinite(values)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "plane", "y", "x", "value"])


class _Images(DataSource):
    """Options: root, keys (a glob pattern), hdu (a name; else the first image), band (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "starloom_fits"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))


class ImageReader(DataSourceReader):
    """Prunes files by key before their headers are read, then planes and rows before any data are."""

    def __init__(self, options: dict):
        self.root, self.pattern, self.hdu = options["root"], options.get("keys", "*"), options.get("hdu")
        self.band = int(options.get("band", BAND))
        self.keys: set[str] | None = None
        self.among: dict[str, set[int] | None] = {"plane": None, "y": None}
        self.bounds = {"plane": [0, math.inf], "y": [0, math.inf]}
        self.n_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("key", *self.among) and isinstance(f, IsNotNull):
                continue  # none of them is ever null
            if name == "key" and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = found if self.keys is None else self.keys & found
            elif name in self.among and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.among[name] = found if self.among[name] is None else self.among[name] & found
            elif name in self.bounds and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.bounds[name][0] = max(self.bounds[name][0], f.value + isinstance(f, GreaterThan))
            elif name in self.bounds and isinstance(f, LessThan | LessThanOrEqual):
                self.bounds[name][1] = min(self.bounds[name][1], f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def wanted(self, name: str, size: int) -> list[tuple[int, int]]:
        """Runs of places along an axis of ``size`` that the filters leave."""
        low, high = max(0, self.bounds[name][0]), min(size, self.bounds[name][1])
        if self.among[name] is None:
            return [(low, high)] if low < high else []
        runs: list[list[int]] = []
        for v in sorted(v for v in self.among[name] if v is not None and low <= v < high):
            if runs and runs[-1][1] == v:
                runs[-1][1] = v + 1
            else:
                runs.append([v, v + 1])
        return [(a, b) for a, b in runs]

    def partitions(self) -> list[Run]:
        store = Store(self.root)
        keys = store.keys(self.pattern) if self.keys is None else sorted(k for k in self.keys if k is not None and store.size(k) is not None)
        with ThreadPoolExecutor(8) as pool:
            layouts = list(pool.map(lambda k: layout_of(store, k, self.hdu), keys))
        self.n_read += store.n_read
        out = []
        for lay in layouts:
            planes = [k for a, b in self.wanted("plane", lay.planes) for k in range(a, b)]
            for y0, y1 in self.wanted("y", lay.height):
                out += self._cut(lay, planes, y0, y1)
        return out or [Run(None, (), 0, 0)]

    def _cut(self, lay: Layout, planes: list[int], y0: int, y1: int) -> list[Run]:
        if lay.packed:
            return [Run(lay, tuple(planes), y0, y1)] if planes else []
        line = lay.width * np.dtype(lay.kind).itemsize
        if (y1 - y0) * line >= self.band:
            rows = max(1, self.band // line)
            return [Run(lay, (k,), y, min(y1, y + rows)) for k in planes for y in range(y0, y1, rows)]
        many = max(1, self.band // ((y1 - y0) * line))
        return [Run(lay, tuple(planes[i : i + many]), y0, y1) for i in range(0, len(planes), many)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.layout is None:
            return
        store = Store(self.root)
        yield from pixels_of(store, partition)
        self.n_read += store.n_read


def read_images(spark: SparkSession, root: str, keys: str = "*", hdu: str | None = None, band: int = BAND) -> DataFrame:
    """key, plane, y, x, value of the images under ``root`` whose keys match the pattern."""
    spark = reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_Images)
    source = spark.read.format("starloom_fits").option("root", root).option("keys", keys).option("band", band)
    return (source.option("hdu", hdu) if hdu else source).load()


def scan_headers(keys: DataFrame, root: str, hdu: str | None = "IMAGE", most: int = FIRST, tries: int = 3, threads: int = 8) -> DataFrame:
    """key, header (of the unit named ``hdu``, else of the first image; values as strings), n_bytes (asked for), error.

    At most ``most`` bytes of an object are asked for; an object that is missing, too short or something else has an error in place of a header.
    """

    def one(key: str) -> tuple:
        store = Store(root, tries)
        try:
            for header, _, size in headers(lambda at, n: store.read(key, at, n), most):
                if _is_image(header, size, hdu):
                    return key, {k: str(v) for k, v in header.items()}, store.n_read, None
            raise ValueError(f"no image {hdu or ''}")
        except (OSError, ValueError, KeyError) as error:
            return key, None, store.n_read, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(one, frame["key"])), columns=["key", "header", "n_bytes", "error"])

    reachable(keys.sparkSession)
    return keys.select("key").mapInPandas(run, "key string, header map<string,string>, n_bytes bigint, error string")


#: Header keys of a frame and the names of what they say.
FRAME = {"NAXIS1": "width", "NAXIS2": "height", "CRVAL1": "crval1", "CRVAL2": "crval2", "CRPIX1": "crpix1", "CRPIX2": "crpix2", "CD1_1": "cd11", "CD1_2": "cd12", "CD2_1": "cd21", "CD2_2": "cd22", "MJD-OBS": "mjd"}


def frames(scanned: DataFrame, **more: str) -> DataFrame:
    """key, the numbers of FRAME and of ``more`` (name = header key) of the headers that were found, date_obs."""
    names = FRAME | {v: k for k, v in more.items()}
    value = lambda k: F.try_element_at("header", F.lit(k))
    return scanned.where(F.col("header").isNotNull()).select("key", *[value(k).try_cast("double").alias(n) for k, n in names.items()], value("DATE-OBS").alias("date_obs"))


def covering(found: DataFrame, ra: float, dec: float, mjd: float, guard: float = 4.0) -> DataFrame:
    """``found`` frames that show the position, with x, y there and the days between the frame and ``mjd``, nearest first.

    A world system says nothing far from its own centre: frames more than ``guard`` degrees away are left out.
    """
    wcs = {k: F.col(k) for k in ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")}
    x, y = sky.tan_to_pixel(F.lit(float(ra)), F.lit(float(dec)), wcs)
    at = found.withColumns({"x": x, "y": y, "delta_days": F.abs(F.col("mjd") - mjd)})
    near = sky.separation(F.lit(float(ra)), F.lit(float(dec)), F.col("crval1"), F.col("crval2")) <= guard * 3600
    return at.where(sky.in_frame("x", "y", "width", "height") & near).select("key", "date_obs", "mjd", "delta_days", "x", "y", "crval1", "crval2").orderBy("delta_days", "key")
