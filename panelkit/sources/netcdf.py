"""Gridded variables of classic NetCDF files as a Spark data source: each task reads a slab of days by its bytes.

spark.dataSource.register(NetcdfSource)
spark.read.format("netcdf_grid").option("variable", "RAINFALL").load(folder)

The driver lists names and sizes only. A task reads the header of its file (a few kilobytes, whatever the file's size),
works out which days are its share, and reads their bytes, a few days at a time. The formats are the classic one, its
64-bit offsets and its 64-bit data (CDF-1, CDF-2, CDF-5).
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import Opened, found

# The external types of the format.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
SCHEMA = "year int, day int, lat_idx int, lon_idx int, value double"


@dataclass
class Variable:
    dims: list[int]
    kind: int
    size: int
    begin: int
    attributes: dict[str, object] = field(default_factory=dict)


class Header:
    """Dimensions, variables and the number of records of an opened file. ValueError where it is no classic NetCDF file."""

    def __init__(self, file: Opened, first: int = 1 << 16) -> None:
        self.file, self.at, self.held = file, 0, file.read(0, min(first, file.size))
        if self.held[:3] != b"CDF" or self.held[3:4] not in (b"\1", b"\2", b"\5"):
            raise ValueError("not a classic NetCDF file")
        self.at, version = 4, self.held[3]
        self.count = ">q" if version == 5 else ">i"
        self.offset = ">i" if version == 1 else ">q"
        records = self._number(self.count)
        self.lengths = [(self._name(), self._number(self.count)) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._number(self.count) for _ in range(self._number(self.count))]
            attributes = self._attributes()
            self.variables[name] = Variable(dims, self._number(">i"), self._number(self.count), self._number(self.offset), attributes)
        of_records = [v for v in self.variables.values() if v.dims and self.lengths[v.dims[0]][1] == 0]
        one = len(of_records) == 1  # a single record variable is not padded
        self.record = sum(self._bytes(v, v.dims[1:], pad=not one) for v in of_records)
        if records < 0 and of_records:  # written as a stream: as many as there are bytes for
            records = (file.size - min(v.begin for v in of_records)) // self.record
        self.records = max(records, 0)

    def _take(self, n: int) -> bytes:
        while self.at + n > len(self.held):
            more = min(max(len(self.held), n), self.file.size - len(self.held))
            if more <= 0:
                raise ValueError("the header is cut off")
            self.held += self.file.read(len(self.held), more)
        self.at += n
        return self.held[self.at - n : self.at]

    def _number(self, kind: str) -> int:
        return struct.unpack(kind, self._take(struct.calcsize(kind)))[0]

    def _padded(self, n: int) -> bytes:
        if n < 0:
            raise ValueError("a negative length")
        return self._take(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._number(self.count)).decode("utf-8", "replace")

    def _list(self, tag: int) -> int:
        have, n = self._number(">i"), self._number(self.count)
        if have not in (tag, 0) or (have == 0 and n):
            raise ValueError("a list of another kind")
        return n

    def _attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), self._number(">i"), self._number(self.count)
            data = self._padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = data.decode("utf-8", "replace") if kind == 2 else np.frombuffer(data, TYPES[kind]).tolist()
        return out

    def _bytes(self, v: Variable, dims: list[int], pad: bool) -> int:
        n = math.prod(self.lengths[d][1] for d in dims) * np.dtype(TYPES[v.kind]).itemsize
        return -(-n // 4) * 4 if pad else n

    def days(self, v: Variable) -> int:
        return self.lengths[v.dims[0]][1] or self.records

    def shape(self, v: Variable) -> tuple[int, int]:
        return self.lengths[v.dims[1]][1], self.lengths[v.dims[2]][1]

    def step(self, v: Variable) -> int:
        """Bytes from a day's begin to the next one's."""
        return self.record if self.lengths[v.dims[0]][1] == 0 else self._bytes(v, v.dims[1:], pad=False)


def values(raw: bytes, v: Variable) -> np.ndarray:
    """Numbers of a variable's bytes by its own attributes: fill values missing (NaN), then scale and offset."""
    stored = np.frombuffer(raw, dtype=TYPES[v.kind])
    out = stored.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        for x in v.attributes.get(name) or []:
            out[stored == np.array(x).astype(stored.dtype)] = np.nan
    for name, apply in (("scale_factor", np.multiply), ("add_offset", np.add)):
        if v.attributes.get(name):
            out = apply(out, v.attributes[name][0])
    return out


@dataclass
class Slab(InputPartition):
    path: str
    part: int
    parts: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.part, self.parts))


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.root, self.variable = low["path"], low.get("variable", "RAINFALL")
        self.missing = float(low.get("missingupto", "-998"))
        self.slab = int(low.get("slabbytes", str(16 << 20)))
        self.strict = low.get("mode", "skip").lower() == "fail"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in found(self.root, "*.nc"):
            parts = max(1, -(-size // self.slab))
            out += [Slab(path, i, parts) for i in range(parts)]
        return out or [Slab("", 0, 1)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        year = re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", slab.path.rsplit("/", 1)[-1])
        if not year:
            return
        try:
            with Opened(slab.path) as file:
                header = Header(file)
                v = header.variables.get(self.variable)
                if v is None or len(v.dims) != 3:
                    raise ValueError(f"no variable {self.variable} of three dimensions")
                days, (rows, columns), step = header.days(v), header.shape(v), header.step(v)
                day = rows * columns * np.dtype(TYPES[v.kind]).itemsize
                if days and v.begin + (days - 1) * step + day > file.size:
                    raise ValueError("the data are cut off")  # a file counts as a whole or not at all, in every slab
                for d in range(days * slab.part // slab.parts, days * (slab.part + 1) // slab.parts):
                    x = values(file.read(v.begin + d * step, day), v).reshape(rows, columns)
                    lat, lon = np.nonzero(x > self.missing)
                    n = len(lat)
                    arrays = [np.full(n, int(year[0]), np.int32), np.full(n, d + 1, np.int32), lat.astype(np.int32), lon.astype(np.int32), x[lat, lon]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["year", "day", "lat_idx", "lon_idx", "value"])
        except (ValueError, EOFError, KeyError, IndexError, struct.error, OSError):
            if self.strict:
                raise


class NetcdfSource(DataSource):
    """options: path, variable (RAINFALL), missingUpTo (-998: values up to it are missing), slabBytes (16 MB a task), mode (skip or fail)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return GridReader(dict(self.options))


def read_rain(spark: SparkSession, root: str, variable: str = "RAINFALL", missing_up_to: float = -998.0, slab_bytes: int = 16 << 20, strict: bool = False) -> DataFrame:
    """year, day, lat_idx, lon_idx, value of the yearly NetCDF files below root: cells with a value, days from 1, the year from the name.

    Files without a year in their names, of another format, without the variable or cut off are skipped whole (strict: an
    error). A cell is missing if it is NaN, a fill value, or missing_up_to or less.
    """
    spark.dataSource.register(NetcdfSource)
    options = {"variable": variable, "missingUpTo": str(missing_up_to), "slabBytes": str(slab_bytes), "mode": "fail" if strict else "skip"}
    return spark.read.format("netcdf_grid").options(**options).load(root)
