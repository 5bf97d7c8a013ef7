"""Python data sources for binary genotype files, "genloom.bed" and "genloom.bgen", and block compression.

A file is split into ranges of variants, one input partition each, so a scan runs on all executors; sample and variant
lists given as options are applied inside the reader, before any row is made. Paths are local or URIs of shared storage.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from genloom.runtime import released, small_batches
from genloom.sources import store

MAGIC = b"\x6c\x1b\x01"
#: Copies of the first allele by two-bit code; 1 is missing.
_COPIES = np.array([2, -1, 1, 0], np.int8)
#: The codes of 0, 1 and 2 copies and of a missing value.
_CODES = np.array([3, 2, 0, 1], np.uint8)


@dataclass
class Range(InputPartition):
    start: int
    end: int
    ids: tuple = ()
    offsets: tuple = ()


def _chosen(options, name: str) -> set[str] | None:
    return set(options[name].split(",")) if options.get(name) else None


class BedSource(DataSource):
    """Genotypes (snp_idx, snp_id, dosages): copies of the first allele a sample, null if missing. Options: path (without
    extension), variants and samples (comma-joined ids), chunk (variants a partition)."""

    @classmethod
    def name(cls):
        return "genloom.bed"

    def schema(self):
        return "snp_idx bigint, snp_id string, dosages array<int>"

    def reader(self, schema):
        return BedReader(self.options)

    def writer(self, schema, overwrite):
        return BedWriter(self.options)


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk", 1024))
        self.variants, self.samples = _chosen(options, "variants"), _chosen(options, "samples")

    def _ids(self, ext: str, field: int) -> list[str]:
        return [line.split()[field] for line in store.lines(f"{self.path}.{ext}") if line.strip()]

    def partitions(self):
        """A range carries the ids of its variants, so no task reads the others'; ranges without a chosen variant are left out."""
        ids = self._ids("bim", 1)
        ranges = [Range(i, min(len(ids), i + self.chunk), tuple(ids[i : i + self.chunk])) for i in range(0, len(ids), self.chunk)]
        return [r for r in ranges if self.variants is None or not self.variants.isdisjoint(r.ids)] or [Range(0, 0)]

    def read(self, part):
        people = self._ids("fam", 1)
        pick = [i for i, s in enumerate(people) if self.samples is None or s in self.samples]
        width = -(-len(people) // 4)
        with store.reader(f"{self.path}.bed") as f:
            if f.read(3) != MAGIC:
                raise ValueError("no variant-major bed file")
            f.seek(3 + part.start * width)
            for i, snp in enumerate(part.ids):
                raw = np.frombuffer(f.read(width), np.uint8)
                if self.variants is None or snp in self.variants:
                    codes = (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()
                    d = _COPIES[codes[: len(people)]][pick].astype(np.int32)
                    yield _row(["snp_idx", "snp_id"], [part.start + i, snp], "dosages", pa.array(d, mask=d < 0))


def _row(names: list[str], values: list, last: str, array: pa.Array) -> pa.RecordBatch:
    """A batch of one variant: its plain values and one array of all samples."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
    return pa.RecordBatch.from_arrays([*[pa.array([v]) for v in values], whole], names=[*names, last])


@dataclass
class Written(WriterCommitMessage):
    path: str
    first: int
    count: int
    width: int


class PieceWriter(DataSourceArrowWriter):
    """Each task writes a piece; the commit joins pieces in order of their first variant. Input must be range-sorted by
    snp_idx; path must be on storage that driver and tasks share. A task that is run again writes a piece of its own."""

    def __init__(self, options):
        self.path, self.options = options["path"], options

    def pack(self, row: pa.RecordBatch) -> bytes:
        """A variant's bytes; row is one row, whose arrays are never made Python objects a sample."""
        raise NotImplementedError

    def finish(self, pieces: list[Written]) -> None:
        raise NotImplementedError

    def write(self, batches):
        name, first, n, width = f"{self.path}.parts/{uuid.uuid4().hex}", -1, 0, 0
        with store.writer(name) as f:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1)
                    first = r.column("snp_idx")[0].as_py() if first < 0 else first
                    n, width = n + 1, len(r.columns[-1][0])
                    f.write(self.pack(r))
        return Written(name, first, n, width)

    def commit(self, messages):
        self.finish(sorted((m for m in messages if m and m.first >= 0), key=lambda m: m.first))
        store.delete_folder(f"{self.path}.parts")

    def abort(self, messages):
        store.delete_folder(f"{self.path}.parts")


class BedWriter(PieceWriter):
    def pack(self, row):
        copies = row.column("dosages")[0].values.fill_null(3).to_numpy()
        if copies.size and not 0 <= copies.min() <= copies.max() <= 3:
            raise ValueError("dosages are 0, 1, 2 or null")
        codes = np.pad(_CODES[copies], (0, -len(copies) % 4)).reshape(-1, 4)
        return (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()

    def finish(self, pieces):
        store.joined(f"{self.path}.bed", MAGIC, [m.path for m in pieces])


class BgenSource(DataSource):
    """Probabilities (snp_idx, snp_id, chrom, bp, alleles, phased, probs) of layout 2 files: an array of probabilities for
    each sample, null if missing. Options: path, variants, samples (of the file's sample block), chunk. Writing takes rows
    of the same schema with options path, samples (comma-joined names), bits (8) and codec ("zlib", "zstd" or "")."""

    @classmethod
    def name(cls):
        return "genloom.bgen"

    def schema(self):
        return "snp_idx bigint, snp_id string, chrom string, bp bigint, alleles array<string>, phased boolean, probs array<array<double>>"

    def reader(self, schema):
        return BgenReader(self.options)

    def writer(self, schema, overwrite):
        return BgenWriter(self.options)


def _u(f, n: int) -> int:
    return int.from_bytes(f.read(n), "little")


class BgenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk", 256))
        self.variants, self.samples = _chosen(options, "variants"), _chosen(options, "samples")

    def _header(self, f):
        offset, size, m, n = struct.unpack("<IIII", f.read(16))
        if f.read(4) not in (b"bgen", b"\0\0\0\0"):
            raise ValueError("no bgen file")
        f.seek(4 + size - 4)
        flags = _u(f, 4)
        if flags >> 2 & 15 != 2:
            raise ValueError("only layout 2 is read")
        names = None
        if flags >> 31:
            _u(f, 4)
            names = [f.read(_u(f, 2)).decode() for _ in range(_u(f, 4))]
        return offset + 4, m, n, flags & 3, names

    @staticmethod
    def _variant(f):
        f.read(_u(f, 2))
        rsid, chrom = f.read(_u(f, 2)).decode(), f.read(_u(f, 2)).decode()
        bp, k = _u(f, 4), _u(f, 2)
        return rsid, chrom, bp, [f.read(_u(f, 4)).decode() for _ in range(k)]

    def partitions(self):
        """Variants have no fixed size: the plan walks their heads, skipping the data, to find where each starts."""
        with store.reader(self.path) as f:
            at, m, *_ = self._header(f)
            f.seek(at)
            offsets = []
            for _ in range(m):
                offsets.append(f.tell())
                self._variant(f)
                f.seek(_u(f, 4), 1)
        return [Range(i, min(m, i + self.chunk), (), tuple(offsets[i : i + self.chunk])) for i in range(0, m, self.chunk)] or [Range(0, 0)]

    def read(self, part):
        with store.reader(self.path) as f:
            _, _, n, packed, names = self._header(f)
            pick = [i for i in range(n) if self.samples is None or (names and names[i] in self.samples)]
            for i, at in enumerate(part.offsets):
                f.seek(at)
                rsid, chrom, bp, alleles = self._variant(f)
                if self.variants is not None and rsid not in self.variants:
                    continue
                size = _u(f, 4)
                data = f.read(size) if not packed else f.read(4) and f.read(size - 4)
                data = zlib.decompress(data) if packed == 1 else zstandard.ZstdDecompressor().decompressobj().decompress(data) if packed == 2 else data
                phased, probs = probabilities(data, pick)
                yield _row(["snp_idx", "snp_id", "chrom", "bp", "alleles", "phased"], [part.start + i, rsid, chrom, bp, alleles, phased], "probs", probs)


class BgenWriter(PieceWriter):
    """Diploid layout 2 blocks; the probability that the others imply is left out, and missing samples have zeros."""

    def __init__(self, options):
        super().__init__(options)
        self.bits, self.codec = int(options.get("bits", 8)), options.get("codec", "zlib")

    def pack(self, row):
        def text(s, n=2):
            return len(s.encode()).to_bytes(n, "little") + s.encode()

        snp, chrom, bp, alleles, phased = (row.column(c)[0].as_py() for c in ("snp_id", "chrom", "bp", "alleles", "phased"))
        head = text("") + text(snp) + text(chrom) + struct.pack("<IH", bp, len(alleles)) + b"".join(text(a, 4) for a in alleles)
        k, top, probs = len(alleles), 2**self.bits - 1, row.column("probs")[0].values
        missing = probs.is_null().to_numpy(zero_copy_only=False)
        p = probs.flatten().to_numpy(zero_copy_only=False).reshape(int((~missing).sum()), 2 * k if phased else k * (k + 1) // 2)
        p = p.reshape(-1, 2, k)[:, :, :-1].reshape(len(p), -1) if phased else p[:, :-1]
        stored = np.zeros((len(probs), p.shape[1]), np.uint64)
        stored[~missing] = np.rint(p * top)
        flat = stored.astype(f"<u{self.bits // 8}").tobytes() if self.bits in (8, 16, 32) else np.packbits((stored.ravel()[:, None] >> np.arange(self.bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ploidy = np.where(missing, 130, 2).astype(np.uint8).tobytes()
        data = struct.pack("<IHBB", len(probs), k, 2, 2) + ploidy + bytes([int(phased), self.bits]) + flat
        if not self.codec:
            return head + struct.pack("<I", len(data)) + data
        body = zlib.compress(data) if self.codec == "zlib" else zstandard.ZstdCompressor().compress(data)
        return head + struct.pack("<II", len(body) + 4, len(data)) + body

    def finish(self, pieces):
        names = [n.encode() for n in self.options.get("samples", "").split(",") if n]
        block = struct.pack("<I", len(names)) + b"".join(struct.pack("<H", len(n)) + n for n in names)
        block = struct.pack("<I", len(block) + 4) + block if names else b""
        n = max((m.width for m in pieces), default=len(names))
        flags = {"": 0, "zlib": 1, "zstd": 2}[self.codec] | 2 << 2 | (1 << 31 if names else 0)
        head = struct.pack("<III4sI", 20, sum(m.count for m in pieces), n, b"bgen", flags)
        store.joined(self.path, struct.pack("<I", len(head) + len(block)) + head + block, [m.path for m in pieces])


def probabilities(data: bytes, pick: list[int]) -> tuple[bool, pa.Array]:
    """(phased, probabilities of each picked sample) of a layout 2 block, the implied last probability included."""
    from math import comb

    n, k = struct.unpack_from("<IH", data)
    ploidy = np.frombuffer(data, np.uint8, n, 8)
    phased, bits = data[8 + n] == 1, data[9 + n]
    if bits in (8, 16, 32):
        whole = np.frombuffer(data[: 10 + n + (len(data) - 10 - n) // (bits // 8) * (bits // 8)], f"<u{bits // 8}", offset=10 + n)
    else:
        flat = np.unpackbits(np.frombuffer(data, np.uint8, offset=10 + n), bitorder="little")
        whole = flat[: len(flat) // bits * bits].reshape(-1, bits).astype(np.float64) @ (2.0 ** np.arange(bits))
    of = ploidy & 63
    per = [int(p) * (k - 1) if phased else comb(int(p) + k - 1, k - 1) - 1 for p in range(int(of.max(initial=0)) + 1)]  # stored values
    rows = [int(p) if phased else 1 for p in range(len(per))]  # of which each has a sum of 1
    first = np.concatenate(([0], np.cumsum(np.array(per)[of])))
    pick = np.asarray(pick, np.int64)
    some, missing = of[pick], ploidy[pick] & 128 > 0
    size = np.where(missing, 0, np.array([a + b for a, b in zip(per, rows)])[some])
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(ends[-1])
    for p in np.unique(some[~missing]).tolist():
        at = np.flatnonzero(~missing & (some == p))
        width = per[p] // rows[p] if rows[p] else 0
        v = whole[first[pick[at], None] + np.arange(per[p])].reshape(len(at), rows[p], width) / (2**bits - 1)
        full = np.concatenate([v, 1 - v.sum(axis=2, keepdims=True)], axis=2).reshape(len(at), -1)
        out[ends[at, None] + np.arange(full.shape[1])] = full
    offsets = pa.array(ends.astype(np.int32))
    return phased, pa.ListArray.from_arrays(offsets, pa.array(out), mask=pa.array(missing))


def register(spark: SparkSession) -> None:
    small_batches(spark)
    for source in (BedSource, BgenSource):
        spark.dataSource.register(source)


def compressed(block: Column, codec: str = "zstd", level: int = 3, offset: int = 0) -> Column:
    """Raw zlib or zstandard blocks after offset zero bytes; for tables, the Parquet codec does this."""

    @released
    def pack(all_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = (lambda b: zlib.compress(b, level)) if codec == "zlib" else zstandard.ZstdCompressor(level=level).compress
        for blocks in all_:
            yield blocks.map(lambda b: None if b is None else bytes(offset) + one(b))

    return F.pandas_udf(pack, "binary", F.PandasUDFType.SCALAR_ITER)(block)


def decompressed(block: Column, codec: str = "zstd", offset: int = 0) -> Column:
    """What compressed() packed."""

    @released
    def unpack(all_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = zlib.decompress if codec == "zlib" else zstandard.ZstdDecompressor().decompress
        for blocks in all_:
            yield blocks.map(lambda b: None if b is None else one(memoryview(b)[offset:]))

    return F.pandas_udf(unpack, "binary", F.PandasUDFType.SCALAR_ITER)(block)
