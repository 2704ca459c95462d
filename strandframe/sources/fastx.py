"""FASTA and FASTQ as a Spark data source, and writers.

``spark.dataSource.register(FastxSource)`` makes ``spark.read.format("fastx")``
available; ``read_fastx`` does so by itself. Plain files are cut into byte
ranges that begin at a record, so one large file is read by many tasks;
gzipped files are read whole, one task each. Short ranges grow with the files, up
to SPLIT_BYTES, so that tasks stay few. Paths are opened through
pyarrow's file systems.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "header string, sequence string, quality string"
SPLIT_BYTES, BATCH = 64 << 20, 512
#: Beyond so many ranges, besides one of each file, neighbouring ones are read by one task, unless it would get more than SPLIT_BYTES.
MOST_RANGES = 128
SUFFIXES = (".fasta", ".fa", ".fna", ".faa", ".ffn", ".fastq", ".fq")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def list_files(uri: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[tuple[str, int]]:
    """Path and size of a file, or of all files below a folder with such a suffix (or it and .gz) or written by Spark."""
    fs, path = _open(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted((f.path, f.size) for f in found if f.is_file and (f.path.removesuffix(".gz").endswith(suffixes) or f.base_name.startswith("part-")))
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return [(path, info.size)]


@dataclass
class Range(InputPartition):
    uri: str
    path: str
    start: int
    end: int


def is_gzipped(stream) -> bool:
    return stream.read_at(2, 0) == b"\x1f\x8b" if stream.size() > 1 else False


def _fasta(lines: Iterator[bytes]) -> Iterator[tuple[str, str, None]]:
    header, parts = None, []
    for line in lines:
        if line.startswith(b">"):
            if header is not None:
                yield header, b"".join(parts).decode(), None
            header, parts = line[1:].decode(), []
        elif header is not None:
            parts.append(line.strip())
    if header is not None:
        yield header, b"".join(parts).decode(), None


def _fastq(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str]]:
    """Records of a header, sequence lines, a plus line and as many quality characters."""
    header = next(lines, None)
    while header is not None:
        if not header:
            header = next(lines, None)
            continue
        seq, line = b"", next(lines, b"+")
        while not line.startswith(b"+"):
            seq += line.strip()
            line = next(lines, b"+")
        quality = b""
        while len(quality) < len(seq):
            more = next(lines, None)
            if more is None:
                break
            quality += more
        yield header[1:].decode(), seq.decode(), quality.decode()
        header = next(lines, None)


def parse(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str | None]]:
    """Records of FASTA or FASTQ lines, told apart by the first character."""
    first = next((x for x in lines if x.strip()), None)
    if first is None:
        return
    rest = _chain(first, lines)
    yield from _fastq(rest) if first.startswith(b"@") else _fasta(rest)


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _lines(stream, start: int, end: int | None) -> Iterator[bytes]:
    """Lines of the records that begin in [start, end); FASTA only unless the range is all of it."""
    # begin one byte earlier: a record that begins at start follows a line break
    at = max(start - 1, 0)
    stream.seek(at)
    inside, rest, first = start == 0, b"", start > 0
    while True:
        # a range takes what it needs and a little more: the rest of its last record
        chunk = stream.read(1 << 20 if end is None else max(min(1 << 20, end - stream.tell()), 1 << 12))
        block = rest + chunk
        parts = block.split(b"\n")
        rest = parts.pop() if chunk else b""
        for line in parts:
            if first:  # the end of a line that began before
                first = False
            elif line.startswith(b">"):
                if end is not None and at >= end:
                    return
                inside = True
            if inside:
                yield line.rstrip(b"\r")
            at += len(line) + 1
        if not chunk:
            return


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        fs, _ = _open(self.uri)
        files = list_files(self.uri)
        split = max(self.split, min(SPLIT_BYTES, -(-sum(size for _, size in files) // MOST_RANGES)))
        out = []
        for path, size in files:
            with fs.open_input_file(path) as f:
                head = f.read_at(1, 0) if size else b""
                whole = is_gzipped(f) or head != b">"
            step = max(size, 1) if whole else split
            out += [Range(self.uri, path, at, min(at + step, size)) for at in range(0, max(size, 1), step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(partition.uri)
        with fs.open_input_file(partition.path) as f:
            if is_gzipped(f):
                f.seek(0)
                lines = (x.rstrip(b"\r\n") for x in gzip.GzipFile(fileobj=f))
            else:
                lines = _lines(f, partition.start, None if f.read_at(1, 0) != b">" else partition.end)
            rows = []
            for record in parse(lines):
                rows.append(record)
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["header", "sequence", "quality"])


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("splitBytes", split_bytes).load(path)


def load_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig_id, sequence and seq_length (bytes)."""
    return read_fastx(spark, path).select(F.col("header").alias("contig_id"), "sequence", F.octet_length("sequence").cast("long").alias("seq_length"))


def to_fasta(df: DataFrame, header: str, seq: str) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value"))


def to_fastq(df: DataFrame, header: str, seq: str, quality: str) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col(header), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(quality)).alias("value"))


def write_fastx(df: DataFrame, path: str, header: str = "header", seq: str = "sequence", quality: str | None = None, kind: str = "fasta", single: bool = False) -> None:
    """FASTA, FASTQ or tab-separated lines; one file only if asked for."""
    if kind == "tab":
        lines = df.select(F.concat_ws("\t", header, seq).alias("value"))
    else:
        lines = to_fastq(df, header, seq, quality) if quality else to_fasta(df, header, seq)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def matched_regions(hits: DataFrame, name: str, seq: str, start: str, end: str) -> DataFrame:
    """Header and ungapped sequence of each hit's region (1-based, inclusive); empty ones are left out."""
    part = F.translate(F.substr(seq, F.col(start).cast("int"), (F.col(end) - F.col(start) + 1).cast("int")), "-.", "")
    return hits.select(F.concat(F.col(name), F.lit("_"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")).alias("header"), part.alias("sequence")).where("sequence <> ''")
