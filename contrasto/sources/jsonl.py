"""JSON Lines sources and sinks: strict scans with line numbers, zstd files, record accessors, manifests."""

from __future__ import annotations

import fnmatch
import glob
import io
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contrasto.sources.tables import materialize

CORRUPT = "_corrupt_record"
ENDS = (".jsonl", ".jsonl.zstd")
#: Bytes of a plain file that one task reads.
SPLIT_BYTES = 128 << 20


def expand_inputs(values: list[str]) -> list[str]:
    """Files of directories (recursive), globs and names, sorted and distinct; an input without a match is an error.

    A value with a scheme (``hdfs://``, ``s3a://`` and so on) is listed on that file system; others are of this machine or a mounted folder.
    """
    out: set[str] = set()
    for v in values:
        if "://" in v:
            found = _expand_uri(v)
        elif os.path.isdir(v):
            found = [os.path.realpath(p) for end in ENDS for p in glob.glob(os.path.join(v, "**", f"*{end}"), recursive=True)]
        else:
            found = list(map(os.path.realpath, glob.glob(v)))
        if not found:
            raise FileNotFoundError(f"no input matches {v}")
        out.update(found)
    return sorted(out)


def _expand_uri(value: str) -> list[str]:
    scheme, rest = value.split("://", 1)
    bare = re.split(r"[*?\[]", value, maxsplit=1)[0]
    base = value if bare == value else bare.rsplit("/", 1)[0]
    where, name = fs.FileSystem.from_uri(base)
    info = where.get_file_info(name)
    if info.type == fs.FileType.File:
        return [value]
    if info.type == fs.FileType.NotFound:
        return []
    prefix = f"{scheme}://{rest[: len(base) - len(scheme) - 3].removesuffix(name)}"
    found = [x.path for x in where.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File]
    # a star stays within its folder, as in a shell
    fits = (lambda p: p.endswith(ENDS)) if base == value else lambda p: p.count("/") == value.count("/") and fnmatch.fnmatchcase(p, value)
    return [p for p in (prefix + x for x in found) if fits(p)]


def read_lines(spark: SparkSession, paths: list[str] | str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, line, value) of plain and zstd text files; blank lines are left out.

    Plain files are read in splits: a task takes the lines that begin in its range of bytes.  Only files of several splits
    are read twice, first to count the lines of each split, so that every split knows the number of its first line.  A
    zstd file is one task.  Lines stream, so a file of any size needs little memory.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")  # the content column is pruned, tasks open the files
    plain = ~F.col("path").rlike(r"\.zstd?$")
    cut = F.when(plain, F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / split_bytes))).otherwise(F.array(F.lit(0).cast("long")))
    splits = files.select("path", "length", F.explode(cut).alias("k"))
    splits = splits.select("path", (F.col("k") * split_bytes).alias("start"), F.when(plain, F.least((F.col("k") + 1) * split_bytes, F.col("length"))).otherwise(F.col("length")).alias("end"), (plain & (F.col("length") > split_bytes)).alias("several"))
    total = splits.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.max(F.col("several").cast("int")).alias("several")).first()
    # a task takes splits of SPLIT_BYTES in all, however small each is, so that the driver keeps track of few tasks
    tasks = max(1, min(total["n"], max(spark.sparkContext.defaultParallelism, -(-(total["bytes"] or 0) // max(split_bytes, SPLIT_BYTES)))))
    kind = "path string, start long, end long, lines long"
    first = F.lit(0).cast("long").alias("first")
    if not total["several"]:
        return splits.select("path", "start", "end", first).repartition(tasks).mapInArrow(_lines, "file string, line long, value string")
    # one row a split; a file's splits are few beside its lines
    counted = materialize(splits.where("several").repartition(tasks).select("path", "start", "end").mapInArrow(_count, kind), "splits")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.select("path", "start", "end", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("first"))
    return placed.unionByName(splits.where("not several").select("path", "start", "end", first)).repartition(tasks).mapInArrow(_lines, "file string, line long, value string")


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
    return where, name


def _raw_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range of bytes; a range that begins within a line leaves that line to the one before."""
    where, name = _opened(path)
    if name.endswith((".zstd", ".zst")):
        with where.open_input_stream(name, compression=None) as raw:
            yield from _unzipped(raw)
        return
    with where.open_input_file(name) as raw:
        at = max(0, start - 1)
        raw.seek(at)
        text = io.BufferedReader(raw, max(1 << 13, min(1 << 20, end - at)))
        if start:
            at += len(text.readline())
        while at < end and (line := text.readline()):
            at += len(line)
            yield line


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            n = sum(1 for _ in _raw_lines(r["path"], r["start"], r["end"]))
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), *(pa.array([x], pa.int64()) for x in (r["start"], r["end"], n))], names=["path", "start", "end", "lines"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            held: list[tuple[int, str]] = []
            for k, raw in enumerate(_raw_lines(r["path"], r["start"], r["end"]), r["first"] + 1):
                line = raw.decode("utf-8")
                if line.strip():
                    held.append((k, line.rstrip("\r\n")))
                if len(held) >= 2000:
                    yield _block(r["path"], held)
                    held = []
            if held:
                yield _block(r["path"], held)


def _unzipped(raw) -> io.BufferedReader:
    import zstandard

    return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))


def _block(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([k for k, _ in held], pa.int64()), pa.array([v for _, v in held])], names=["file", "line", "value"])


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    """Strict scan: file, line and the schema's columns; a line that is no JSON object fails the job when its row is read."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = StructType(list(kind.fields)).add(CORRUPT, "string")
    rows = read_lines(spark, paths).withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"r.{CORRUPT}").isNotNull() | ~F.ltrim("value").startswith("{")
    message = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object"))
    # in a filter, so that it is never pruned away
    return rows.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)).select("file", "line", *[f"r.{f.name}" for f in kind.fields if f.name != CORRUPT])


RAW_DOCUMENT = "url string, text string, content string, document_id string, doc_id string, source_record struct<url:string,text:string>"


def extract_text() -> Column:
    return F.coalesce("source_record.text", "text", "content", F.lit(""))


def extract_url() -> Column:
    return F.coalesce("source_record.url", "url", F.lit(""))


def document_id() -> Column:
    made = F.sha1(F.concat(extract_url(), F.lit("\n"), extract_text()))
    return F.coalesce(F.nullif("document_id", F.lit("")), F.nullif("doc_id", F.lit("")), made)


def raw_documents(df: DataFrame) -> DataFrame:
    """Raw records (RAW_DOCUMENT) with canonical_doc_id, url and text first, the record's order columns kept."""
    order = [c for c in ("file", "line") if c in df.columns]
    return df.select(*order, document_id().alias("canonical_doc_id"), extract_url().alias("url"), extract_text().alias("text"))


def shard_id(name: str | Column = "file") -> Column:
    """The shard's id in a file name."""
    return F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"(shard_[0-9]{8})", 1)


def shard_output_name(path: str, stage: str, compressed: bool = True) -> str:
    stem = os.path.basename(path).removesuffix(".zstd").removesuffix(".jsonl")
    return f"{stem}.{stage}.jsonl" + ".zstd" * compressed


def write_jsonl(df: DataFrame, path: str, compressed: bool = False, append: bool = False) -> None:
    """JSON lines with nulls, one file a task; ``compressed`` files end in ``.jsonl.zstd`` and are whole frames each.

    A task writes a draft and renames it, so a repeated task leaves one file.  ``append`` adds files beside those there.
    """
    if not compressed:
        df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
        return
    where, name = _opened(path)
    old = [] if append else [f.path for f in where.get_file_info(fs.FileSelector(name, allow_not_found=True)) if f.path.endswith(ENDS)]
    where.create_dir(name, recursive=True)
    run = uuid.uuid4().hex[:12]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        out, folder = _opened(path)
        part = TaskContext.get().partitionId()
        final, draft = f"{folder}/part-{part:05d}-{run}.jsonl.zstd", f"{folder}/.{uuid.uuid4().hex}"
        n = 0
        with out.open_output_stream(draft, compression=None) as raw, zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as packed:
            for b in batches:
                n += b.num_rows
                packed.write("".join(f"{x}\n" for x in b.column(0).to_pylist()).encode())
        out.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], names=["file", "rows"])

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(write, "file string, rows long").collect()  # one row a file
    for f in old:
        where.delete_file(f)


def append_rows(path: str, rows: list[dict]) -> None:
    """Add rows of bounded number to one plain or zstd file, as frames of their own; a tail that was cut off is repaired first."""
    import zstandard

    where, name = _opened(path)
    repair(path)
    data = "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows).encode()
    have = b""
    if where.get_file_info(name).type != fs.FileType.NotFound:
        with where.open_input_stream(name, compression=None) as f:
            have = f.read()
    draft = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft, compression=None) as f:
        f.write(have + (zstandard.ZstdCompressor().compress(data) if name.endswith((".zstd", ".zst")) else data))
    where.move(draft, name)


def repair(path: str) -> bool:
    """Cut a file back to its last whole line, where a writer was stopped; returns whether anything was cut.

    A zstd file whose last frame is cut off keeps its whole frames and the whole lines of the last one, packed anew.
    """
    import zstandard

    where, name = _opened(path)
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return False
    with where.open_input_stream(name, compression=None) as f:
        data = f.read()
    if not name.endswith((".zstd", ".zst")):
        good = data[: data.rfind(b"\n") + 1]
    else:
        whole, rest, tail = 0, data, b""
        while rest:
            frame = zstandard.ZstdDecompressor().decompressobj()
            try:
                tail = frame.decompress(rest)
            except zstandard.ZstdError:
                tail = b""
                break
            if not frame.eof:
                break
            whole, rest, tail = len(data) - len(frame.unused_data), frame.unused_data, b""
        lines = tail[: tail.rfind(b"\n") + 1]
        good = data[:whole] + (zstandard.ZstdCompressor().compress(lines) if lines else b"")
    if good == data:
        return False
    draft = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft, compression=None) as f:
        f.write(good)
    where.move(draft, name)
    return True


def write_manifest(path: str, report: dict) -> None:
    """A driver-side report; a reader sees the old one or the whole new one."""
    where, name = _opened(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft, compression=None) as f:
        f.write((json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())
    where.move(draft, name)


def opened_input(path: str):
    """A file of any file system, to be read by the driver."""
    where, name = _opened(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return where.open_input_stream(name, compression=None)


def truncated_zstd(data: bytes) -> bool:
    """Whether the last frame of zstd data is cut off."""
    import zstandard

    frame, rest = None, data
    while rest:
        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            frame.decompress(rest)
        except zstandard.ZstdError:
            return True
        rest = frame.unused_data
    return frame is not None and not frame.eof
