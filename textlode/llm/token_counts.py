"""Token counts of documents in flat token files, by a scan for separators.

A flat file holds only identifiers, document after document, each ended by the end-of-document
identifier; nothing says where documents start. Files are cut into blocks of fixed size. Each
block is searched by one vectorised comparison and leaves its separators and three sums. A
prefix scan over the blocks of each file, in two levels so that no task holds a file's blocks,
gives every block its first token, its first document and the last separator before it, and
documents that cross blocks are stitched from these.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SLICE, encoder
from .common import by_slices, park, table
from .pretokens import vocabulary

BLOCK_TOKENS = 1 << 16
#: Blocks in one task of the prefix scan's lower level.
SPAN = 4096
#: Blocks of a flat file that are read in one go, and how many such ranges a task reads on average.
RANGE_BLOCKS, RANGES_PER_TASK = 64, 16

BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary())])
SCANNED = "file string, block long, n long, seps array<int>"


def opened(path: str) -> pa.NativeFile:
    """A file that Spark has listed, for reads at any place. Local paths and what pyarrow has a file system for."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    found, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return found.open_input_file(name)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, data) of flat little-endian token files under `path`.

    Spark lists the files without their content. A task reads ranges of whole blocks, so that a file of any
    size is spread over tasks and no more than a block is held. An empty file has no blocks.
    """
    step = width * block_tokens
    reach = RANGE_BLOCKS * step
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.lit(reach)).cast("long"))
    ranges = files.select("file", "length", F.explode(parts).alias("part"))
    tasks = max(1, math.ceil(ranges.count() / RANGES_PER_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["part"] * reach
                with opened(row["file"]) as source:
                    source.seek(start)
                    for k, at in enumerate(range(start, min(start + reach, row["length"]), step)):
                        data = source.read(min(step, row["length"] - at))
                        if len(data) < min(step, row["length"] - at):
                            raise EOFError(f"{row['file']} is shorter than it was")
                        yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["part"] * RANGE_BLOCKS + k], pa.int64()), pa.array([data], pa.binary())], schema=BLOCKS)

    return ranges.repartition(tasks, "file", "part").mapInArrow(read, "file string, block long, data binary")


def write_token_blocks(df: DataFrame, key: str, text: str, path: str, pattern: str, eos: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenise and lay out a table: (blocks, manifest). Each input partition makes one flat file.

    blocks: file, block, data. manifest: file, doc_index (the place in the file), key. Null texts are
    empty documents. Only key and text are read. The blocks are the flat file's bytes and nothing else;
    the manifest is the writer's record of what it wrote, kept beside it. Both are written to the
    shared folder in one pass.
    """
    code, step = {2: "H", 4: "I"}[width], width * block_tokens
    end = array(code, [eos]).tobytes()
    kind = df.schema[key].dataType.simpleString()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, name = encoder(path, pattern).encode_all, f"part-{TaskContext.get().partitionId():06d}"
        rest, block, index, keys = bytearray(), 0, 0, []

        def out(data: bytes) -> pa.RecordBatch:
            nonlocal keys, index
            docs = pa.array([keys], pa.list_(key_type))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([index], pa.int64()), docs], names=["file", "block", "data", "first", "keys"])
            index, keys = index + len(keys), []
            return row

        for batch in by_slices(batches, size=SLICE):
            key_type = batch.column("k").type
            for k, x in zip(batch.column("k").to_pylist(), encode_all([x or "" for x in batch.column("t").to_pylist()])):
                ids = np.frombuffer(x, np.uint32)
                rest += ids.astype(f"<u{width}").tobytes()
                rest += end
                keys.append(k)
                at = 0
                while len(rest) - at >= step:
                    yield out(bytes(rest[at : at + step]))
                    block, at = block + 1, at + step
                if at:
                    del rest[:at]
        if rest or keys:
            yield out(bytes(rest))

    laid = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lay, f"file string, block long, data binary, first long, keys array<{kind}>")
    written = park(laid, "tokens")
    manifest = written.select("file", "first", F.posexplode("keys").alias("i", key)).select("file", (F.col("first") + F.col("i")).alias("doc_index"), key)
    return written.select("file", "block", "data"), manifest


def scan_blocks(blocks: DataFrame, eos: int, width: int = 2) -> DataFrame:
    """(file, block, n, seps) of every block: its tokens, and where in it the separators are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer() or b"", f"<u{width}") for x in batch.column("data")]
            seps = [np.flatnonzero(x == eos).astype(np.int32) for x in tokens]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([len(x) for x in tokens], pa.int64()), pa.array(seps, pa.list_(pa.int32()))], names=["file", "block", "n", "seps"])

    return blocks.select("file", "block", "data").mapInArrow(scan, SCANNED)


def count_tokens(blocks: DataFrame, eos: int, width: int = 2) -> DataFrame:
    """(file, doc_index, first_token, n_tokens, ended) of every document, counted from the tokens alone.

    n_tokens excludes the separator. Tokens after a file's last separator are a document that is not
    ended; no tokens there are none. Blocks may be of any lengths, empty ones too; (file, block) must
    tell them apart. An empty table gives an empty one.
    """
    size, last = F.size("seps").cast("long"), F.element_at("seps", -1)
    spans = park(scan_blocks(blocks, eos, width), "separators").withColumns(
        {"span": F.floor(F.col("block") / SPAN), "k": size, "last": F.when(F.size("seps") > 0, last).cast("long")}
    )
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # lower level: sums and the last separator within the span
    local = spans.withColumns({"at": F.coalesce(F.sum("n").over(inside), zero), "index": F.coalesce(F.sum("k").over(inside), zero)})
    local = local.withColumn("before", F.max(F.col("at") + F.col("last")).over(inside))
    # upper level: one row a span
    total = local.groupBy("file", "span").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"), F.max(F.col("at") + F.col("last")).alias("sl"), F.max("block").alias("sb"))
    whole = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumns({"gat": F.coalesce(F.sum("sn").over(whole), zero), "gindex": F.coalesce(F.sum("sk").over(whole), zero)})
    total = total.withColumns({"gbefore": F.max(F.col("gat") + F.col("sl")).over(whole), "gblock": F.max("sb").over(Window.partitionBy("file"))})
    placed = local.join(total.select("file", "span", "gat", "gindex", "gbefore", "gblock"), ["file", "span"]).select(
        "file",
        "seps",
        (F.col("gat") + F.col("at")).alias("at"),
        (F.col("gindex") + F.col("index")).alias("index"),
        F.coalesce(F.col("gat") + F.col("before"), "gbefore", F.lit(-1)).cast("long").alias("before"),
        F.when(F.col("block") == F.col("gblock"), F.col("n")).alias("tail"),
    )
    # an open document at the end of a file is closed by a place past its last token
    stops = F.concat(F.transform("seps", lambda x: x.cast("long")), F.when(F.col("tail").isNotNull(), F.array("tail")).otherwise(F.array().cast("array<long>")))
    docs = placed.withColumn("stops", stops).select("file", "at", "index", "before", "stops", "tail", F.posexplode("stops").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("before") + 1).otherwise(F.col("at") + F.get("stops", F.col("i") - 1) + 1)
    open_end = F.col("tail").isNotNull() & (F.col("i") == F.size("stops") - 1)
    found = docs.select("file", (F.col("index") + F.col("i")).alias("doc_index"), start.alias("first_token"), (F.col("at") + F.col("stop") - start).alias("n_tokens"), (~open_end).alias("ended"))
    return found.where("ended or n_tokens > 0")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document laid out in flat 16-bit token files, and its tokens counted from those."""
    import public_tokenizers

    # fixed value: the vocabulary's end-of-document identifier
    eos = 50256
    blocks, manifest = write_token_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, eos)
    counts = count_tokens(blocks, eos)
    return counts.join(manifest, ["file", "doc_index"]).select("doc_id", "n_tokens", F.col("file").alias("token_file"), "doc_index", "first_token")
