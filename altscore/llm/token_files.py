"""Token-id files: blocks of ids by the context-mixing coder (``codec``).

*Format.*  A Parquet table, one row per block: ``part`` and ``block`` (order),
``first`` (ids of the part before it), ``n_ids``, ``crc32`` of its ids as
little-endian unsigned 32-bit integers, ``payload`` (the coded ids, padded to
``steps`` ids) and ``docs``: the pieces of documents in it, as (doc_id, start
in the part, number of the piece, ids here).  Parquet gives the rows atomic
commits and works on any store that Spark reaches; every block can be read, and
is checked, on its own.

Documents are range-partitioned by id and sorted, so parts and blocks follow
ascending ids; ids of one part run through its blocks without gaps.  A task holds
one batch of blocks, whatever the size of its part or of a document.

Defined results: null and empty texts have the end id alone; a null id sorts
first; rows that repeat an id are ordered by text and each have their place; an
empty table gives an empty file; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codec
from .common import arrow_batches, staged
from .tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCKS = 2048              # blocks coded at a time: lanes of the coder

DOCS = "array<struct<doc_id:{kind},start:long,piece:int,n:int>>"
ROW = "part int, block long, first long, n_ids int, steps int, crc32 long, payload binary, docs " + DOCS


class CorruptBlock(ValueError):
    """The ids of a block don't have the checksum that was written."""


def _rows(part: int, block: int, first: int, ids: np.ndarray, pieces: list, kind: pa.DataType, size: int) -> pa.RecordBatch:
    """Record batch of the blocks of ``ids``; pieces: (doc_id, start, number, end)
    in order, ends counted from the first id of the batch."""
    cuts = [ids[k:k + size] for k in range(0, len(ids), size)]
    steps = max(map(len, cuts))
    lanes = np.zeros((len(cuts), steps), "<u2")
    for lane, c in zip(lanes, cuts):
        lane[:len(c)] = c
    docs, at, p = [], 0, 0
    for c in cuts:
        own, end = [], at + len(c)
        while at < end:
            doc, start, number, stop = pieces[p]
            take = min(stop, end) - at
            own.append({"doc_id": doc, "start": start, "piece": number, "n": take})
            at += take
            if at == stop:
                p += 1
            else:
                pieces[p] = (doc, start, number + 1, stop)
        docs.append(own)
    n = len(cuts)
    item = pa.struct([("doc_id", kind), ("start", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())])
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * n, pa.int32()), pa.array(range(block, block + n), pa.int64()),
         pa.array([first + k * size for k in range(n)], pa.int64()), pa.array(list(map(len, cuts)), pa.int32()),
         pa.array([steps] * n, pa.int32()), pa.array(list(map(codec.crc_of, cuts)), pa.int64()),
         pa.array(codec.encode(lanes), pa.binary()), pa.array(docs, pa.list_(item))],
        names=["part", "block", "first", "n_ids", "steps", "crc32", "payload", "docs"])


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = codec.BLOCK,
          blocks: int = BLOCKS) -> None:
    """Write the ids of all documents to a new token file at ``path``.

    ``size``: ids of a block; ``blocks``: blocks coded at a time.  The vocabulary
    must not pass 65,536 ids.
    """
    largest = max([end_id, *encoder(tokenizer).tok.get_vocab(with_added_tokens=True).values()])
    if largest > 0xFFFF:
        raise ValueError(f"{tokenizer}: id {largest} has more than 16 bits")
    spark = docs.sparkSession
    arrow_batches(spark)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # parts are numbered by task; where AQE merges small ranges, tasks still follow the ids
    d = d.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    end, batch_ids = np.array([end_id], "<u4").tobytes(), blocks * size

    def run(batches):
        enc, part, block, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        buffer, held, pieces = [], 0, []      # ids not yet coded; of the current batch
        position = 0                          # ids of the part so far
        kind = None

        def full(final: bool):
            """Code whole batches; at the end, the rest."""
            nonlocal buffer, held, pieces, block, first
            while held >= batch_ids or (final and held):
                ids = np.concatenate(buffer)
                now, rest = ids[:batch_ids], ids[batch_ids:]
                inside, after = [], []
                for doc, start, number, stop in pieces:
                    if stop <= len(now):
                        inside.append((doc, start, number, stop))
                    else:
                        after.append((doc, start, number, stop))
                if after and (inside[-1][3] if inside else 0) < len(now):
                    doc, start, number, stop = after[0]
                    inside.append((doc, start, number, len(now)))
                    begun = inside[-2][3] if len(inside) > 1 else 0
                    after[0] = (doc, start, number + _blocks_between(begun, len(now), size), stop)
                yield _rows(part, block, first, now, inside, kind, size)
                block += -(-len(now) // size)
                first += len(now)
                pieces = [(doc, start, number, stop - len(now)) for doc, start, number, stop in after]
                buffer, held = ([rest] if len(rest) else []), len(rest)

        for b in batches:
            kind = b.schema.field(0).type
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, "<u4").astype("<u2")
                buffer.append(ids)
                held += len(ids)
                pieces.append((doc, position, 0, held))
                position += len(ids)
                yield from full(False)
        yield from full(True)

    kind = d.schema["doc_id"].dataType.simpleString()
    d.mapInArrow(run, ROW.format(kind=kind)).write.option("compression", "none").parquet(path)


def _blocks_between(a: int, b: int, size: int) -> int:
    """Blocks that hold ids a to b - 1 of a batch."""
    return (b - 1) // size - a // size + 1


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids."""
    arrow_batches(spark)
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches):
        # lanes from several Arrow batches, so that the coder has enough of them
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCKS:
                yield from decoded(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from decoded(pa.Table.from_batches(held))

    def decoded(t):
        steps = np.asarray(t.column("steps"))
        for s in np.unique(steps):
            part = t.filter(pa.array(steps == s))
            ids = codec.decode(part.column("payload").to_pylist(), int(s))
            cols = ([], [], [], [], [], [])
            meta = zip(part.column("part").to_pylist(), part.column("n_ids").to_pylist(), part.column("crc32").to_pylist(),
                       part.column("docs").to_pylist(), ids)
            for no, n, crc, docs, lane in meta:
                raw = memoryview(lane[:n].astype("<u4").tobytes())
                if zlib.crc32(raw) != crc:
                    raise CorruptBlock(f"part {no}")
                at = 0
                for x in docs:
                    for c, v in zip(cols, (no, x["start"], x["doc_id"], x["piece"], x["n"],
                                           zlib.crc32(raw[4 * at:4 * (at + x["n"])]))):
                        c.append(v)
                    at += x["n"]
            types = [pa.int32(), pa.int64(), t.schema.field("docs").type.value_type.field("doc_id").type, pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)],
                                             names=["part", "first", "doc_id", "piece", "n", "crc"])

    pieces = staged(files.mapInArrow(run, f"part int, first long, doc_id {kind}, piece int, n long, crc long"), "token-pieces")

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for row in parts:
            crc = 0
            for k, x in enumerate(() if row is None else row):
                crc = x["crc"] if k == 0 else codec.crc_join(crc, x["crc"], 4 * x["n"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    # nearly all documents are one piece; the pieces of the others are put together
    whole = F.array_sort(F.collect_list(F.struct("piece", "n", "crc")))
    d = pieces.groupBy("part", "first", "doc_id").agg(F.sum("n").alias("n_tokens"), whole.alias("pieces"))
    per = pieces.groupBy("part").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)     # a row per part
    before = per.select("part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    d = d.join(before, "part")
    # Python sees the pieces of long documents only
    several = F.when(F.size("pieces") > 1, F.col("pieces"))
    crc = F.when(F.size("pieces") == 1, F.col("pieces")[0]["crc"]).otherwise(joined(several))
    return d.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
