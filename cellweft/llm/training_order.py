"""Token ids of texts, written as fixed-stride shards in the order in which a training run reads them."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import keep, mix64, signature_rows

#: Tokens in a sequence and sequences in a shard: 4096 bytes and 64 MB at two bytes a token.
STRIDE, SHARD_ROWS = 2048, 16_384
#: The public pattern that splits text before merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of ``0 .. size - 1``: a balanced Feistel network over the next power of four, walked until inside."""

    size: int
    key: int
    rounds: int = 6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        half = np.uint64(max(1, ((self.size - 1).bit_length() + 1) // 2))
        low = np.uint64((1 << int(half)) - 1)
        out = x.astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & low
            for i in range(self.rounds):
                left, right = right, left ^ (mix64(right + mix64(np.full(1, (self.key * 64 + i) % (1 << 64), dtype=np.uint64))) & low)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(self.size)]
        return out.astype(np.int64)


class Tokens:
    """Token ids of whole texts as little-endian 16-bit numbers."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 2 ** 16 - 1:
            raise ValueError("the vocabulary needs more than two bytes a token")
        self.end = np.array([max(ranks.values()) + 1], dtype="<u2").tobytes()
        self.encoding = tiktoken.Encoding("training", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u2").tobytes()


def _packed(vocabulary: str, stride: int):
    """Sequences of one partition: its texts one after another, each with an end token; the last is filled with end tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, index, held, pieces = Tokens(vocabulary), TaskContext.get().partitionId(), 0, bytearray(), []
        kind = None

        def batch_of(rows: list) -> pa.RecordBatch:
            piece = pa.struct([("lineage", kind), ("start", pa.int64()), ("position", pa.int32()), ("n_tokens", pa.int32())])
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(piece))],
                names=["part", "index", "tokens", "pieces"])

        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for lineage, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = tokens.of(text) + tokens.end, 0
                while start < len(ids) // 2:
                    room = stride - len(held) // 2
                    n = min(room, len(ids) // 2 - start)
                    pieces.append({"lineage": lineage, "start": start, "position": len(held) // 2, "n_tokens": n})
                    held += ids[2 * start:2 * (start + n)]
                    start += n
                    if len(held) == 2 * stride:
                        rows.append((index, bytes(held), pieces))
                        index, held, pieces = index + 1, bytearray(), []
            if rows:
                yield batch_of(rows)
        if held:
            full = bytes(held) + tokens.end * (stride - len(held) // 2)
            yield batch_of([(index, full, pieces)])
    return run


def _slotted(offsets: dict[int, int], order: Feistel):
    """Replace ``part, index`` by the slot. Tokens are compressed sequence by sequence, for the shuffle; pieces stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.array([offsets[p] for p in batch.column(0).to_pylist()], dtype=np.int64)
            slot = order(before + batch.column(1).to_numpy(zero_copy_only=False))
            rest = batch.column(2)
            if batch.schema.names[2] == "tokens":
                rest = pa.array([zstandard.compress(x.as_py(), 6) for x in rest], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), rest], names=["slot", batch.schema.names[2]])
    return run


def open_folder(out: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all executors reach, and the path in it."""
    if out.startswith("file:"):
        out = "/" + out[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(out)


def shard_name(folder: str, shard: int) -> str:
    return str(PurePosixPath(folder) / f"shard-{shard:06d}.bin")


def _written(out: str, shard_rows: int):
    """Write each shard of a partition that is sorted by slot; a file appears under its name when it is whole, so retries are safe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_folder(out)
        files.create_dir(folder, recursive=True)
        shard, stream, n, aside = None, None, 0, ""
        done = []

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(aside, shard_name(folder, shard))
                done.append((shard, n))

        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if slot // shard_rows != shard:
                    close()
                    shard, n = slot // shard_rows, 0
                    aside = f"{shard_name(folder, shard)}.{TaskContext.get().taskAttemptId()}.part"
                    stream = files.open_output_stream(aside)
                stream.write(zstandard.decompress(data))
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in (0, 1)], names=["shard", "n"])
    return run


def write_training_order(signatures: DataFrame, vocabulary: str, out: str, stride: int = STRIDE, shard_rows: int = SHARD_ROWS,
                         key: int = 20240607) -> DataFrame:
    """Write the texts of ``signatures(lineage, genes)`` as shards of token ids in training order; tell where each text went.

    Texts are encoded with the rank file ``vocabulary`` (its place is the same on all machines), each followed by an end token (the
    number after the last rank), and packed into sequences of ``stride`` tokens within the partition that reads them; only the last
    sequence of a partition is filled up, with end tokens. Sequence ``i`` of all gets the global slot ``Feistel(i)``, a keyed
    permutation, so the order is random, repeatable and needs no shuffle buffer. Slots are cut into ranges of ``shard_rows``; a task sorts a
    range and writes ``out/shard-000000.bin`` and so on: slot ``s`` stands in shard ``s // shard_rows`` at byte ``2 * stride * (s %
    shard_rows)``, so a reader that stopped after slot ``s`` seeks to ``s + 1``.

    Returns a row for each run of a text's tokens in a sequence: ``lineage, slot, shard, position, start, n_tokens``, where
    ``position`` counts tokens in the sequence and ``start`` tokens of the text. Together a text's rows hold all its tokens.

    Null text is empty and gives an end token; null lineages are kept. Repeated rows are written as often as they come; very long texts
    run on over many sequences. An empty table writes no shard and gives no rows. Extra columns are left out.
    """
    rows = signature_rows(signatures)
    kind = rows.schema["lineage"].dataType.simpleString()
    piece = f"struct<lineage: {kind}, start: bigint, position: int, n_tokens: int>"
    packed = keep(rows.mapInArrow(_packed(vocabulary, stride), f"part int, index bigint, tokens binary, pieces array<{piece}>"), "zstd")
    offsets, total = {}, 0
    for part, n in packed.groupBy("part").count().orderBy("part").collect():  # a row for each task that packed, not for each sequence
        offsets[part], total = total, total + n
    slots = _slotted(offsets, Feistel(total, key))
    if total:
        shards = -(-total // shard_rows)
        placed = packed.select("part", "index", "tokens").mapInArrow(slots, "slot bigint, tokens binary")
        by_range = (placed.withColumn("shard", F.floor(F.col("slot") / shard_rows)).repartitionByRange(shards, "shard")
                    .sortWithinPartitions("slot").select("slot", "tokens"))
        written = sum(r.n for r in by_range.mapInArrow(_written(out, shard_rows), "shard bigint, n bigint").collect())
        if written != total:
            raise RuntimeError(f"{written} of {total} sequences were written")
    where = packed.select("part", "index", "pieces").mapInArrow(slots, f"slot bigint, pieces array<{piece}>")
    return where.select("slot", F.explode("pieces").alias("p")).select(
        "p.lineage", "slot", F.floor(F.col("slot") / shard_rows).cast("long").alias("shard"), "p.position", "p.start", "p.n_tokens")


def read_slots(out: str, first: int, n: int, stride: int = STRIDE, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """``n`` sequences from slot ``first`` on, as a trainer that resumes there reads them."""
    files, folder = open_folder(out)
    rows = []
    for slot in range(first, first + n):
        with files.open_input_file(shard_name(folder, slot // shard_rows)) as stream:
            stream.seek(2 * stride * (slot % shard_rows))
            rows.append(np.frombuffer(stream.read(2 * stride), dtype="<u2"))
    return np.stack(rows)
