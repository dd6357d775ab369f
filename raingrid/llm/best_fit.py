"""Best-fit-decreasing packing of token ids into fixed rows.

Every task packs its documents in blocks of a bounded number of tokens. A block holds enough
rows for the packing to be tight, so neither a whole partition nor the whole corpus has to be
held or sorted, and tasks do not depend on each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import bpe_ids, frames
from raingrid.session import fresh_path

BLOCK_TOKENS = 1 << 20


def best_fit(lengths, room: int) -> list[list[int]]:
    """Bins of indexes of ``lengths`` (each 1..room), by best-fit decreasing.

    A segment tree over the capacities 0..room counts the open bins of every remaining
    capacity; the search goes down it to the smallest capacity that still fits. Equal lengths
    keep their order, and of bins with equal room the one opened last is filled first.
    """
    size = 1 << room.bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    bins: list[list[int]] = []

    def add(capacity: int, change: int) -> None:
        node = capacity + size
        while node:
            tree[node] += change
            node >>= 1

    def smallest(at_least: int) -> int:
        """Smallest capacity of an open bin that is ``at_least`` so large, or -1."""
        node = at_least + size
        if tree[node]:
            return at_least
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return -1
        while node < size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - size

    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        capacity = smallest(n)
        if capacity < 0:
            bins.append([])
            spot, left = len(bins) - 1, room - n
        else:
            spot = open_bins[capacity].pop()
            add(capacity, -1)
            left = capacity - n
        bins[spot].append(i)
        if left:
            open_bins[left].append(spot)
            add(left, 1)
    return bins


def pack_best_fit(docs: DataFrame, path: str | None = None, max_len: int = 2048, end_id: int = 0,
                  pad_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence.

    Columns: sequence_id; ids (``max_len`` little-endian unsigned 32-bit ids, padded with
    ``pad_id``); cu_seqlens (0 and the end of every segment); doc_ids and starts of the segments
    (where a segment begins in its document); positions (``max_len`` unsigned 32-bit positions,
    0 again at every segment and in the padding); n_tokens without padding.
    A document is its ids and ``end_id``; one longer than ``max_len`` is cut into segments of
    that length and a rest, and nothing is dropped. A null or empty text is the end id alone;
    repeated rows are packed again; a null doc_id stays null; an empty table gives no rows;
    other columns of ``docs`` are ignored, whatever their names.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or bpe_ids.default_path()
    schema = ("ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, "
              "positions binary, n_tokens int")
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    end = end_id.to_bytes(4, "little")
    pad = pad_id.to_bytes(4, "little")
    counting = np.arange(max_len, dtype="<u4").tobytes()
    zero = bytes(4)

    def packed(held):
        got = {f.name: [] for f in out}
        for members in best_fit([len(s[2]) // 4 for s in held], max_len):
            parts = [held[i] for i in members]
            ends = np.cumsum([len(p[2]) // 4 for p in parts])
            blank = max_len - int(ends[-1])
            got["ids"].append(b"".join(p[2] for p in parts) + pad * blank)
            got["positions"].append(b"".join(counting[: len(p[2])] for p in parts) + zero * blank)
            got["cu_seqlens"].append([0, *ends.tolist()])
            got["doc_ids"].append([p[0] for p in parts])
            got["starts"].append([p[1] for p in parts])
            got["n_tokens"].append(int(ends[-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(got[f.name], type=f.type) for f in out], schema=out)

    def run(batches):
        enc = bpe_ids.encoder(path)
        held, total = [], 0
        for batch in batches:
            for part in frames.slices(batch):
                ids_of, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, text in zip(ids_of, texts):
                    ids = enc.ids(text or "") + end
                    for at in range(0, len(ids), 4 * max_len):
                        held.append((doc_id, at // 4, ids[at : at + 4 * max_len]))
                        total += len(held[-1][2]) // 4
                        if total >= block_tokens:
                            yield packed(held)
                            held, total = [], 0
        if held:
            yield packed(held)

    rows = frames.map_batches(docs.select("doc_id", "text"), run, schema)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id())


def write_matrix(packed: DataFrame, path: str) -> DataFrame:
    """Write packed rows as Parquet (id matrix rows, segment ends, position resets) and read them
    back; a trainer reads the same files."""
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def op7_pack_best_fit(spark, sf: str) -> DataFrame:
    """Sequences of all documents, from the written files: documents, segment ends, checksums."""
    rows = write_matrix(pack_best_fit(frames.documents(spark, sf)), fresh_path(spark, "packed"))
    return rows.select(
        "sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
