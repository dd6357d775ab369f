"""Packing by power-of-two decomposition (dataset decomposition).

Every document is cut into full sequences and then into pieces whose lengths are the powers of
two of the rest, longest first. A piece is a sequence of its own, so no sequence crosses
documents and nothing is padded; sequences of one length form a bucket, which a trainer reads
with a batch size to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import bpe_ids, frames


def pieces(n: int, most: int) -> list[int]:
    """Lengths that add up to ``n``: full ones, then falling powers of two. ``most`` is one."""
    out = [most] * (n // most)
    rest = n % most
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack_binary(docs: DataFrame, path: str | None = None, max_len: int = 1024,
                end_id: int = 0) -> DataFrame:
    """One row per piece: where it lies in its document, its ids and its sequence.

    Columns: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens,
    bucket (log2 of the length), sequence_id, offset (always 0).
    ``max_len`` must be a power of two. A null or empty text is the end id alone. Repeated rows
    are packed again; a null doc_id stays null. An empty table gives no rows. Other columns of
    ``docs`` are ignored, whatever their names. Sequence ids are the number of the input
    partition and a count in it, so they are unique, and equal again if a task is repeated.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = path or bpe_ids.default_path()

    def run(cols):
        enc = bpe_ids.encoder(path)
        end = end_id.to_bytes(4, "little")
        out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "bucket")}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            ids = enc.ids(text or "") + end
            n, at = len(ids) // 4, 0
            for size in pieces(n, max_len):
                out["doc_id"].append(doc_id)
                out["start"].append(at)
                out["length"].append(size)
                out["ids"].append(ids[4 * at : 4 * (at + size)])
                out["doc_tokens"].append(n)
                out["bucket"].append(size.bit_length() - 1)
                at += size
        return out

    cut = frames.map_slices(
        docs.select("doc_id", "text"), run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(),
                            "offset": F.lit(0).cast("long")})


def op10_pack_binary(spark, sf: str) -> DataFrame:
    """Pieces of all documents, with the checksum of each piece's ids."""
    return digest(pack_binary(frames.documents(spark, sf)))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "bucket")


