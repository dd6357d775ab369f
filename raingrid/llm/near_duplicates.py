"""Near-duplicate classes by one-permutation MinHash, banded buckets and star-shaped edges.

1. Every text becomes a set of shingles, its digest and its band keys. Texts with equal sets are
   one node from here on, so exact copies never meet in a bucket.
2. Members of a bucket are linked to two centres only, so pairs grow with the memberships. Links
   are confirmed on the full sets, and components are joined.
3. Buckets whose members are still in more than one component are looked through exactly: in
   cells of bounded members and shingles, members of different components are compared on their
   full sets, however long, and only a spanning forest of true links leaves a cell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames, oph, textscan
from raingrid.llm.components import components
from raingrid.session import written

#: Bins, and the chance that a pair just at the limit may have to share no bucket.
BINS, MISS = 256, 5e-6
#: Members and shingles of one side of a cell, on average; a longer set is a side of its own.
CELL, CELL_SHINGLES = 1024, 1 << 19


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the limit with ``MISS`` at most.

    36 bands of 7 bins at 85 percent, 42 of 6 at 80.
    """
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** (BINS // (rows + 1)) <= MISS:
        rows += 1
    return BINS // rows, rows


def _shingles(text: str | None, width: int) -> np.ndarray:
    return textscan.shingle_set(textscan.word_hashes((text or "").encode().lower()), width)


def _digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def sketch(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest of the shingle set (null if empty) and its
    band keys."""
    bands, rows = layout(percent)

    def run(cols):
        out = {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "n_shingles": [], "digest": [],
               "bands": []}
        for text in cols["text"]:
            members = _shingles(text, width)
            out["n_shingles"].append(len(members))
            out["digest"].append(_digest(members))
            out["bands"].append(
                oph.band_keys(oph.signature(members, BINS), bands, rows).astype(np.int64)
                if len(members) else None)
        return out

    return frames.map_slices(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run,
        "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(cols):
        out = {"digest": [], "shingles": []}
        for text in cols["text"]:
            members = _shingles(text, width)
            out["digest"].append(_digest(members))
            out["shingles"].append(members.astype(np.int64))
        return out

    return frames.map_slices(docs.select("text"), run, "digest binary, shingles array<long>")


def _alike(shared, n_a, n_b, percent: int):
    """100 * shared >= percent * union, in whole numbers."""
    return (100 + percent) * shared >= percent * (n_a + n_b)


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full sets are alike."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return edges.join(a, "a").join(b, "b").where(
        _alike(shared, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _shared_counts(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets in ``rows`` with all sets, by products of 0/1 blocks."""
    items, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for at in range(0, len(items), 4096):
        lo, hi = np.searchsorted(place, [at, at + 4096])
        block = np.zeros((len(sets), min(4096, len(items) - at)), np.float32)
        block[owner[lo:hi], place[lo:hi] - at] = 1
        out += block[rows] @ block.T
    return out


def cell_links(node, root, n, sets, percent: int = 85):
    """Links (a, b) between members of different components in one cell, compared on their whole
    sets; a link that joins nothing new is left out."""
    node, root, n = np.asarray(node), np.asarray(root), np.asarray(n)
    names, counts = np.unique(root, return_counts=True)
    rows = np.flatnonzero(root != names[counts.argmax()])  # two of the largest need no comparison
    part_of, found = root.copy(), []
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        shared = _shared_counts(sets, some)
        for k, i in enumerate(some.tolist()):
            alike = _alike(shared[k], n, n[i], percent)
            while len(others := np.flatnonzero(alike & (part_of != part_of[i]))):
                j = others[0]
                found.append((node[i], node[j]))
                part_of[part_of == part_of[j]] = part_of[i]
    return found


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) from bucket members (key, cell, node, root, n, shingles)."""

    def run(batches):
        where, held = None, []

        def links():
            found = cell_links(*zip(*held), percent=percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            keys, cells = cols["key"].to_pylist(), cols["cell"].to_pylist()
            node, root, n = (cols[k].to_pylist() for k in ("node", "root", "n"))
            for i, k in enumerate(zip(keys, cells)):
                if k != where:
                    yield links()
                    where, held = k, []
                # Copied, so that a cell does not keep whole batches.
                held.append((node[i], root[i], n[i], cols["shingles"][i].values.to_numpy().copy()))
        yield links()

    return frames.map_batches(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Words are what lies between blanks after folding A-Z; a set is the distinct ``width``-word
    shingles of a text, or its whole sequence if it has fewer words. Texts with 100 * shared >=
    ``percent`` * union are linked. component_id is the smallest doc_id of the class; kept says
    that it is the row's own. Texts without words are linked with nothing. Rows that repeat a
    doc_id are all answered. Rows without an id take part in links but name no class: their
    component_id is null, and they are kept, only if no row of their class has an id. An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    return verdicts(docs, percent, width).drop("text_key")


def verdicts(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """The result of ``near_duplicates`` with text_key, the xxhash64 of the row's text: an id that
    is null or repeated does not name a row, the two together do, but for equal rows."""
    docs = docs.select("doc_id", "text")
    sketched = written(sketch(docs, width, percent), "sketches")
    nodes = written(
        sketched.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("rep_doc"), F.first("n_shingles").alias("n"),
             F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n").alias("load")).where("size > 1")
    members = written(keyed.join(shared, "key"), "members")

    spot = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    centres = members.groupBy("key").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    fits = _alike(F.least("n", "m"), F.col("n"), F.col("m"), percent)
    star = (
        members.join(centres, "key")
        .select("node", "n", F.explode(F.array("lo", "hi")).alias("c"))
        .select("node", "n", F.col("c.node").alias("other"), F.col("c.n").alias("m"))
        .where((F.col("node") != F.col("other")) & fits)
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        .distinct()
    )
    active = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", "digest", "rep_doc", "n")
    wanted = docs.join(active.select("rep_doc").distinct(),
                       F.col("doc_id").eqNullSafe(F.col("rep_doc")), "left_semi")
    sets = written(
        _full_sets(wanted, width).where("digest IS NOT NULL").dropDuplicates(["digest"])
        .join(active.select("node", "digest", "n"), "digest").drop("digest"), "sets")
    links = written(_confirmed(star, sets, percent), "links")
    roots = written(components(links), "roots")

    with_root = members.where("size > 2").join(roots, "node", "left").select(
        "key", "size", "load", "node", F.coalesce("root", "node").alias("root"))
    unsettled = with_root.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    width_of = F.ceil(F.greatest(F.col("size") / CELL, F.col("load") / CELL_SHINGLES))
    own = F.pmod(F.xxhash64("node", F.lit(1)), width_of)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), width_of - 1),
                        lambda t: F.least(own, t) * (1 << 31) + F.greatest(own, t))
    rows = (
        with_root.join(unsettled, "key").join(sets, "node")
        .select("key", F.explode(cells).alias("cell"), "node", "root", "n", "shingles")
        .repartition("key", "cell").sortWithinPartitions("key", "cell")
    )
    more = written(_cells(rows, percent), "more-links")
    every = more.union(
        roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    final = written(components(every), "final-roots")

    classes = nodes.join(final, "node", "left").select(
        "digest", "rep_doc", F.coalesce("root", "node").alias("root"))
    names = classes.groupBy("root").agg(F.min("rep_doc").alias("component_id"))
    named = classes.join(names, "root").select("digest", "component_id")
    out = sketched.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_duplicates(spark, sf: str) -> DataFrame:
    return near_duplicates(frames.documents(spark, sf))
