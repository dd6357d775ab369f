"""Tokens of two tokenizers aligned by the bytes they cover.

The ends of the tokens of both tokenizers are two sorted lists. Their merge is divided by merge
path: a binary search on each diagonal finds how many ends of either list come before it, so every
piece has the same number of ends and can be done on its own. A piece emits the overlaps that end
in it; overlaps up to a common end are one group, and groups that reach over a border are stitched
by counting on from piece to piece. How many documents link a pair of ids is counted by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import bpe_ids, frames, piece_codec
from raingrid.session import written

#: Ends of one piece of a merge; links that are held at once.
PIECE, LINKS = 1 << 16, 1 << 20
#: Chunks that each tokenizer keeps the ids of, in each of two generations.
CACHED = 250_000
#: Most frequent pairs that are sent to every task, at most so many; all others are joined.
SENT_PAIRS = 1 << 18


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> list[tuple[int, int]]:
    """(ends of ``a``, ends of ``b``) before each border of pieces of about ``piece`` ends.

    An end of both lists is never parted: a border between the two moves behind them.
    """
    k = np.arange(piece, len(a) + len(b), piece)
    low, high = np.maximum(0, k - len(b)), np.minimum(k, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # Where nothing is left to search, mid may be past the end; its answer is not used.
        before = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(k - 1 - mid, 0, len(b) - 1)]
        low = np.where(open_ & before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    i, j = low, k - low
    parted = (i > 0) & (j < len(b))
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    cuts = list(zip(i.tolist(), (j + parted).tolist()))
    return [(0, 0), *dict.fromkeys(cuts), (len(a), len(b))]


def overlaps(a: np.ndarray, b: np.ndarray, begin, end):
    """Overlapping tokens (i, j) whose common bytes end in one piece, in order, and whether both
    tokens end there."""
    (i0, j0), (i1, j1) = begin, end
    x, y = a[i0:i1], b[j0:j1]
    at, back = np.searchsorted(y, x), np.searchsorted(x, y)
    closes = np.zeros(len(x), bool)
    inside = at < len(y)
    closes[inside] = y[at[inside]] == x[inside]
    alone = np.ones(len(y), bool)
    alone[at[closes]] = False
    later = np.concatenate(([0], np.cumsum(alone)))  # ends of b alone before each place
    size = len(x) + int(later[-1])
    i, j, shut = np.empty(size, np.int64), np.empty(size, np.int64), np.zeros(size, bool)
    spot = np.arange(len(x)) + later[at]
    i[spot], j[spot], shut[spot] = i0 + np.arange(len(x)), j0 + at, closes
    spot = back[alone] + later[:-1][alone]
    i[spot], j[spot] = i0 + back[alone], j0 + np.flatnonzero(alone)
    return i, j, shut


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Number of the group of every token of ``a`` and of ``b`` (ends, both with the same last)."""
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    cuts, done = diagonals(a, b, piece), 0
    for begin, end in zip(cuts, cuts[1:]):
        i, j, shut = overlaps(a, b, begin, end)
        closed = done + np.cumsum(shut)
        group = closed - shut  # a group goes on over the border unless a common end closed it
        of_a[i], of_b[j] = group, group
        done = int(closed[-1]) if len(closed) else done
    return of_a, of_b


def _runs(keys: np.ndarray, times: np.ndarray | None = None):
    """Distinct keys in order, and the sums of their times (of one each, if not given)."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    if times is None:
        return keys[at], np.diff(at, append=len(keys))
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def links(a_ids, b_ids, of_a, of_b, doc_of_group, limit: int = LINKS):
    """(doc, pair, times) of every document and pair of ids linked in it; a pair is the id of
    ``a`` times 2**32 plus that of ``b``. At most ``limit`` links are spread out at once."""
    n_a, n_b = np.bincount(of_a), np.bincount(of_b)
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    count = n_a * n_b
    # One number for document and both ids, as small as they allow.
    wide_a, wide_b = (int(x.max()) + 1 if len(x) else 1 for x in (a_ids, b_ids))
    base = doc_of_group * wide_a
    found = []

    def block(lo, hi):
        of = np.repeat(np.arange(lo, hi), count[lo:hi])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
        up, over = np.divmod(nth, n_b[of])
        found.append(_runs((base[of] + a_ids[start_a[of] + up]) * wide_b + b_ids[start_b[of] + over]))

    def wide(g):
        """One group of very many links: distinct ids first, then a part of those of ``a``."""
        xs, x_times = np.unique(a_ids[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        ys, y_times = np.unique(b_ids[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        step = max(1, limit // len(ys))
        for at in range(0, len(xs), step):
            keys = ((base[g] + xs[at : at + step, None]) * wide_b + ys).ravel()
            found.append((keys, (x_times[at : at + step, None] * y_times).ravel()))

    lo = 0
    for g in np.flatnonzero(count > limit).tolist() + [len(count)]:
        while lo < g:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(count[lo:g]), limit, "right")))
            block(lo, hi)
            lo = hi
        if g < len(count):
            wide(g)
            lo = g + 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    keys, times = found[0] if len(found) == 1 else _runs(
        *(np.concatenate([f[i] for f in found]) for i in (0, 1)))
    keys, b = np.divmod(keys, wide_b)
    doc, a = np.divmod(keys, wide_a)
    return doc, a << 32 | b, times


class Pieces:
    """Ids of a sentence-piece model, with a bounded cache over blank-separated chunks.

    A chunk is also cut before its last mark if no piece has that mark behind that letter, as then
    no piece can reach over the cut. What cannot be cut at blanks goes to the codec whole.
    """

    def __init__(self, codec: piece_codec.Codec, limit: int):
        own = codec.model
        self.codec, self.model = codec, codec.tokenizer.model
        self.cut = codec.cut and own.kind == piece_codec.BPE and own.byte_fallback and not any(
            kind == piece_codec.USER_DEFINED for _, _, kind in own.pieces)
        self.beside = {pair for p, _, kind in own.pieces if kind == piece_codec.NORMAL
                       for pair in zip(p, p[1:])}
        self.chunks = bpe_ids.Recent(self._chunk, limit)
        self.marks = {c: self._ids(c) for c in bpe_ids.MARKS} if self.cut else {}

    def _ids(self, shown: str) -> bytes:
        return bpe_ids.packed([t.id for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        head, mark = chunk[:-1], chunk[-1:]
        if head and mark in self.marks and (head[-1], mark) not in self.beside:
            return self.chunks[head] + self.marks[mark]
        return self._ids(piece_codec.BLANK + chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.codec.chunks_of(t) if self.cut else None for t in texts]
        whole = iter(self.codec.encode([t for t, c in zip(texts, cut) if c is None]))
        return [next(whole)[0] if c is None else b"".join(map(self.chunks.__getitem__, c)) for c in cut]


def _joined(packed: list[bytes], spelled: list[bytes], size: np.ndarray) -> list[bytes]:
    """Bytes of the tokens of every text."""
    ids = np.frombuffer(b"".join(packed), "<u4")
    flat = np.frombuffer(b"".join(spelled), np.uint8)
    sizes = size[ids]
    ends = np.cumsum(sizes)
    place = np.repeat((np.cumsum(size) - size)[ids] - (ends - sizes), sizes)
    place += np.arange(len(place))
    out = flat[place].tobytes()
    stops = np.concatenate(([0], ends))[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
    return [out[i:j] for i, j in zip(stops, stops[1:])]


class Aligner:
    """Both tokenizers, and the bytes and decimal names of their ids."""

    def __init__(self, path: str, model: bytes):
        codec = piece_codec.Codec(model, verify=False, limit=CACHED // 4)
        self.a, self.b = bpe_ids.Encoder(path, CACHED), Pieces(codec, CACHED)
        letters = {c: b for b, c in bpe_ids._alphabet().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() \
                else token.encode()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if kind == piece_codec.BYTE
            else p.replace(piece_codec.BLANK, " ").encode() for p, _, kind in codec.model.pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64)
                                    for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (
            [np.array([f"{i}{mark}" for i in range(len(t))], object) for mark in marks]
            for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def tokens(self, texts: list[str | None]):
        """Ids of both tokenizers, or None for a text whose tokens are not its bytes."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        a = [self.a.ids(" " + t) if t else b"" for t in texts]
        b = [x if t else b"" for t, x in zip(texts, self.b.encode([t or "" for t in texts]))]
        same = [x == y == z for x, y, z in zip(raw, _joined(a, self.a_bytes, self.a_size),
                                               _joined(b, self.b_bytes, self.b_size))]
        return [(np.frombuffer(x, "<u4").astype(np.int64), np.frombuffer(y, "<u4").astype(np.int64))
                if t and ok else None for t, x, y, ok in zip(texts, a, b, same)]

    def align(self, texts: list[str | None]):
        """For all texts together: which have tokens, ids, groups, and the groups of each text.

        The texts lie one behind the other, and the end of a text is an end of both lists.
        """
        found = self.tokens(texts)
        some = [i for i, f in enumerate(found) if f is not None]
        a_ids, b_ids = (np.concatenate([found[i][k] for i in some]) if some else
                        np.zeros(0, np.int64) for k in (0, 1))
        of_a, of_b = groups(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]))
        a_stop = np.cumsum([len(found[i][0]) for i in some], dtype=np.int64)
        stop = of_a[a_stop - 1] + 1 if some else a_stop
        return some, a_ids, b_ids, of_a, of_b, a_stop, stop

    def spelled(self, a_ids, b_ids, of_a, of_b, stop) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        out = np.empty(len(a_ids) + len(b_ids), object)
        for ids, of, ends, shift, names in (
                (a_ids, of_a, end_a, end_b - n_b, self.a_names), (b_ids, of_b, end_b, end_a, self.b_names)):
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            text = names[0][ids]
            text[last] = names[1][ids[last]]
            out[np.arange(len(ids)) + shift[of]] = text
        ends = (end_a + end_b)[stop - 1].tolist()
        return ["".join(out[b:e])[:-1] for b, e in zip([0, *ends], ends)]


_aligners: dict = {}


def _aligner(path: str, model: bytes) -> Aligner:
    """The worker's aligner, made once per process."""
    key = (path, model)
    if key not in _aligners:
        _aligners[key] = Aligner(path, model)
    return _aligners[key]


def _models(docs: DataFrame, path, model_path):
    with open(model_path or piece_codec.default_path(), "rb") as f:
        data = f.read()
    return path or bpe_ids.default_path(), docs.sparkSession.sparkContext.broadcast(data)


def align_documents(docs: DataFrame, path: str | None = None,
                    model_path: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids (unsigned 32-bit little-endian), a_sizes and b_sizes (tokens of each
    group, in order) of every row of ``docs``.

    A space and the text are encoded by a byte-level vocabulary (``path``), the text by a
    sentence-piece model that adds the space (``model_path``), both without special tokens. A
    group ends where a token of both ends. Texts that are null, empty, or not the bytes of their
    tokens (say, with the blank marker in them) have no tokens. Repeated rows are aligned again;
    a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    path, model = _models(docs, path, model_path)

    def run(cols):
        own = _aligner(path, model.value)
        some, a_ids, b_ids, of_a, of_b, a_stop, stop = own.align(cols["text"])
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        end_a, end_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        empty = np.zeros(0, np.int64)
        out = {"doc_id": cols["doc_id"], "a_ids": [b""] * len(cols["text"]),
               "b_ids": [b""] * len(cols["text"]), "a_sizes": [empty] * len(cols["text"]),
               "b_sizes": [empty] * len(cols["text"])}
        for i, b, e in zip(some, [0, *stop.tolist()], stop.tolist()):
            out["a_ids"][i] = a_ids[end_a[b] : end_a[e]].astype("<u4").tobytes()
            out["b_ids"][i] = b_ids[end_b[b] : end_b[e]].astype("<u4").tobytes()
            out["a_sizes"][i], out["b_sizes"][i] = n_a[b:e], n_b[b:e]
        return out

    return frames.map_slices(docs.select("doc_id", "text"), run,
                             "doc_id long, a_ids binary, b_ids binary, a_sizes array<int>, "
                             "b_sizes array<int>")


def link_documents(docs: DataFrame, path: str | None = None,
                   model_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the linked pairs of ids with how
    often each is linked (pairs array<long>, times array<long>) of every row of ``docs``.

    A pair is the id of the first tokenizer times 2**32 plus that of the second. Every token of a
    group is linked with every token of the other tokenizer in it. A task holds the distinct pairs
    of a document. Odd rows are as in ``align_documents``; without tokens the hash is ''.
    """
    path, model = _models(docs, path, model_path)

    def run(cols):
        own = _aligner(path, model.value)
        texts = cols["text"]
        some, a_ids, b_ids, of_a, of_b, a_stop, stop = own.align(texts)
        zeros = [0] * len(texts)
        out = {"doc_id": cols["doc_id"], "n_a": zeros, "n_b": list(zeros), "n_groups": list(zeros),
               "n_links": list(zeros), "groups_sha256": [""] * len(texts),
               "pairs": [[]] * len(texts), "times": [[]] * len(texts)}
        if not some:
            return out
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        groups_of = np.diff(stop, prepend=0)
        doc, pair, times = links(a_ids, b_ids, of_a, of_b, np.repeat(np.arange(len(some)), groups_of))
        at = np.searchsorted(doc, np.arange(len(some) + 1))
        begin = stop - groups_of
        sums = [np.add.reduceat(x, begin).tolist() for x in (n_a, n_b, n_a * n_b)]
        spelled = own.spelled(a_ids, b_ids, of_a, of_b, stop)
        for k, i in enumerate(some):
            out["n_a"][i], out["n_b"][i], out["n_links"][i] = (s[k] for s in sums)
            out["n_groups"][i] = int(groups_of[k])
            out["groups_sha256"][i] = hashlib.sha256(spelled[k].encode()).hexdigest()
            out["pairs"][i], out["times"][i] = pair[at[k] : at[k + 1]], times[at[k] : at[k + 1]]
        return out

    return frames.map_slices(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<long>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n (rows of ``linked`` that hold it) and best (no pair of the same first id is in more).

    Counts are combined before they are shuffled, and a first id has no more pairs than the second
    vocabulary has ids.
    """
    counts = written(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", first).join(most, "first").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, limit: int) -> int:
    """The least count from which there are ``limit`` pairs at most, as far as a histogram with
    16 steps to each power of two tells. Its rows, about a thousand at most, come to the driver."""
    step = F.floor(F.log2("n") * 16).alias("step")
    steps = counts.groupBy(step).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).collect()
    least, held = None, 0
    for row in sorted(steps, key=lambda r: -r.step):
        held += row.pairs
        if held > limit:
            break
        least = row.n
    return (1 << 62) if least is None else least


def with_counts(linked: DataFrame, counts: DataFrame, limit: int | None = None) -> DataFrame:
    """row, n_best and count_sum of ``linked`` (row, pairs, times): links whose pair is the best of
    its first id, and the sum of the counts over all links.

    The most frequent pairs are sent to every task and summed there, a row at a time; the others
    are joined, so no key of the join is frequent.
    """
    least = frequent_from(counts, SENT_PAIRS if limit is None else limit)
    spread = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(
        "row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    sent = F.broadcast(counts.where(F.col("n") >= least))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    near = spread.join(sent, "pair").groupBy("row").agg(*sums)
    far = spread.join(sent.select("pair"), "pair", "left_anti").join(
        counts.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
    return near.union(far).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op13_alignment(spark, sf: str) -> DataFrame:
    """All documents: tokens, groups, links, and how common their links are in the corpus."""
    linked = written(link_documents(frames.documents(spark, sf)).withColumn(
        "row", F.monotonically_increasing_id()), "linked")
    counts = written(pair_counts(linked), "pairs")
    rows = linked.drop("pairs", "times").join(with_counts(linked, counts), "row", "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256")
