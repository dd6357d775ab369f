"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Node scores are linear in features of the line and of its two
neighbours, and a 2 x 2 table scores the step from line to line. The marginals of
forward-backward, weighted by line length, give a share of good text, which a logistic curve
turns into the probability that the document is good.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames, textscan
from raingrid.session import written

#: Labelled documents that are learned from, at most, and lines and characters of them.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_CHARS = 6_000, 60_000, 12_000_000

_CLASS = np.zeros((5, 256), np.int32)
_CLASS[0, list(b"#*$%&|<>")] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, 65:91] = _CLASS[3, 97:123] = _CLASS[3, 128:] = 1
_CLASS[4, list(b"!?")] = 1
BASE_FEATURES = 13
FEATURES = 3 * BASE_FEATURES + 1


def _per_line(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[ends] - sums[starts]


def line_features(texts: list[str | None]):
    """Features of all lines of some texts: (features, weights, lines of each text).

    A line is what stands between line feeds; a null or empty text is one empty line. The weight
    is the line's length in bytes, one at least.
    """
    parts = [(t or "").encode() for t in texts]
    data = b"\n".join(parts)
    raw = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], feeds + 1))
    ends = np.concatenate((feeds, [len(raw)]))
    lines = np.array([p.count(b"\n") + 1 for p in parts], np.int64)
    doc = np.repeat(np.arange(len(parts)), lines)
    size = ends - starts

    first, last = textscan.word_spans(raw)
    hashes = textscan.span_hashes(raw, first, last)
    at = np.searchsorted(starts, first, side="right") - 1  # line of every word
    n = np.bincount(at, minlength=len(starts))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[at[1:]] == doc[at[:-1]])
    salted = textscan.mix(hashes + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    triple = textscan.windows(salted, 3)
    again = np.zeros(len(hashes), bool)
    if len(triple):
        _, back, times = np.unique(triple, return_inverse=True, return_counts=True)
        again[: len(triple)] = times[back] > 1
    content = textscan.span_hashes(raw, starts, ends)
    content = textscan.mix(content + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(content, return_inverse=True, return_counts=True)
    repeated = (times[back] > 1) & (n > 0)

    counts = [_per_line(c[raw], starts, ends) for c in _CLASS]
    per_word = np.maximum(n, 1)
    per_byte = np.maximum(size, 1)
    base = np.stack([
        n == 0, np.log1p(n) / 5, counts[0] / per_word, counts[0] > 2, counts[1] / per_byte,
        counts[1] > 0.4 * per_byte, counts[2] / per_byte, counts[3] / per_byte,
        np.minimum(counts[4] / per_word, 1), np.bincount(at[same], minlength=len(n)) / per_word,
        np.bincount(at[again], minlength=len(n)) / per_word, repeated,
        np.minimum(size / per_word / 10, 3),
    ], 1).astype(np.float32)
    base = np.minimum(base, 3)
    before, after = np.zeros_like(base), np.zeros_like(base)
    inner = doc[1:] == doc[:-1]
    before[1:][inner] = base[:-1][inner]
    after[:-1][inner] = base[1:][inner]
    features = np.concatenate([base, before, after, np.ones((len(base), 1), np.float32)], 1)
    return features, per_byte.astype(np.float64), lines


def marginals(node: np.ndarray, step: np.ndarray, lines: np.ndarray):
    """Forward-backward over many chains: P(good) of every line, summed P of every step, log Z.

    ``node`` holds the log score of good over bad for all lines, chain after chain. Chains run
    side by side, longest first, so the loop is as long as the longest chain.
    """
    order = np.argsort(-lines, kind="stable")
    offset = np.concatenate(([0], np.cumsum(lines)[:-1]))[order]
    length = lines[order]
    most = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(most)]
    logs = np.zeros((len(node), 2))
    logs[:, 1] = node
    forward = np.zeros((len(node), 2))
    for t in range(most):
        i = offset[: alive[t]] + t
        forward[i] = logs[i] if t == 0 else logs[i] + np.logaddexp(
            forward[i - 1][:, :1] + step[0], forward[i - 1][:, 1:] + step[1])
    backward = np.zeros((len(node), 2))
    for t in range(most - 2, -1, -1):
        i = offset[: alive[t + 1]] + t
        ahead = logs[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
    both = forward + backward
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    inner = np.ones(len(node), bool)
    inner[np.cumsum(lines) - 1] = False
    i = np.flatnonzero(inner)
    pair = (forward[i][:, :, None] + step + (logs[i + 1] + backward[i + 1])[:, None, :]
            - log_z[i][:, None, None])
    return good, np.exp(pair).sum(0), float(log_z[np.cumsum(lines) - 1].sum()) if len(lines) else 0.0


def _portions(texts, limit: int = frames.SLICE_BYTES):
    """The texts in runs of about ``limit`` characters, so that no large array is needed."""
    held, total = [], 0
    for t in texts:
        if held and total + len(t or "") > limit:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t or "")
    yield held


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str | None], good: list[int], rounds: int = 150, ridge: float = 1.0) -> dict:
    """Weights of the field and of the logistic curve, from document labels.

    Every line takes the label of its document; gradient ascent with a step of its own for each
    weight. Without both labels the result is the share of good documents for all.
    """
    y = np.asarray(good, float)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    features, size, lines = map(np.concatenate, zip(*map(line_features, _portions(texts))))
    label = np.repeat(y, lines)
    weight, step = np.zeros(FEATURES), np.zeros((2, 2))
    inner = np.ones(len(label), bool)
    inner[np.cumsum(lines) - 1] = False
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = ((label == v) & inner).sum()
    rate_w, rate_s = np.full(FEATURES, 0.05), np.full((2, 2), 0.05)
    was_w, was_s = np.zeros(FEATURES), np.zeros((2, 2))
    for _ in range(rounds):
        p, pairs, _ = marginals(features @ weight, step, lines)
        grad_w = features.T @ (label - p) - ridge * weight
        grad_s = seen - pairs - ridge * step
        for x, g, was, rate in ((weight, grad_w, was_w, rate_w), (step, grad_s, was_s, rate_s)):
            rate *= np.where(g * was > 0, 1.2, np.where(g * was < 0, 0.5, 1.0))
            np.clip(rate, 1e-5, 1.0, out=rate)
            x += np.sign(g) * rate
            was[...] = g
    p, _, _ = marginals(features @ weight, step, lines)
    x = _logit(_by_document(p, size, lines))
    x = np.stack([x, np.ones_like(x)], 1)
    curve = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
        curve = curve + np.linalg.solve(hess, x.T @ (y - q) - 0.1 * (curve - [1.0, 0.0]))
    return {"weight": weight, "step": step, "curve": curve}


def _by_document(p, size, lines):
    ends = np.cumsum(lines)
    starts = ends - lines
    return np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)


def scores(texts: list[str | None], model: dict) -> list[float]:
    if not texts:
        return []
    if "constant" in model:
        return [model["constant"]] * len(texts)
    features, size, lines = line_features(texts)
    p, _, _ = marginals(features @ model["weight"], model["step"], lines)
    x = _logit(_by_document(p, size, lines)) * model["curve"][0] + model["curve"][1]
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
          sample_lines: int = SAMPLE_LINES, sample_chars: int = SAMPLE_CHARS) -> dict:
    """Fit on at most ``sample_docs`` labelled documents with ``sample_lines`` lines and
    ``sample_chars`` characters in all.

    Labelled documents are taken in the order of the hash of id and label, each that fits into
    the room that is left; one that does not is passed over, and the search goes on until the
    sample is full or no labelled document fits. All rows of an id are one document here.
    Labels that are null, or whose document is missing, are left out, as are labels without an
    id.
    """
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "quality").agg(
        F.count("*").alias("times"))
    text = F.coalesce("text", F.lit(""))
    measured = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.length(text).alias("chars"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    sizes = written(
        measured.join(given, "doc_id").groupBy("doc_id", "quality", "times").agg(
            *[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("lines", "chars")],
            F.sum("times").alias("rows"))
        .withColumn("h", F.xxhash64("doc_id", "quality")), "label-sizes")
    room, chosen = [sample_docs, sample_lines, sample_chars], []
    ahead = sizes
    while min(room[:2]) > 0:
        page = (ahead.where((F.col("rows") <= room[0]) & (F.col("lines") <= room[1])
                            & (F.col("chars") <= room[2]))
                .orderBy("h", "doc_id", "quality").limit(sample_docs).collect())
        for r in page:
            need = (r.rows, r.lines, r.chars)
            if all(n <= left for n, left in zip(need, room)):
                room = [left - n for n, left in zip(need, room)]
                chosen.append(r)
        if len(page) < sample_docs:
            break
        h, doc_id, quality = (F.lit(page[-1][c]) for c in ("h", "doc_id", "quality"))
        same = (F.col("h") == h) & (
            (F.col("doc_id") > doc_id) | ((F.col("doc_id") == doc_id) & (F.col("quality") > quality)))
        ahead = sizes.where((F.col("h") > h) | same)
    if not chosen:
        return {"constant": 0.5}
    wanted = docs.sparkSession.createDataFrame(
        [(r.doc_id, r.quality, r.times, r.h) for r in chosen],
        sizes.select(F.col("doc_id").alias("label_id"), "quality", "times", "h").schema)
    got = (docs.select("doc_id", "text")
           .join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))  # sample_docs rows
           .select("h", "doc_id", "text", F.col("quality").cast("int").alias("quality"), "times").collect())
    got = [r for r in got for _ in range(r.times)]
    got.sort(key=lambda r: (r.h, r.doc_id, r.text or ""))
    return fit([r.text for r in got], [r.quality for r in got])


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0..1, higher is better) of every row, from its text alone.

    A null or empty text is one empty line and is scored as such. Repeated rows are answered
    again; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    return frames.map_slices(
        docs.select("doc_id", "text"),
        lambda cols: {"doc_id": cols["doc_id"], "score": scores(cols["text"], model)},
        "doc_id long, score double")


def op9_line_quality(spark, sf: str) -> DataFrame:
    """Learned from labels of documents outside fold 0 of 5, scores for all documents."""
    docs = frames.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = learn(docs, labels.where(frames.remainder("doc_id", 5) != 0))
    return score_documents(docs, model).select(
        "doc_id", (frames.remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
