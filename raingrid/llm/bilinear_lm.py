"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The model predicts a unit from the two before it. Units are the end mark, the most frequent
words, and classes of all other words by their last two bytes; inside a class a word has its
smoothed share of the class. A unit's score is a sum over the context positions of a product of
vectors, so the scores of all units after all pairs of units come from two unit-by-unit tables,
and one matrix product of their exponentials gives every normaliser: token probabilities are
exact and add up to one over units.

Words are known by 64-bit hashes. Counts cover all training texts; the words outside a bounded
list of frequent ones meet their counts in a join. Every task trains on all training texts it
holds, and the parameters of the tasks are averaged after each round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames, textscan
from raingrid.session import written

#: Units: the end mark, frequent words, classes of the rest. Words whose counts every task has.
FREQUENT, CLASSES, KNOWN = 640, 383, 1 << 17
UNITS = 1 + FREQUENT + CLASSES
#: Vector length, positions in a batch, noise samples and the positions that share them.
WIDTH, BATCH, NOISE, GROUP = 16, 4096, 25, 128
#: Shares of the training texts and learning rate of every round; together they are all texts.
ROUNDS = ((0, 2, 0.2), (2, 6, 0.1), (6, 16, 0.05))
COUNT_BLOCK = 1 << 21
_END = np.uint64(0)


def _suffix_classes() -> np.ndarray:
    pair = np.arange(65536, dtype=np.uint64)
    return (textscan.mix(pair + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int32)


_CLASS_OF = _suffix_classes()


def words_of(texts: list[str | None]):
    """Hashes and classes of all words of some texts after folding A-Z, and words per text."""
    parts = [(t or "").encode().lower() for t in texts]
    data = b"\n".join(parts)
    raw = np.frombuffer(data, np.uint8)
    starts, ends = textscan.word_spans(raw)
    hashes = textscan.span_hashes(raw, starts, ends) | np.uint64(1)  # 0 is the end mark
    last = raw[ends - 1].astype(np.int32)
    before = np.where(ends - starts > 1, raw[ends - 2], 0).astype(np.int32) if len(ends) else last
    edges = np.cumsum([0] + [len(p) + 1 for p in parts])
    per_text = np.diff(np.searchsorted(starts, edges))
    return hashes, _CLASS_OF[before * 256 + last], per_text


def count_words(docs: DataFrame) -> DataFrame:
    """(word, class, n): how often each word and the end mark (0, class -1) stand in the texts."""
    names = ["word", "class", "n"]

    def batch_of(hashes, classes, texts):
        order = np.argsort(hashes)
        hashes, classes = hashes[order], classes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) \
            if len(hashes) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(hashes)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.append(hashes[first], _END).view(np.int64)),
            pa.array(np.append(classes[first], -1).astype(np.int32)),
            pa.array(np.append(n, texts).astype(np.int64))], names=names)

    def run(batches):
        held, size, texts = [], 0, 0
        for batch in batches:
            for part in frames.slices(batch):
                hashes, classes, _ = words_of(part.column(0).to_pylist())
                held.append((hashes, classes))
                size, texts = size + len(hashes), texts + part.num_rows
                if size >= COUNT_BLOCK:
                    yield batch_of(*map(np.concatenate, zip(*held)), texts)
                    held, size, texts = [], 0, 0
        if texts:
            yield batch_of(*map(np.concatenate, zip(*held)), texts)

    counted = frames.map_batches(docs.select("text"), run, "word long, class int, n long")
    return counted.groupBy("word", "class").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words with their units and counts, and the totals of the classes."""

    def __init__(self, top, totals):
        """``top``: (word, class, n) by falling n; ``totals``: class -> (words, tokens)."""
        self.tokens = sum(n for _, n in totals.values())
        self.distinct = sum(v for v, _ in totals.values())
        words = np.array([w for w, _, _ in top], np.int64).view(np.uint64)
        classes = np.array([c for _, c, _ in top], np.int64)
        n = np.array([n for _, _, n in top], np.int64)
        ends = words == _END
        self.ends = int(n[ends].sum())
        words, classes, n = words[~ends], classes[~ends], n[~ends]
        unit = 1 + FREQUENT + classes
        unit[:FREQUENT] = 1 + np.arange(min(FREQUENT, len(unit)))
        inside, size = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, (v, total) in totals.items():
            if c >= 0:
                size[c], inside[c] = v, total
        np.subtract.at(size, classes[:FREQUENT], 1)
        np.subtract.at(inside, classes[:FREQUENT], n[:FREQUENT])
        self.mass = np.zeros(UNITS)  # tokens of every unit
        self.mass[0] = self.ends
        self.mass[1 : 1 + len(n[:FREQUENT])] = n[:FREQUENT]
        self.mass[1 + FREQUENT :] = inside
        # log10 of what a word's count + 1 is divided by inside its unit; words are their units
        self.inside = np.zeros(UNITS)
        self.inside[1 + FREQUENT :] = np.log10(inside + size + 1)
        order = np.argsort(words)
        self.words, self.unit = words[order], unit[order].astype(np.int32)
        self.log_count = np.log10(n[order] + 1.0)

    def look_up(self, hashes: np.ndarray, classes: np.ndarray):
        """Units of words, and their places in the list of frequent ones (-1: not there)."""
        if not len(self.words):
            return 1 + FREQUENT + classes, np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        at[self.words[at] != hashes] = -1
        return np.where(at >= 0, self.unit[at], 1 + FREQUENT + classes), at


def with_ends(units: np.ndarray, per_text: np.ndarray):
    """Units of all texts with an end mark (0) after each, and where each text begins."""
    out = np.zeros(len(units) + len(per_text), np.int32)
    out[np.arange(len(units)) + np.repeat(np.arange(len(per_text)), per_text)] = units
    begins = np.concatenate(([0], np.cumsum(per_text + 1)[:-1])).astype(np.int64)
    return out, begins


def contexts(units: np.ndarray, begins: np.ndarray):
    """The unit before each unit and the one before that; end marks before a text."""
    one, two = np.zeros_like(units), np.zeros_like(units)
    one[1:], two[2:] = units[:-1], units[:-2]
    two[begins] = 0
    return one, two


def start_model(vocabulary: Vocabulary, width: int = WIDTH, seed: int = 1) -> dict:
    """Small random vectors, and biases that make the model the distribution of units."""
    rng = np.random.default_rng(seed)
    share = (vocabulary.mass + 1) / (vocabulary.mass + 1).sum()
    small = lambda: rng.normal(0, 0.1, (UNITS, width)).astype(np.float32)
    return {"seen": small(), "said": small(), "near": np.ones(width, np.float32),
            "far": np.full(width, 0.5, np.float32), "bias": np.log(share).astype(np.float32)}


class Trainer:
    """Noise-contrastive estimation in batches, with a step size of its own for every weight."""

    def __init__(self, model: dict, noise_share: np.ndarray, rate: float, seed: int):
        self.m = {k: v.copy() for k, v in model.items()}
        self.sums = {k: np.full(v.shape, 1.0, np.float32) for k, v in model.items()}
        self.rate, self.rng = rate, np.random.default_rng(seed)
        self.edges = np.cumsum(noise_share)
        self.log_noise = np.log(NOISE * noise_share).astype(np.float32)
        self.spots = np.arange(model["seen"].shape[1])

    def _spread(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of ``rows`` by unit."""
        width = rows.shape[1]
        flat = (at[:, None] * width + self.spots).ravel()
        return np.bincount(flat, rows.ravel(), UNITS * width).reshape(UNITS, width)

    def learn(self, unit, one, two) -> None:
        m = self.m
        seen_1, seen_2 = m["seen"][one], m["seen"][two]
        hidden = seen_1 * m["near"] + seen_2 * m["far"]
        said = m["said"][unit]
        groups = max(1, len(unit) // GROUP)
        cut = len(unit) - len(unit) % groups
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random((groups, NOISE))), UNITS - 1)
        there = m["said"][noise]  # groups x NOISE x width
        real = (hidden * said).sum(1) + m["bias"][unit] - self.log_noise[unit]
        mine = hidden[:cut].reshape(groups, -1, hidden.shape[1])
        fake = mine @ there.transpose(0, 2, 1) + (m["bias"] - self.log_noise)[noise][:, None, :]
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # of a real unit, to be taken for real
        down = -1 / (1 + np.exp(np.clip(-fake, -30, 30)))
        to_hidden = up[:, None] * said
        to_hidden[:cut] += (down @ there).reshape(cut, -1)
        to_said = self._spread(unit, up[:, None] * hidden) + self._spread(
            noise.ravel(), (down.transpose(0, 2, 1) @ mine).reshape(-1, hidden.shape[1]))
        to_bias = np.bincount(unit, up, UNITS) + np.bincount(
            noise.ravel(), down.sum(1).ravel(), UNITS)
        self._step("near", (to_hidden * seen_1).sum(0))
        self._step("far", (to_hidden * seen_2).sum(0))
        self._step("seen", self._spread(one, to_hidden * m["near"])
                   + self._spread(two, to_hidden * m["far"]))
        self._step("said", to_said)
        self._step("bias", to_bias)

    def _step(self, name: str, gradient: np.ndarray) -> None:
        sums = self.sums[name]
        sums += gradient.astype(np.float32) ** 2
        self.m[name] += (self.rate * gradient / np.sqrt(sums)).astype(np.float32)


_PARTS = ("seen", "said", "near", "far", "bias")


def _flat(model: dict) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in _PARTS]).astype(np.float32)


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in _PARTS:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train_round(docs: DataFrame, vocabulary, model: dict, rate: float) -> dict:
    """Train in every task from ``model`` on its texts; average by tokens, in two steps."""
    share = (vocabulary.value.mass + 1) ** 0.75
    share = share / share.sum()

    def run(batches):
        vocab, trainer, tokens = vocabulary.value, Trainer(model, share, rate, 17), 0
        held, size = [], 0

        def learn(rows):
            for at in range(0, len(rows[0]), BATCH):
                trainer.learn(*(r[at : at + BATCH] for r in rows))

        for batch in batches:
            for part in frames.slices(batch):
                hashes, classes, per_text = words_of(part.column(0).to_pylist())
                units, begins = with_ends(vocab.look_up(hashes, classes)[0], per_text)
                held.append((units, *contexts(units, begins)))
                size, tokens = size + len(units), tokens + len(units)
                if size >= BATCH:
                    learn(list(map(np.concatenate, zip(*held))))
                    held, size = [], 0
        if held:
            learn(list(map(np.concatenate, zip(*held))))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokens], pa.int64()), pa.array([_flat(trainer.m).tobytes()], pa.binary())],
                names=["tokens", "weights"])

    def average(batches):
        total, tokens = None, 0
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data, np.float32).astype(np.float64) * n
                total, tokens = part if total is None else total + part, tokens + n
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokens], pa.int64()),
                 pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())],
                names=["tokens", "weights"])

    schema = "tokens long, weights binary"
    trained = frames.map_batches(docs.select("text"), run, schema)
    few = frames.map_batches(trained.repartition(16), average, schema).collect()  # 16 at most
    if not few:
        return model
    total = sum(r.tokens for r in few)
    mean = sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * r.tokens for r in few) / total
    return _shaped(mean, model)


class Scorer:
    """Unit-by-unit tables and all normalisers of a trained model."""

    def __init__(self, model: dict):
        said = model["said"].T
        self.near = (model["seen"] * model["near"]) @ said + model["bias"]
        self.far = (model["seen"] * model["far"]) @ said
        self.near -= self.near.max(1, keepdims=True)
        self.far -= self.far.max(1, keepdims=True)
        wide = np.exp(self.near.astype(np.float64)) @ np.exp(self.far.astype(np.float64)).T
        self.norm = np.log(wide).astype(np.float32)

    def log10(self, unit, one, two) -> np.ndarray:
        """log10 of the probability of ``unit`` after ``one``, with ``two`` before that."""
        natural = self.near[one, unit] + self.far[two, unit] - self.norm[one, two]
        return natural.astype(np.float64) / math.log(10)


def _least_count(counts: DataFrame, most: int = KNOWN) -> int:
    """A count that at most ``most`` words reach, from a histogram of a few hundred counts."""
    level = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.min("n").alias("least")).collect()
    reached, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r.level):
        reached += r.words
        if reached > most:
            break
        least = r.least
    return least


def learn_model(docs: DataFrame):
    """(counts, broadcast vocabulary, model) from all texts of ``docs``."""
    spark = docs.sparkSession
    counts = written(count_words(docs), "word-counts")
    least = _least_count(counts)
    top = sorted(((r.word, r["class"], r.n) for r in
                  counts.where((F.col("n") >= least) | (F.col("word") == 0)).collect()),
                 key=lambda r: (-r[2], r[0]))  # KNOWN short rows at most, and the end mark
    totals = {r["class"]: (r.v, r.n) for r in counts.groupBy("class").agg(
        F.count("*").alias("v"), F.sum("n").alias("n")).collect()}  # one row per class
    vocabulary = spark.sparkContext.broadcast(Vocabulary(top, totals))
    model = start_model(vocabulary.value)
    lot = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(ROUNDS[-1][1]))
    for low, high, rate in ROUNDS:
        model = train_round(docs.where((lot >= low) & (lot < high)), vocabulary, model, rate)
    return counts, vocabulary, model


def score_texts(docs: DataFrame, learned) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end mark. Without training texts all words are unknown, and the
    base gives each token the same chance. Repeated rows are answered each; a null doc_id stays
    null; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    counts, vocabulary, model = learned
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(model))
    total = vocabulary.value.tokens
    divisor = math.log10(total + vocabulary.value.distinct + 1)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
             pa.float64(), pa.float64()]
    names = ["row", "word", "times", "doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        vocab, table = vocabulary.value, scorer.value
        end_log = math.log10(vocab.ends + 1)
        for batch in batches:
            for part in frames.slices(batch):
                row = np.array(part.column(0).to_pylist(), np.int64)
                hashes, classes, per_text = words_of(part.column(2).to_pylist())
                unit, at = vocab.look_up(hashes, classes)
                units, begins = with_ends(unit, per_text)
                token = np.add.reduceat(table.log10(units, *contexts(units, begins)), begins)
                owner = np.repeat(np.arange(len(row)), per_text)
                listed = at >= 0
                logs = np.where(listed, vocab.log_count[at], 0.0) if len(vocab.words) else np.zeros(len(at))
                base = np.bincount(owner, logs, len(row)) + end_log - (per_text + 1) * divisor
                # a frequent word is its unit; a word of a class has a share of it
                shared = unit > FREQUENT
                inside = np.where(shared, logs - vocab.inside[unit], 0.0)
                score = token + np.bincount(owner, inside, len(row))
                known = np.bincount(owner[listed], minlength=len(row)) + (vocab.ends > 0)
                rare = np.flatnonzero(~listed)
                nulls = [None] * len(rare)
                cols = [
                    np.concatenate([row, row[owner[rare]]]),
                    np.concatenate([textscan.mix(row.view(np.uint64)), hashes[rare]]).view(np.int64),
                    np.concatenate([np.zeros(len(row), np.int64), np.ones(len(rare), np.int64)]),
                    *([*x, *nulls] for x in (part.column(1).to_pylist(), (per_text + 1).tolist(),
                                             known.tolist(), base.tolist(), score.tolist())),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    # The first row of a text carries its own figures under a word that no count adds to.
    rows = frames.map_batches(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), run,
        "row long, word long, times long, doc_id long, n_tokens long, n_known long, "
        "base_score double, score double")
    rare = counts.where("word <> 0").select("word", F.col("n").alias("c"))
    count = F.coalesce("c", F.lit(0))
    return (
        rows.join(rare, "word", "left")
        .groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.sum(F.when(count > 0, F.col("times")).otherwise(0))).alias("n_known"),
            F.max("base_score").alias("b"), F.max("score").alias("s"),
            F.sum(F.col("times") * F.log10(count + 1)).alias("more"))
        .select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                (F.col("b") + F.col("more")).alias("base_score"),
                (F.col("s") + F.col("more")).alias("score"))
    )


def op1_bilinear_lm(spark, sf: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 2 of 7."""
    docs = frames.documents(spark, sf)
    learned = learn_model(docs.where(frames.remainder("doc_id", 7) != 2))
    return score_texts(docs, learned).select(
        "doc_id", (frames.remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")
