"""Language identification by rank-order profiles (out-of-place distance).

A profile is a language's most frequent n-grams of one to three characters, in falling order.
A text is the language whose profile has the n-grams of the text's own profile at the most
similar places.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames

#: N-grams in a language profile, and of a text that are compared.
PROFILE, TEXT_GRAMS = 400, 300
ORDERS = (1, 2, 3)
_BITS = np.uint64(21)  # of a code point; three of them make one exact 63-bit key


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case letters with one blank (32) for every run of other characters, and around."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.empty(len(codes) + 2, np.uint32)
    folded[0] = folded[-1] = 32
    folded[1:-1] = _letters()[codes]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    return folded[keep]


def grams(codes: np.ndarray):
    """Keys of all n-grams: code points side by side, one array per order. No lone blanks."""
    wide = codes.astype(np.uint64)
    yield wide[wide != 32]
    two = (wide[:-1] << _BITS) | wide[1:]
    yield two
    if len(wide) > 2:
        three = (two[:-1] << _BITS) | wide[2:]
        yield three[wide[1:-1] != 32]  # not across two words


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-gram counts of every language over all its texts.

    Tasks count slices of about a megabyte; sums over slices are combined before the shuffle.
    """

    def run(batches):
        for batch in batches:
            for part in frames.slices(batch):
                texts = part.column(0).to_pylist()
                of: dict[str, list] = {}
                for lang, text in zip(part.column(1).to_pylist(), texts):
                    of.setdefault(lang, []).append(text or "")
                for lang, some in of.items():
                    for found, n in counted_grams(letters(" ".join(some))):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(found), pa.string()),
                             pa.array(found.astype(np.int64), pa.int64()),
                             pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = frames.map_batches(docs.select("text", "lang"), run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def counted_grams(codes: np.ndarray):
    """Distinct n-gram keys and their counts, one pair of arrays per order."""
    used = np.flatnonzero(np.bincount(codes))
    w = len(used)
    if w > 128:  # many scripts at once: sort instead of counting in a table
        for keys in grams(codes):
            found, n = np.unique(keys, return_counts=True)
            yield found.astype(np.int64), n.astype(np.int64)
        return
    narrow = np.zeros(int(used[-1]) + 1, np.int64)
    narrow[used] = np.arange(w)
    small, blank = narrow[codes], int(narrow[32])
    index = small
    for order in ORDERS:
        if order > 1:
            index = index[:-1] * w + small[order - 1 :]
        ok = {1: small != blank, 2: None, 3: small[1:-1] != blank}[order] if len(index) else None
        n = np.bincount(index if ok is None else index[ok], minlength=1)
        at = np.flatnonzero(n)
        key = np.zeros(len(at), np.int64)
        for k in range(order - 1, -1, -1):
            key = (key << 21) | used[(at // w**k) % w]
        yield key, n[at]


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams, from rows with a lang; ties by key.

    The counts cover all rows. Only the profiles come to the driver: ``size`` numbers for each
    language.
    """
    from pyspark.sql import Window

    place = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # two steps, so that no task sorts a whole language: first the best of each of 64 lots
    lots = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(
        F.desc("n"), "gram")
    rows = (
        count_grams(docs.where("lang IS NOT NULL"))
        .withColumn("r", F.row_number().over(lots)).where(F.col("r") <= size)
        .withColumn("r", F.row_number().over(place)).where(F.col("r") <= size)
        .select("lang", "gram", "r").collect()
    )
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Classifier:
    """Out-of-place distances of texts to profiles, in numpy."""

    def __init__(self, profiles: dict[str, list[int]], text_grams: int = TEXT_GRAMS):
        self.langs = sorted(profiles)
        self.most = text_grams
        self.known = np.unique(np.array(
            sorted({g for p in profiles.values() for g in p}), np.uint64))
        self.size = max((len(p) for p in profiles.values()), default=0)
        self.ranks = np.full((len(self.langs), len(self.known) + 1), self.size, np.int32)
        for i, lang in enumerate(self.langs):
            at = np.searchsorted(self.known, np.array(profiles[lang], np.uint64))
            self.ranks[i, at] = np.arange(len(at))

    def profile_of(self, codes: np.ndarray) -> np.ndarray:
        """A text's own most frequent n-grams, in falling order; ties by key, as in a profile."""
        keys, n = np.unique(np.concatenate(list(grams(codes))), return_counts=True)
        return keys[np.argsort(-n, kind="stable")[: self.most]]

    def classify(self, texts: list[str | None]):
        """(lang, score) per text. The score is 0..1: how far the nearest profile's distance
        lies below the mean of all; 1 if it is 0, 0 if no n-gram is known."""
        return [self._one(letters(t or "")) for t in texts]

    def _one(self, codes):
        if len(codes) <= 1 or not self.langs:
            return "und", 0.0
        own = self.profile_of(codes)
        slot = np.searchsorted(self.known, own)
        slot[slot == len(self.known)] = 0
        found = self.known[slot] == own if len(self.known) else np.zeros(len(own), bool)
        slot = np.where(found, slot, len(self.known))  # the last place stands for all others
        distance = np.abs(self.ranks[:, slot] - np.arange(len(own))).sum(1)
        best = int(distance.argmin())
        if not found.any():
            return self.langs[best], 0.0
        near = float(distance[best])
        if len(self.langs) == 1:
            return self.langs[0], 1 - min(1.0, near / (len(own) * max(self.size, 1)))
        rest = float(distance.sum() - near) / (len(self.langs) - 1)
        return self.langs[best], min(1.0, max(0.0, 1 - near / max(rest, 1e-12)))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone.

    A null or letterless text is ``und`` with score 0, as is every text without profiles; a text
    none of whose n-grams is in a profile gets the first language with score 0. Equal distances
    go to the first language in order of name. Of n-grams that a text holds equally often, those
    with the smaller key come first, in texts as in profiles. Repeated rows are answered again; a null doc_id
    stays null; other columns are ignored, whatever their names.
    """
    made = []

    def run(cols):
        if not made:
            made.append(Classifier(profiles))
        got = made[0].classify(cols["text"])
        return {"doc_id": cols["doc_id"], "lang_pred": [g[0] for g in got],
                "score": [g[1] for g in got]}

    return frames.map_slices(docs.select("doc_id", "text"), run,
                             "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf: str) -> DataFrame:
    """Profiles from two thirds of the documents, predictions for all."""
    docs = frames.documents(spark, sf)
    profiles = learn_profiles(docs.where(frames.remainder("doc_id", 3) != 1))
    return identify(docs, profiles).select(
        "doc_id", (frames.remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
