"""Aligned tokens against both libraries and a plain alignment, on odd rows too."""

import collections
import hashlib
import random

import numpy as np
import pytest

from raingrid.llm import alignment, bpe_ids, piece_codec

SCHEMA = "doc_id long, text string, row long, pair long, n long, best boolean, pairs string"
LONG = " ".join(f"word{i % 977}, naïve{i % 31}" for i in range(6_000))
ODD = [
    (1, "The same text, twice."), (1, "The same text, twice."), (2, None), (3, ""), (4, " \n\t "),
    (5, LONG), (None, "a row without an id"), (7, "x" * 5000), (8, "é ß 日本語 \x07\x1c 🎉 İ\n\n  two  blanks\r\n"),
    (9, "the blank marker ▁ is no blank"), (10, "<|endoftext|> and <s> and <0x41> are text"), (11, " "),
    (12, "a"), (13, "日本語の文章です。" * 50), (14, "🎉🎊" * 40 + "é" * 20), (15, "\n"), (16, "tail "),
    (17, "0123456789 3.14 x1y2"), (18, "\x00 null byte"), (None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, True, "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe_ids.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_path())


@pytest.fixture(scope="module")
def plain(libraries):
    tok, sp = libraries
    letters = {c: b for b, c in bpe_ids._alphabet().items()}

    def piece_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in tok.id_to_token(i)))
             for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece_bytes(i)) for i in sp.encode(text)]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], []
        return a, b

    def one(text):
        a, b = tokens(text)
        out, i, j = [], 0, 0
        while i < len(a):
            ga, gb, ea, eb = [], [], 0, 0
            while not ga or ea != eb:
                if ea <= eb:
                    ga.append(a[i][0])
                    ea, i = ea + len(a[i][1]), i + 1
                else:
                    gb.append(b[j][0])
                    eb, j = eb + len(b[j][1]), j + 1
            out.append((ga, gb))
        return len(a), len(b), out

    def whole(rows):
        made = [(i, *one(t)) for i, t in rows]
        linked = [collections.Counter((x, y) for ga, gb in g for x in ga for y in gb)
                  for *_, g in made]
        counts = collections.Counter(p for c in linked for p in c)
        most = collections.defaultdict(int)
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        out = []
        for (i, n_a, n_b, g), c in zip(made, linked):
            text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g)
            out.append((i, n_a, n_b, len(g), sum(c.values()),
                        sum(k for p, k in c.items() if counts[p] == most[p[0]]),
                        sum(k * counts[p] for p, k in c.items()),
                        hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return sorted(out, key=str)

    return whole


def run(spark, docs, limit=None):
    from pyspark.sql import functions as F

    from raingrid.session import written

    linked = written(alignment.link_documents(docs).withColumn(
        "row", F.monotonically_increasing_id()), "test-linked")
    sums = alignment.with_counts(linked, written(alignment.pair_counts(linked), "test-pairs"), limit)
    rows = linked.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)),
        F.coalesce("count_sum", F.lit(0)), "groups_sha256")
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("limit", [None, 0, 50])
def test_odd_rows_equal_a_plain_alignment(spark, plain, limit):
    assert run(spark, frame(spark, ODD), limit) == plain(ODD)


def test_query_equals_a_plain_alignment(spark, plain):
    from raingrid.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op13_alignment"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_table(spark):
    none = frame(spark, ODD).where("doc_id > 500")
    assert run(spark, none) == []
    assert alignment.align_documents(none).count() == 0


def test_groups_of_documents_add_up(spark):
    for r in alignment.align_documents(frame(spark, ODD)).collect():
        assert sum(r.a_sizes) == len(r.a_ids) // 4 and sum(r.b_sizes) == len(r.b_ids) // 4
        assert len(r.a_sizes) == len(r.b_sizes)


def ends(rng, n, last):
    return np.array(sorted(rng.sample(range(1, last), n)) + [last], np.int64)


def test_pieces_equal_the_whole_merge():
    rng = random.Random(3)
    for _ in range(300):
        last = rng.randrange(2, 60)
        a, b = (ends(rng, rng.randrange(last - 1), last) for _ in "ab")
        starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b))
                if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]
        common = sorted(set(a.tolist()) & set(b.tolist()))
        for piece in (1, 2, 3, 7, 1000):
            cuts = alignment.diagonals(a, b, piece)
            assert all(y[0] - x[0] + y[1] - x[1] <= piece + 1 for x, y in zip(cuts, cuts[1:]))
            got = [(i, j) for x, y in zip(cuts, cuts[1:])
                   for i, j in zip(*map(list, alignment.overlaps(a, b, x, y)[:2]))]
            assert got == want
            of_a, of_b = alignment.groups(a, b, piece)
            assert of_a.tolist() == np.searchsorted(common, a).tolist()
            assert of_b.tolist() == np.searchsorted(common, b).tolist()


def test_links_in_blocks_equal_all_links():
    rng = np.random.default_rng(1)
    for limit in (1, 5, 40, 10**6):
        of_a, of_b = (np.sort(np.concatenate([np.arange(30), rng.integers(0, 30, n)])) for n in (80, 50))
        a_ids, b_ids = rng.integers(0, 6, len(of_a)), rng.integers(0, 5, len(of_b))
        doc = np.sort(rng.integers(0, 4, 30))
        want = collections.Counter(
            (doc[g], (int(x) << 32) | int(y)) for g in range(30)
            for x in a_ids[of_a == g] for y in b_ids[of_b == g])
        got = alignment.links(a_ids, b_ids, of_a, of_b, doc, limit)
        assert {(d, p): n for d, p, n in zip(*map(np.ndarray.tolist, got))} == want
