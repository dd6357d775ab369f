"""The prefix trie against a plain one, whole and in small shards, and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from raingrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, shard long, depth int, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "k") for r in rows], SCHEMA)


def key_of(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain_sequences(rows):
    """Turns (role, text) of every conversation, in order."""
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, key_of(role, text), role or "", text or ""))
    return {c: [t[3:] for t in sorted(x)] for c, x in held.items()}


def plain_rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def plain_trie(seqs):
    members = collections.defaultdict(list)
    for c, seq in sorted(seqs.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((
        m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()) if seqs else []


def digest(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def order(row):
    return str(row)


def conversations(rng, n, like):
    """Conversations with common heads, exact copies, prefixes of each other and hot first turns."""
    rows = []
    for c in range(n):
        if like and c % 3 == 0:
            turns = ["hello", "copy", "of", "one"][: rng.choice([1, 2, 4, 4, 4])]
        else:
            turns = [rng.choice(["hello", "hé", "ciao"])] + [
                rng.choice("abc") for _ in range(rng.randrange(7))]
        rows += [(c, t, "user" if t % 2 else "bot", x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


ODD = [(1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "a", "y"), (2, 5, "", ""),
       (2, 6, "u", "x" * 50_000), (None, 0, "u", "no id"), (3, 0, None, ""), (-7, 0, "u", "x"),
       (-207, 0, "ab", "c"), (-207, 1, "a", "bc"), (100, 0, "u", "only one"), (101, 0, "u", "1"),
       *[(150, t, "u", f"turn {t % 2}") for t in range(300)], *[(151, t, "u", f"turn {t % 2}") for t in range(280)]]


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_trie_equals_a_plain_one(spark, shard):
    for rows in (conversations(random.Random(4), 60, True), ODD):
        got = digest(prefix_trie.prefix_trie(frame(spark, rows), shard))
        want = plain_trie(plain_sequences(rows))
        assert sorted(got, key=order) == sorted(want, key=order)


def test_shard_turns_bound_a_shard(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 9)
    rows = conversations(random.Random(5), 40, True)
    got = digest(prefix_trie.prefix_trie(frame(spark, rows)))
    assert sorted(got, key=order) == sorted(plain_trie(plain_sequences(rows)), key=order)


def test_parents_with_many_and_few_children_take_the_same_way(spark, monkeypatch):
    rows = conversations(random.Random(6), 80, False)
    want = sorted(plain_trie(plain_sequences(rows)), key=order)
    for parts in (1, 20, 10**6):
        monkeypatch.setattr(prefix_trie, "HOT_PARTS", parts)
        got = digest(prefix_trie.prefix_trie(frame(spark, rows), 5))
        assert sorted(got, key=order) == want


def test_rebuilt_conversations(spark):
    rows = [r for r in ODD if r[0] != -207] + conversations(random.Random(7), 230, True)
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(frame(spark, rows)))
    want = plain_trie(plain_rebuilt(plain_sequences(rows)))
    assert sorted(digest(prefix_trie.trie(seqs, 16)), key=order) == sorted(want, key=order)


def test_empty_table(spark):
    got = prefix_trie.prefix_trie(frame(spark, ODD[:1]).where("turn = 9"))
    assert got.count() == 0
    assert set(COLUMNS) <= set(got.columns)


def test_query_equals_its_sql(spark):
    import check as checker

    from raingrid.llm import queries

    sf = "/root/testdata/sf0.001"
    _, notes = checker.differences(queries.QUERIES["op12_prefix_trie"](spark, sf),
                                   checker.connect(sf), queries.SQL["op12_prefix_trie"])
    assert notes == []
