"""Shared lines against a plain version, and on odd rows."""

import collections

import pytest

from raingrid.llm import line_dedup

SCHEMA = ("doc_id long, text string, lang string, h1 long, h2 long, pos int, gone array<int>, "
          "text_key long, lines int, keeper long")
BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
A = "This license line is shared by very many documents."
B = "Ünïcode ÄÖÜ lines keep their capital umlauts, but not A-Z ones"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", 1, 2, 3, [0], 5, 6, 7) for i, t in rows], SCHEMA)


def key_of(line):
    return line.strip(BLANKS).translate(UPPER)


def plain(rows, least_chars=40, least_docs=5):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            found = holders.get(key_of(line), set())
            if len(found) < least_docs or i == max(x for x in found if x is not None):
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(spark, rows, **limits):
    got = line_dedup.drop_common_lines(frame(spark, rows), **limits).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, **limits)


def test_lines_equal_a_plain_version(spark):
    rows = [(i, f"own line {i}\n  {A.upper() if i % 2 else A}\t\r\n{A}\n{B}\nend" if i < 6 else
             f"{A}\n\n{B} \n{B.upper()}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n"), (23, "\n\n" + A), (24, A), (24, A), (None, A),
             (None, "no id\n" + B), (25, "short\n" * 5000 + A), (26, "x" * 100_000)]
    check(spark, rows)


def test_limits_and_ties(spark):
    four = [(i, A) for i in range(4)]
    check(spark, four)
    check(spark, [*four, *four, (3, A + "\n" + A)])  # repeated rows are no further documents
    check(spark, [*four, (None, A), (None, A)])  # rows without an id are one
    check(spark, [(i, "y" * 39) for i in range(6)])
    check(spark, [(i, "é" * 39) for i in range(6)])  # code points, not bytes
    check(spark, [(i, "é" * 40) for i in range(6)])
    check(spark, [(-i, "abc\nABC") for i in range(6)], least_chars=3, least_docs=2)


def test_frequent_and_rare_lines_take_the_same_way(spark, monkeypatch):
    rows = [(i, "\n".join([A, f"{B} {i % 7}", f"{B} {i % 3} again"])) for i in range(40)]
    check(spark, rows)
    monkeypatch.setattr(line_dedup, "HOT_PARTS", 0)  # every line in the shuffled join
    check(spark, rows)


def test_empty_table(spark):
    got = line_dedup.drop_common_lines(frame(spark, [(1, A)]).where("doc_id > 5"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert got.count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_its_sql(spark, sf):
    import check as checker

    from raingrid.llm import queries

    _, notes = checker.differences(queries.QUERIES["op11_line_dedup"](spark, sf),
                                   checker.connect(sf), queries.SQL["op11_line_dedup"])
    assert notes == []


def test_main_path_is_native(spark):
    plan = line_dedup.drop_common_lines(frame(spark, [(1, A)]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
