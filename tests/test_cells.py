"""Cell tables of FIXTURES.md §4: input cell -> expected derived value."""

import pytest
from conftest import one_col

from vitrine.functions import parse as P
from vitrine.functions import tags as TG

D1 = [
    ("['Action', 'Indie']", "Action"),
    ("'Action'", "Action"),
    ("[\"Shoot 'Em Up\"]", "Shoot 'Em Up"),
    ("['A',]", "A"),
    ("[]", None), ("Action", None), ("('A','B')", None), ("{'A': 1}", None), ("[1", None),
    ("['A'] x", None), ("[None, 'A']", None), (None, None),
    # residue cells that are still valid literals (tier 2)
    ("['A'] # note", "A"), ("(['B', 'C'])", "B"), ("[1, 2]", "1"), ("'a' 'b'", "ab"),
    # Java's $ would accept a final line separator; Python rejects the cell
    ("['A']\u2028", None),
]


def test_primary_category(spark):
    df = one_col(spark, [c for c, _ in D1])
    got = [r[0] for r in df.select(P.primary_category("c")).collect()]
    assert got == [e for _, e in D1]


D5_D6 = [
    ("0 - 20000", (0, 20000, 10000), (0, 20000, 10000)),
    ("20,000–50,000", (20000, 50000, 35000), (None, None, None)),
    ("5000", (5000, 5000, 5000), (5000, 5000, 5000)),
    ("20000.0", (20000, 20000, 20000), (None, None, None)),
    ("100 - 200 copies", (None, None, None), (100, 200, 150)),
    ("50 - 20", (50, 20, 35), (50, 20, 35)),
    ("1 - ", (None, None, None), (None, None, None)),
    ("-5", (None, None, None), (None, None, None)),
    ("", (None, None, None), (None, None, None)),
    (None, (None, None, None), (None, None, None)),
    (", - 5", (None, 5, None), (None, 5, None)),
    ("1,000 — 2,000", (1000, 2000, 1500), (None, None, None)),
    ("7−8", (7, 8, 7.5), (None, None, None)),
]


def test_owner_ranges(spark):
    df = one_col(spark, [c for c, _, _ in D5_D6])
    rows = df.select(P.owner_range("c").alias("a"), P.owner_range_prefix("c").alias("b")).collect()
    for (cell, e5, e6), r in zip(D5_D6, rows):
        assert (r.a.low, r.a.high, r.a.mid) == e5, cell
        assert (r.b.low, r.b.high, r.b.mid) == e6, cell


D3 = [(" 12 ", 12.0), ("1e3", 1000.0), ("inf", float("inf")), ("-Infinity", float("-inf")),
      ("NaN", None), ("1d", None), ("1f", None), ("0x10", None), ("1_000", None), ("1,5", None),
      ("True", None), ("", None), (None, None), ("\t7\n", 7.0), (".5", 0.5), ("+3.", 3.0)]


def test_to_number(spark):
    df = one_col(spark, [c for c, _ in D3])
    got = [r[0] for r in df.select(P.to_number("c")).collect()]
    assert got == [e for _, e in D3]


A10 = [
    ("{'FPS': 90076, 'Shooter': 64786}", ["FPS", "Shooter"]),
    ("['FPS','FPS','Indie']", ["FPS", "Indie"]),
    ("FPS, Shooter", ["FPS", "Shooter"]),
    ("2D Platformer", ["D Platformer"]),
    ("{'3D': 5, 'D': 2}", ["D", "D"]),
    ("123", []), ("[]", []), ("(FPS)", []), (None, []),
    ("'Action'", ["Action"]),
    ("[{'tag':'FPS','n':1},{'X':1,'Y':2}]", ["FPS", "X", "Y"]),
    ("[['FPS', 10], []]", ["FPS"]),
    ("FPS (12), RPG [3]", ["FPS", "RPG"]),
    ('["A", null]', ["A"]),
    ("C++, Co-op, 1980s", ["C", "Co-op", "s"]),
    ("{'A': 1, 'A': 2}", ["A"]),
    ("Café été 2, ゲーム", ["Café été", "ゲーム"]),
    ("true", ["True"]),
    ("1e5", []),
]


def test_tag_array(spark):
    df = one_col(spark, [c for c, _ in A10])
    got = [r[0] for r in df.select(TG.tag_array("c")).collect()]
    assert got == [e for _, e in A10]


D14 = [
    ("['A', 'B']", ["A"]), ("('A', 'B')", ["A", "B"]), ("{'A': 1, 'B': 2}", ["A", "B"]),
    ("'A'", ["A"]), ("[]", []), ("()", []), ("Action", []), (None, []), ("5", ["5"]),
    ("[('A', 'B')]", ["A", "B"]), ("[None]", []),
]


def test_genre_list(spark):
    df = one_col(spark, [c for c, _ in D14])
    got = [sorted(r[0]) for r in df.select(P.genre_list("c")).collect()]
    assert got == [sorted(e) for _, e in D14]


@pytest.mark.parametrize("year,label", [(2008, "2008"), (None, "<NA>")])
def test_year_label(spark, year, label):
    df = one_col(spark, [year], "int")
    assert df.select(P.year_label("c")).first()[0] == label


def test_range_label_and_free(spark):
    df = spark.createDataFrame([(1000.7, 20000.0, 0.0), (None, 5.0, None)],
                               "lo double, hi double, price double")
    rows = df.select(P.range_label("lo", "hi"), P.is_free("price")).collect()
    assert [tuple(r) for r in rows] == [("1,000 - 20,000", True), ("", False)]


def test_release_year_strict_format(spark):
    df = one_col(spark, ["2008-10-21", "Oct 21, 2008", None, "2014"])
    got = [r[0] for r in df.select(P.release_year("c")).collect()]
    assert got == [2008, None, None, None]
