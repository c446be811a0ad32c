"""Orphan references, packed fields and connected components, against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrail.operators import orphans, packed
from vitrail.operators.components import connected_components

REF = "ref string, name string, ts timestamp, _key string, period_ym string"


def reference(spark, refs, targets, heavy=1000):
    df = spark.createDataFrame(refs, "ref string, name string, ts string, _key string, period_ym string").withColumn("ts", F.col("ts").cast("timestamp"))
    t = spark.createDataFrame(targets, "k string, _key string")
    return orphans.Reference("t", df, orphans.ascii_path_key(F.col("ref")), F.col("name"), orphans.month(F.col("ts")), t, orphans.ascii_path_key(F.col("k")))


def test_orphans_by_definition(spark):
    refs = [
        ("A\\b", "1", "2024-01-05 00:00:00", "x", "y"),
        ("a/B", "2", "2024-01-06 00:00:00", "x", "y"),
        ("É", "3", "2024-02-01 00:00:00", "x", "y"),
        (None, "4", "2024-02-01 00:00:00", "x", "y"),
        ("  ", "5", "2024-02-01 00:00:00", "x", "y"),
        ("gone", "6", "2024-03-01 00:00:00", "x", "y"),
        ("gone", "6", "2024-03-02 00:00:00", "x", "y"),
        ("GONE", "7", None, "x", "y"),
    ]
    ref = reference(spark, refs, [("a/b", "q"), ("é", "q"), (None, "q")])
    assert rows(orphans.orphan_records([ref])) == [("t", "3", "2024-02"), ("t", "6", "2024-03"), ("t", "7", None)]
    assert rows(orphans.orphan_counts([ref])) == sorted([("t", "2024-02", 1, 1), ("t", "2024-03", 2, 1), ("t", None, 1, 1)], key=str)


@pytest.mark.parametrize("present", [True, False])
def test_orphans_heavy_key(spark, present):
    refs = [("hot", str(i), "2024-01-01 00:00:00", "", "") for i in range(300)] + [(f"k{i}", f"n{i}", "2024-01-01 00:00:00", "", "") for i in range(600)]
    targets = [(f"k{i}", "") for i in range(0, 600, 2)] + ([("hot", "")] * 50 if present else [])
    ref = reference(spark, refs, targets)
    found = {r[1] for r in rows(orphans.orphan_records([ref], heavy_share=10))}
    expected = {f"n{i}" for i in range(1, 600, 2)} | (set() if present else {str(i) for i in range(300)})
    assert found == expected
    assert rows(orphans.orphan_counts([ref], heavy_share=10)) == [("t", "2024-01", len(expected), 300 + (not present))]


def test_orphans_empty_tables(spark):
    some = [("a", "1", "2024-01-01 00:00:00", "", "")]
    assert rows(orphans.orphan_records([reference(spark, some, [])])) == [("t", "1", "2024-01")]
    assert rows(orphans.orphan_records([reference(spark, [], [("a", "")])])) == []
    assert rows(orphans.orphan_counts([reference(spark, [], [])])) == []


CASES = {
    '"24"" x 24""", “floor|wall”': ['24" x 24"', "floor|wall"],
    "['size 30,5 x 61', 'slate']": ["size 30,5 x 61", "slate"],
    '["12\\" slab", "A; B side"]': ['12" slab', "A; B side"],
    "wet\\, then dry; b": ["wet, then dry", "b"],
    "mason's mark, 'x, y', z,": ["mason's mark", "x, y", "z"],
    '""': [],
    "[]": [],
    ", ,": [],
    "a||b": ["a", "b"],
    "a ;b , ;c": ["a", "b", "c"],
    "x\r\ny\tz": ["x", "y", "z"],
    "black/white": ["black/white"],
    "'open, y": ["'open", "y"],
    "a、b；c，d": ["a", "b", "c", "d"],
    "dup, dup, Dup": ["dup", "dup", "Dup"],
    " ": [],
}


@pytest.mark.parametrize("field,expected", CASES.items())
def test_packed_grammar(field, expected):
    assert packed.Segmenter([]).split(field) == expected


def test_packed_dictionary_protects_known_values():
    s = packed.Segmenter(["orvelle, upper town", "marble", "polished", "marble, polished"])
    assert s.split("Orvelle, Upper Town, marble, polished") == ["Orvelle, Upper Town", "marble", "polished"]
    assert s.split("x | Orvelle, upper town | y") == ["x", "Orvelle, upper town", "y"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;|\"'\\é[]", min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6), st.sampled_from([",", "; ", " | "]))
def test_packed_round_trip(values, delimiter):
    quoted = delimiter.join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)
    assert packed.Segmenter([]).split(quoted) == values


def test_packed_table(spark):
    df = spark.createDataFrame([(1, "a, b", "x"), (1, "a, b", "x"), (2, None, "y"), (3, "", "z"), (None, "c", "z"), (4, "k" * 100_000 + ",k", "q")], "id bigint, text string, keyword string")
    got = packed.split_packed(df, "id", "text")
    assert got.columns == ["id", "pos", "keyword"]
    assert rows(got.where("id < 4")) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert rows(got.where("id is null")) == [(None, 1, "c")]
    assert [len(r[2]) for r in rows(got.where("id = 4").orderBy("pos"))] == [100_000, 1]
    assert rows(packed.split_packed(df.limit(0), "id", "text")) == []


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in root if find(v) != v}


@pytest.mark.parametrize("kind", ["chain", "random", "star"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(150)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(160)],
        "star": [(500, i) for i in range(200)] + [(900, 901)],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7), edges[0]], "a bigint, b bigint")
    assert set(rows(connected_components(df))) == brute_components([e for e in edges if e[0] != e[1]])
    assert set(rows(connected_components(df, edges_per_task=40))) == brute_components([e for e in edges if e[0] != e[1]])


def test_components_empty(spark):
    assert rows(connected_components(spark.createDataFrame([], "a bigint, b bigint"))) == []


@pytest.mark.parametrize("max_entries", [1000, 1])
def test_known_values_are_kept_whole_by_broadcast_or_join(spark, max_entries):
    """Fields that only the cover can solve: a known value with a delimiter stands bare among others."""
    fields = ['"upper town, orvelle"'] * 3 + ["upper town, orvelle", "slate; Upper town, Orvelle; wet", "upper town; orvelle", 'x, "upper town, orvelle"']
    fields += [w for w in ("slate", "marble", "granite", "onyx") for _ in range(9)] + ['"marble, onyx"'] * 3 + ["marble, onyx", None, "", "  "]
    df = spark.createDataFrame(list(enumerate(fields)), "id int, text string")
    got = {}
    for i, pos, word in rows(packed.split_packed(df, "id", "text", max_entries=max_entries)):
        got.setdefault(i, []).append((pos, word))
    words = {i: [w for _, w in sorted(v)] for i, v in got.items()}
    assert words[3] == ["upper town, orvelle"] and words[4] == ["slate", "Upper town, Orvelle", "wet"]
    assert words[5] == ["upper town", "orvelle"] and words[6] == ["x", "upper town, orvelle"]
    assert words[len(fields) - 4] == ["marble", "onyx"] and not {len(fields) - k for k in (1, 2, 3)} & set(words)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ,;|\n•x", max_size=14))
def test_pieces_of_plain_fields_equal_the_scanner(text):
    assert [(v, c) for v, _, c in packed.pieces(text)] == [(v, c) for v, _, c in packed.atoms(text)]
    assert packed.Segmenter([]).split(text) == [v for v, *_ in packed.atoms(text) if v]
