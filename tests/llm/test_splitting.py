import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import splitting

LIMIT, OVERLAP = 50, 12


def split(spark, texts, limit=LIMIT, overlap=OVERLAP):
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string").withColumn("pieces", F.lit("clash")).withColumn("seg", F.lit(1)).repartition(2)
    return {r.file_id: r for r in splitting.split_items(df, limit=limit, overlap=overlap).collect()}


def check(text, row, limit=LIMIT, overlap=OVERLAP):
    p = row.pieces
    assert "".join(x.piece[x.overlap_chars :] for x in p) == text  # nothing lost, nothing twice
    assert all(len(x.piece) <= limit and x.overlap_chars <= overlap for x in p)
    assert [x.piece_no for x in p] == list(range(len(p))) and p[0].overlap_chars == 0
    for a, b in zip(p, p[1:]):
        assert a.piece.endswith(b.piece[: b.overlap_chars])


texts = st.lists(st.sampled_from(["word", "a", "\n", "\n\n", " ", ". ", "\r\n", "  indented", "x" * 30, "y" * 49, "z" * 120, "é😀", " ", "\t"]), max_size=40).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=1, max_size=25))
def test_round_trip(spark, many):
    got = split(spark, many)
    for i, t in enumerate(many):
        check(t, got[i])
        forced = any(len(w) > LIMIT for w in re.split(r"[\s\x1c-\x1f]+", t)) and len(t) > LIMIT
        assert any(x.forced for x in got[i].pieces) == forced


def test_boundaries_by_strength(spark):
    para = "one two three four five six.\n\nseven eight nine ten eleven twelve"
    got = split(spark, [para])[0]
    assert got.pieces[0].piece.endswith("\n\n")
    code = "def f():\n    return 1\n    x = 2\ndef g():\n    return 2\nq = 1\n"
    assert split(spark, [code])[0].pieces[1].piece.lstrip().startswith(("return", "def", "x = 2", "x"))


def test_edges(spark):
    long = ("lorem ipsum dolor " * 20_000)[:300_000]
    got = split(spark, ["", "short", None, long, "w" * LIMIT, "w" * (LIMIT + 1), " " * 200])
    assert 2 not in got and len(got[0].pieces) == 1 and len(got[4].pieces) == 1 and len(got[5].pieces) == 2
    for i, t in ((0, ""), (1, "short"), (3, long), (6, " " * 200)):
        check(t, got[i])


def test_production_sizes(spark):
    t = ["a b\n" * 3000, "k" * 2000, "k" * 2001, ("k" * 1990 + " ") * 3, "p " * 100 + "k" * 2000 + " e " * 300]
    df = spark.createDataFrame(list(enumerate(t)), "file_id long, content string")
    rows = splitting.split_items(df, only_oversized=True)
    assert {r.file_id: r.cut_kind for r in splitting.cut_kinds(rows).collect()} == {0: "natural", 2: "forced", 3: "natural", 4: "natural"}
    for r in rows.collect():
        check(t[r.file_id], r, 2000, 400)
    assert splitting.item_pieces(rows).count() == sum(len(r.pieces) for r in rows.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "file_id long, content string")
    assert splitting.item_pieces(splitting.split_items(df)).count() == 0


def test_column_form(spark):
    df = spark.createDataFrame([("a " * 60,), (None,)], "t string").select(splitting.pieces(F.col("t"), LIMIT, OVERLAP).alias("p")).collect()
    assert len(df[0].p) > 2 and df[1].p is None
    with pytest.raises(AssertionError):
        splitting.pieces(F.col("t"), 10, 10)
