import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import chunking


def chunk(spark, pages, **kw):
    df = spark.createDataFrame([("d", n, t) for n, t in pages], "doc_id string, page_number int, text string")
    return [(r["id"], r["text"], r["article"], r["title"]) for r in chunking.build_chunks(df, **kw).orderBy("ordinal").collect()]


def test_article_crosses_pages_and_empty_pages_are_skipped(spark):
    got = chunk(spark, [(1, "Điều 1. Một\nnội dung."), (2, "  \n"), (3, "tiếp theo.")])
    assert got == [("p001-c0001", "Điều 1. Một\nnội dung.", "Điều 1", "Một"), ("p003-c0002", "tiếp theo.", "Điều 1", "Một")]


def test_flushed_group_without_header_takes_the_next_paragraphs_article(spark):
    page = "alpha beta.\nĐiều 7. Tiêu đề dài hơn."
    assert [x[2] for x in chunk(spark, [(1, page)], max_chars=20, overlap=5)] == ["Điều 7"] * 3
    df = spark.createDataFrame([("d", 1, page)], "doc_id string, page_number int, text string")
    own = chunking.build_chunks(df, 20, 5, lookahead=False).orderBy("ordinal").collect()
    assert [r["article"] for r in own] == [None, "Điều 7", "Điều 7"]


def test_detected_header_does_not_change_the_running_one(spark):
    # the last header inside a chunk labels it; the state is what paragraphs said
    got = chunk(spark, [(1, "Điều 1. A\nĐiều 2. B\nx."), (2, "y.")])
    assert [x[2] for x in got] == ["Điều 2", "Điều 2"]


def test_budget_counts_two_characters_between_paragraphs(spark):
    assert [x[1] for x in chunk(spark, [(1, "aaaa.\nbbbb.")], max_chars=12, overlap=0)] == ["aaaa.\nbbbb."]
    assert [x[1] for x in chunk(spark, [(1, "aaaa.\nbbbb.")], max_chars=11, overlap=0)] == ["aaaa.", "bbbb."]


def test_windows_overlap_and_are_stripped(spark):
    assert [x[1] for x in chunk(spark, [(1, "0123 56789")], max_chars=5, overlap=2)] == ["0123", "3 567", "6789"]


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (0, 0), (10, -1)])
def test_windows_that_would_never_advance_are_refused(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.split_long(F.lit("x"), size, overlap)


def test_no_chunk_is_an_error(spark):
    with pytest.raises(RuntimeError):
        chunking.require_chunks(spark.createDataFrame([], "id string"))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=12), min_size=1, max_size=20), st.integers(5, 40))
def test_packing_equals_a_greedy_loop(spark, cases, limit):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<int>")
    got = dict(tuple(r) for r in df.select("i", chunking.pack_groups(F.col("n"), limit)).collect())
    for i, lengths in enumerate(cases):
        want, group, held = [], 0, []
        for n in lengths:
            if held and sum(held) + 2 * len(held) + n > limit:
                group, held = group + 1, []
            held.append(n)
            want.append(group)
        assert got[i] == want
