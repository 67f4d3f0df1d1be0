import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r[1] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def folded(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")


def test_accents_fold_like_unicode_decomposition(apply):
    # a few Indic letters decompose to several characters and stay as they are
    letters = "".join(chr(c) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c))[0] != "C" and len(folded(chr(c))) < 2)
    want = folded(letters)
    assert apply(tx.strip_accents, letters, "Điều ĐẶC biệt", None) == [want, "Dieu DAC biet", None]


def test_tokens_keep_order_and_repeats(apply):
    assert apply(tx.tokenize, "Điều 12,5: A_b × a", "", "漢字") == [["dieu", "12", "5", "a", "b", "×", "a"], [], []]


def test_cleaning_erases_blank_lines_and_line_starts(apply):
    got = apply(tx.clean_text, "a\r\n\r\n\n  b \t c\fd\r\xa0 e \n", " \n\t", "")
    assert got == ["a\nb c\nd\ne", "", ""]


def test_short_text_clips_with_ellipsis(apply):
    f = lambda c: tx.short_text(c, 10)
    assert apply(f, " a\n b ", "0123456789", "01234 6789 x") == ["a b", "0123456789", "01234 6..."]


def test_paragraphs_break_after_full_stops_only(apply):
    assert apply(tx.paragraphs, "one.\ntwo\nthree. \nfour.\n", "a\n\nb") == [["one.", "two\nthree. \nfour."], ["a", "b"]]


def test_headers_variants_titles_and_swallowed_lines(apply):
    got = apply(tx.find_articles, "Điều 5. Phạm vi\nDIEU 6a: x\nðiều 7", "điều 3\nĐiều 4. T", "see Điều 9", "Điều 12abc")
    pairs = [[(a["article"], a["title"]) for a in row] for row in got]
    assert pairs == [[("Điều 5", "Phạm vi"), ("Điều 6a", "x"), ("Điều 7", None)], [("Điều 3", "Điều 4. T")], [], [("Điều 12a", "bc")]]


def test_article_match_is_containment_unless_strict(spark):
    row = spark.range(1).select(
        tx.article_matches(F.lit("Điều 35"), F.lit("dieu 3")).alias("loose"),
        tx.article_matches(F.lit("Điều 35"), F.lit("Điều 3"), strict=True).alias("strict"),
        tx.article_matches(F.lit("Điều 3 khoản 1"), F.lit("Điều 3"), strict=True).alias("exact"),
        tx.article_matches(F.lit(None).cast("string"), F.lit("x")).alias("missing"),
        tx.article_matches(F.lit(""), F.lit("")).alias("empty"),
    ).first()
    assert tuple(row) == (True, False, True, False, False)


def test_citation_and_refusal_predicates(apply):
    assert apply(tx.has_citation, "as [Trang 3]", "[PAGE\xa07]", "Trang 3", "[trang x]") == [True, True, False, False]
    assert apply(tx.is_refusal, "Tôi không tìm thấy căn cứ.", "NGOÀI PHẠM VI", "có") == [True, True, False]


def test_citation_string(spark):
    rows = spark.createDataFrame([(1, 1, "Điều 2"), (1, 3, None), (4, 4, "")], "a int, b int, art string")
    got = [r[0] for r in rows.select(tx.citation(F.col("a"), F.col("b"), F.col("art"))).collect()]
    assert got == ["Trang 1, Điều 2", "Trang 1-3", "Trang 4"]


def test_keyword_hits_count_repeats_and_empty(spark):
    row = spark.range(1).select(tx.keyword_hits(F.lit("48 giờ"), F.array(F.lit("8 GIỜ"), F.lit("8 gio"), F.lit(""), F.lit("ngày")))).first()
    assert row[0] == ["8 gio", "8 gio", ""]


def test_folding_is_canonical_decomposition(apply):
    import unicodedata

    want = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")
    texts = ["한국어 각 가 힣", "\u09cb\u0bca x", "\U0001d15e note", "\U0002f800", "Điều é Å ﬁ", "\U0001f600 가", "\u0344a", "plain"]
    assert apply(tx.strip_accents, *texts) == [want(t) for t in texts]
    assert apply(tx.tokenize, "한국 ab") == [[want("한국"), "ab"]]


def test_cleaning_and_stripping_know_all_white_space(apply):
    odd = [chr(c) for c in range(0x3001) if re.match(r"[\s\x1c-\x1f]", chr(c))]
    assert sorted(odd) == sorted(tx.SPACES)
    assert apply(tx.clean_text, "".join(odd) + "a \t b\r\n\xa0 c\fd  e" + "".join(odd), None) == ["a b\nc\nd e", None]
