"""Coverage of cases by all chunks: against the row-by-row checks of evaluation, and by hand."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import coverage, evaluation

CHUNKS = "key int, page_start int, page_end int, article string, text string"
CASES = "id string, answerable boolean, expected_citations array<struct<article:string,page:string>>, expected_keywords array<string>"
ROWS = [
    (0, 12, 13, "Điều 35", "Điều 35. theo Điều 9"), (1, 20, 20, None, "khác"), (2, None, None, "", ""), (3, 1, None, "Điều 9", None),
    (4, 20, 22, "Điều 3", "nghỉ 48 GIỜ, nghỉ"), (4, 20, 22, "Điều 3", "nghỉ 48 GIỜ, nghỉ"),
]


def covered(spark, chunks, cases, **kw):
    made = coverage.coverage(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(cases, CASES), **kw)
    return {r["id"]: (r["evidence_chunks"], r["keyword_total"], r["keywords_present"]) for r in made.collect()}


def test_by_hand(spark):
    cases = [
        ("page", True, [(None, " 20 ")], ["khac", "KHÁC", "nowhere", "", None]), ("article", True, [("điều 3", None)], ["48 giờ"]), ("both", True, [("Điều 3", "21")], []),
        ("twice", True, [("Điều 9", None), ("Điều 9", None), (None, "12")], None), ("none", False, [], []), ("null", False, None, None),
        ("nothing", True, [("", None), (None, None)], []), ("word", True, [(None, "x")], []), ("mark", True, [("́", None)], []),
    ]
    got = covered(spark, ROWS, cases)
    assert got["page"] == (3, 5, 3) and got["article"] == (3, 1, 1) and got["both"] == (2, 0, 0) and got["twice"] == (2, 0, 0)
    assert got["none"] == got["null"] == got["nothing"] == got["word"] == (0, 0, 0)
    assert got["mark"] == (5, 0, 0)  # what normalises to nothing is in every text that isn't empty
    assert covered(spark, ROWS, cases, strict=True)["article"] == (2, 1, 1)
    assert covered(spark, ROWS, cases, block_bytes=8) == got


def test_empty_tables_and_clashing_names(spark):
    case = [("a", True, [("Điều 9", None)], ["x"])]
    assert covered(spark, [], case) == {"a": (0, 1, 0)}
    assert covered(spark, ROWS, []) == {}
    clash = spark.createDataFrame(case * 2, CASES).withColumn("kind", F.lit(1)).withColumn("value", F.lit(2)).withColumn("text", F.lit("Điều 9"))
    rows = coverage.coverage(spark.createDataFrame(ROWS, CHUNKS), clash).collect()
    assert [(r["evidence_chunks"], r["kind"], r["value"]) for r in rows] == [(2, 1, 2)] * 2


@pytest.mark.parametrize("strict", [False, True])
def test_equals_the_checks_of_single_results(spark, strict):
    """A chunk counts where ``first_evidence_rank`` finds it as the only result, and keywords where ``keyword_hits`` does."""
    rng = random.Random(3)
    words = ["Điều 3", "điều 35", "giờ", "GIO 4", "a", "ab", "bab", "Đ", "한", "é", "48", "𝒳y", ""]
    say = lambda n: rng.choice(["", " ", ", "]).join(rng.choices(words, k=rng.randrange(n)))
    chunks = [(i, p, p + rng.randrange(3), rng.choice([None, say(2)]), rng.choice([None, say(9), say(9), say(30)])) for i in range(80) for p in [rng.randrange(9)]]
    item = lambda: (rng.choice([None, say(3)]), rng.choice([None, None, "x", str(rng.randrange(9))]))
    cases = [(str(i), True, [item() for _ in range(rng.randrange(4))], [say(3) for _ in range(rng.randrange(4))]) for i in range(60)]
    one = F.array(F.struct(F.lit(1).alias("rank"), "page_start", "page_end", "article", "text"))
    pairs = spark.createDataFrame(chunks, CHUNKS).crossJoin(spark.createDataFrame(cases, CASES))
    rank = evaluation.first_evidence_rank(one, F.col("expected_citations"), strict)
    hit = F.transform("expected_keywords", lambda k: F.contains(tx.normalize(F.col("text")), tx.normalize(k)).cast("int"))
    want = {}
    for r in pairs.select("id", rank.isNotNull().alias("met"), hit.alias("hit")).collect():
        n, there = want.get(r["id"], (0, [0] * len(r["hit"])))
        want[r["id"]] = n + r["met"], [max(a, b or 0) for a, b in zip(there, r["hit"])]
    assert covered(spark, chunks, cases, strict=strict) == {k: (n, len(there), sum(there)) for k, (n, there) in want.items()}


def test_phrases():
    many = coverage.Phrases([f"w{i}" for i in range(5000)] + ["", "w1"])
    assert {p for p, i in many.number.items() if i in many.found("w1 w12 x")} == {"", "w1", "w12"}
    assert many.found(None) == set() and coverage.Phrases([]).found("x") == set()
    assert coverage.Phrases.of(("a",), False) is coverage.Phrases.of(("a",), False)


def test_ceiling(spark):
    made = coverage.coverage(spark.createDataFrame(ROWS, CHUNKS), spark.createDataFrame([("a", True, [("khác", None)], []), ("b", True, [(None, "99")], []), ("c", False, [], [])], CASES))
    assert coverage.ceiling(made).first().asDict() == {"recall_ceiling": 0.5, "covered_case_count": 1, "answerable_case_count": 2}
    assert coverage.ceiling(made.where("id = 'c'")).first()["recall_ceiling"] is None


def test_texts_are_looked_at_piece_by_piece():
    batch = pa.record_batch([pa.array(["x" * 400_000, None, "y" * 700_000, "z" * 2_000_000, ""]), pa.array(["a", "b", None, "c", "d"]), pa.array(range(5))], names=["text", "article", "n"])
    made = list(coverage._pieces([batch, batch.slice(0, 0)]))
    assert [b.column("n").to_pylist() for b in made] == [[0, 1], [2], [3], [4]]
    assert pa.Table.from_batches(made).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
