import json
import uuid
from pathlib import Path

import pytest

from quarry import cli
from quarry.operators import evaluation, generation
from quarry.operators.embedding import LocalHashEmbedder
from quarry.plans import report
from quarry.plans.engine import Engine
from quarry.sources import config, pdf, snapshots, tables
from quarry.streaming import ingest as streaming

PAGES = [
    ("law", 1, "Điều 1. Thử việc\nThử việc kéo dài không quá sáu mươi ngày.\nLương thử việc do hai bên định ra."),
    ("law", 2, "Điều 2. Nghỉ phép\nMỗi năm có mười hai ngày nghỉ phép."),
]
CASES = """
cases:
  - id: A1
    question: "Thử việc kéo dài bao lâu?"
    category: direct
    expected_citations: [{article: "Điều 1"}]
    expected_keywords: ["sáu mươi ngày"]
  - id: A2
    question: "Nghỉ phép năm | bao nhiêu ngày?"
    expected_citations: [{page: 2}]
  - id: A3
    question: "Thời tiết hôm nay?"
    answerable: false
"""


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, page_number int, text string")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, config.Settings(storage_dir=str(tmp_path / "storage"), reports_dir=str(tmp_path / "reports")))


def test_ingest_ask_and_evaluate(spark, engine, pages, tmp_path):
    meta = engine.ingest(pages, LocalHashEmbedder(), "local", source="law.pdf")
    assert meta["chunk_count"] == 2 and meta["embedding_model"] == "local-hash-256"
    chunks, embedder = engine.open_index()
    asked = spark.createDataFrame([("q", "nghỉ phép")], "query_id string, question string")
    row = engine.ask(chunks, asked, embedder, generation.extractive_client).first()
    assert row["answer"].endswith("[Trang 2, Điều 2]") and row["answer_error"] is None
    (tmp_path / "cases.yaml").write_text(CASES, encoding="utf-8")
    cases = tables.load_cases(spark, tmp_path / "cases.yaml")
    rows = engine.evaluate(chunks, cases, embedder, generation.extractive_client, top_k=2).cache()
    made = {r["id"]: r for r in rows.collect()}
    assert made["A1"]["first_evidence_rank"] == 1 and made["A2"]["first_evidence_rank"] == 1
    assert made["A1"]["keyword_hit_count"] == 0 or made["A1"]["keyword_hit_ratio"] == 1.0
    summary = evaluation.summary(rows, 2).first().asDict()
    assert (summary["recall_at_2"], summary["mrr"], summary["case_count"]) == (1.0, 1.0, 3)
    listed = report.report_rows(rows)
    as_json, as_md = report.save_reports(engine.settings.reports_dir, listed, summary, 2)
    data = json.loads(as_json.read_text(encoding="utf-8"))
    assert [c["case"]["id"] for c in data["cases"]] == ["A1", "A2", "A3"] and "embedding" not in str(data)
    text = as_md.read_text(encoding="utf-8")
    assert "| Recall@2 | 1.000 |" in text and "| A1 | #1 |" in text and "## A3" in text


def test_failing_generation_stays_in_its_row(spark):
    def client():
        def ask(system, user):
            if "bad" in user:
                raise KeyError("no")
            return " fine "

        return ask

    df = spark.createDataFrame([("bad", "c"), ("good", None)], "question string, context string")
    got = {r["question"]: (r["answer"], r["answer_error"]) for r in generation.answers(df, client).collect()}
    assert got == {"bad": ("", "answer_generation error: KeyError: 'no'"), "good": ("fine", None)}


def test_response_text():
    class R:
        def __init__(self, **kw):
            self.__dict__.update(kw)

    assert generation.response_text(R(output_text=" a ")) == "a"
    assert generation.response_text(R(output_text="", output=[R(content=[R(text="x"), R(text=None)]), R(content=None), R(content=[R(text="y")])])) == "x\ny"


def test_empty_cases_and_bad_flags(spark, tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("")
    assert tables.load_cases(spark, f).count() == 0
    f.write_text('cases: [{id: 1, question: q, answerable: "false"}]')
    with pytest.raises(ValueError):
        tables.load_cases(spark, f)


def test_cli_round_trip(spark, pages, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("RAG_STORAGE_DIR", str(tmp_path / "s"))
    monkeypatch.setenv("RAG_REPORTS_DIR", str(tmp_path / "r"))
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "cases.yaml").write_text(CASES, encoding="utf-8")
    assert cli.main(["ask", "x", "--retrieve-only", "--local-embeddings"], spark) == 1  # no index yet
    assert cli.main(["ingest", "--pages", str(tmp_path / "pages"), "--local-embeddings"], spark) == 0
    assert cli.main(["ask", "nghỉ phép", "--retrieve-only", "--top-k", "1"], spark) == 0
    assert "[C1] Trang 2, Điều 2" in capsys.readouterr().out
    assert cli.main(["eval", "--cases", str(tmp_path / "cases.yaml"), "--skip-generation", "--limit", "2"], spark) == 0
    out = capsys.readouterr().out
    assert "recall_at_5: 1.0" in out and "answer skipped" in out and len(list(Path(tmp_path / "r").iterdir())) == 2
    assert cli.main(["ingest", "--pages", str(tmp_path / "pages"), "--local-embeddings", "--overlap", "1800"], spark) == 1


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("RAG_TOP_K", "x")
    monkeypatch.setenv("RAG_OCR_DPI", "300")
    s = config.Settings.from_env()
    assert (s.top_k, s.ocr_dpi, s.index_path) == (5, 300, "storage/index")
    with pytest.raises(FileNotFoundError):
        config.find_default_pdf(tmp_path)
    (tmp_path / "a.pdf").touch()
    assert config.find_default_pdf(tmp_path).name == "a.pdf"
    (tmp_path / "b.pdf").touch()
    with pytest.raises(FileExistsError):
        config.find_default_pdf(tmp_path)


class Counted:
    """Readers that note their calls in a folder, for tasks have no other way to tell."""

    def __init__(self, folder, broken=None):
        folder.mkdir(exist_ok=True)
        self.folder, self.readers = folder, _counting(str(folder), broken)

    def calls(self, kind):
        return sorted(p.name.split("_")[1:-2] for p in self.folder.glob(f"{kind}_*"))


def _counting(folder, broken):
    def note(kind, *what):
        from pyspark import TaskContext

        Path(folder, "_".join([kind, *map(str, what), f"t{TaskContext.get().partitionId()}", uuid.uuid4().hex])).touch()

    def count(file):
        note("count")
        return int(file.read().split()[1])

    def text(file, pages):
        name = file.read().split()[0].decode()
        note("text", name, *pages)
        return [("x" * 400 if name == "good" else "") for _ in pages]

    def render(file, pages, dpi):
        name = file.read().split()[0].decode()
        note("render", name, *pages)
        if broken in pages:
            raise ValueError("no paper")
        return [f"{name} {p} {dpi}".encode() for p in pages]

    def ocr(image, lang):
        note("ocr", *image.decode().split())
        return f"{lang} {image.decode()}" + " y" * 60 * (int(image.split()[1]) % 2)

    return pdf.Readers(count, text, render, ocr)


def test_pdf_fallback_and_cache(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "good.pdf").write_bytes(b"good 3")
    (folder / "scan.pdf").write_bytes(b"scan 2")
    seen = Counted(tmp_path / "calls")
    load = lambda **kw: pdf.load_or_extract(spark, str(folder), cache, readers=seen.readers, **kw)
    got = load(lang="eng").orderBy("doc_id", "page_number").collect()
    assert [(r["doc_id"][-8:], r["page_number"], r["source"], r["warnings"]) for r in got] == [
        ("good.pdf", 1, "pdf_text_layer", []), ("good.pdf", 2, "pdf_text_layer", []), ("good.pdf", 3, "pdf_text_layer", []),
        ("scan.pdf", 1, "tesseract_ocr", []), ("scan.pdf", 2, "tesseract_ocr", ["low_ocr_text"]),
    ]
    assert got[4]["text"] == "eng scan 2 220"
    before = {k: seen.calls(k) for k in ("count", "text", "render", "ocr")}
    assert before["text"] == [["good", "1", "2", "3"], ["scan", "1", "2"]] and before["render"] == [["scan", "1", "2"]]
    (folder / "copy.pdf").write_bytes(b"scan 2")  # the same content under another name
    again = load(lang="eng")
    assert again.count() == 7 and before == {k: seen.calls(k) for k in before}
    assert cli.ocr_summary(again.where("doc_id not like '%copy%'")) == [f"Pages: 5 | characters: {1200 + len(got[3]['text']) + len(got[4]['text'])}", "Warning: little text on pages 2"]
    (folder / "new.pdf").write_bytes(b"new 1")
    assert load(lang="eng").count() == 8
    assert len(seen.calls("count")) == 3 and seen.calls("text")[1:2] == [["new", "1"]] and len(seen.calls("render")) == 2
    assert load(lang="fra").where("text like 'fra%'").count() == 5 and len(seen.calls("render")) == 2  # images serve another language
    assert {r["source"] for r in load(force_ocr=True, lang="eng").collect()} == {"tesseract_ocr"}
    assert len(seen.calls("render")) == 5 and load(lang="eng").count() == 8
    meta = spark.read.parquet(f"{cache}/meta").orderBy("created_at").collect()
    assert [r["page_count"] for r in meta] == [5, 7, 8, 8, 8, 8] and meta[0]["pdf"] == str(folder)


def test_a_long_scan_is_many_tasks_and_goes_on_where_it_stopped(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "scan.pdf").write_bytes(b"scan 23")
    seen = Counted(tmp_path / "calls", broken=5)
    kw = dict(pages_a_range=4, ranges_a_wave=2, prefer_text_layer=False)
    with pytest.raises(Exception, match="no paper"):
        pdf.load_or_extract(spark, str(folder), cache, readers=seen.readers, **kw)
    done = {r["page"] for r in spark.read.schema(pdf.PageStore.ROWS).parquet(f"{cache}/rows").collect()}
    assert 0 < len(done) < 23
    mended = Counted(tmp_path / "calls2")
    assert pdf.load_or_extract(spark, str(folder), cache, readers=mended.readers, **kw).count() == 23
    rendered = [int(p) for call in mended.calls("render") for p in call[1:]]
    assert sorted(rendered) == sorted(set(range(1, 24)) - done) and len(mended.calls("ocr")) == 23
    whole = Counted(tmp_path / "calls3")
    assert pdf.load_or_extract(spark, str(folder), cache + "2", readers=whole.readers, pages_a_range=4, prefer_text_layer=False).count() == 23
    assert len(whole.calls("render")) == 6 and max(len(c) for c in whole.calls("render")) == 5
    assert len({p.name.split("_")[-2] for p in (tmp_path / "calls3").glob("render_*")}) == 6  # as many tasks


def test_pages_are_rendered_by_range_in_the_tasks_folder(monkeypatch):
    from io import BytesIO

    made = []

    def run(command):
        made.append(command)
        if command[0] == "pdftoppm":
            assert Path(command[8]).read_bytes() == b"pdf" and command[3] == "200"
            for n in range(int(command[5]), int(command[7]) + 1):
                Path(f"{command[9]}-{n:02d}.png").write_bytes(b"%d" % n)
            return ""
        return Path(command[1]).read_bytes().decode()

    monkeypatch.setattr(pdf, "run_command", run)
    monkeypatch.setattr(pdf, "command_exists", lambda name: True)
    assert pdf.rendered(BytesIO(b"pdf"), [9, 10, 12], 200) == [b"9", b"10", b"12"] and len(made) == 2
    assert pdf.ocr_image(b"seen", "eng") == "seen" and made[-1][3:5] == ["-l", "eng"]
    monkeypatch.setattr(pdf, "run_command", lambda command: "")
    with pytest.raises(RuntimeError):
        pdf.rendered(BytesIO(b"pdf"), [1], 200)
    monkeypatch.setattr(pdf, "command_exists", lambda name: False)
    with pytest.raises(RuntimeError):
        pdf.ocr_image(b"x", "eng")


def test_an_empty_ingest_leaves_the_index(spark, engine, pages):
    from pyspark.sql import functions as F

    engine.ingest(pages, LocalHashEmbedder(), "local", source="law.pdf")
    with pytest.raises(RuntimeError):
        engine.ingest(pages.withColumn("text", F.lit(" \n")), LocalHashEmbedder(), "local")
    assert engine.open_index()[0].count() == 2


def found(engine, question, **kw):
    chunks, embedder = engine.open_index()
    asked = engine.spark.createDataFrame([("q", question)], "query_id string, question string")
    return [(r["doc_id"], r["page_start"], r["text"][:9]) for r in engine.search(chunks, asked, embedder, **kw).orderBy("rank").collect()]


def test_upsert_writes_the_documents_that_changed_only(spark, engine, pages):
    embedder, path = LocalHashEmbedder(), engine.settings.index_path
    other = spark.createDataFrame([("rules", 1, "Điều 9. Nghỉ phép\nNghỉ phép của người khác là chín ngày.")], pages.schema)
    engine.ingest(pages.union(other), embedder, "local")
    part = snapshots.manifest(spark, path)["parts"][0]
    stamp = {f: f.stat().st_mtime_ns for f in (Path(path) / part["name"]).rglob("*.parquet")}
    new = spark.createDataFrame([("law", 1, "Điều 3. Lương\nLương hai bên định ra."), ("more", 7, "Nghỉ phép có thêm.")], pages.schema)
    assert engine.ingest(new, embedder, "local", upsert=True)["chunk_count"] == 3
    assert stamp == {f: f.stat().st_mtime_ns for f in (Path(path) / part["name"]).rglob("*.parquet")}
    data = snapshots.manifest(spark, path)
    assert [(p["chunks"], p["gone"]) for p in data["parts"]] == [(3, 0), (2, 2)] and data["version"] == 2
    whole = Engine(spark, config.Settings(storage_dir=engine.settings.storage_dir + "-whole"))
    whole.ingest(new.union(other), embedder, "local")
    asked = spark.createDataFrame([("a", "nghỉ phép"), ("b", "lương chín ngày")], "query_id string, question string")
    ranked = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    both = [(e, e.open_index()[0]) for e in (engine, whole)]
    assert len({str(ranked(e.search(c, asked, embedder))) for e, c in both}) == 1
    assert len({str(ranked(e.keyword_search(asked))) for e, _ in both}) == 1  # frequencies and mean length leave out what is gone
    assert [x[0] for x in found(engine, "nghỉ phép", top_k=1)] == ["more"]
    assert snapshots.vacuum(spark, path, keep=1) == [] and engine.open_index()[0].count() == 3
    engine.ingest(new, embedder, "local")
    assert len(snapshots.vacuum(spark, path, keep=1)) == 2 and engine.open_index()[0].count() == 2


def test_a_write_that_fails_leaves_the_old_index(spark, engine, pages, monkeypatch):
    engine.ingest(pages, LocalHashEmbedder(), "local")
    before = found(engine, "nghỉ phép")

    def fails(rows):
        raise OSError("disk full")

    monkeypatch.setattr(snapshots.lexical, "postings", fails)
    with pytest.raises(OSError):
        engine.ingest(pages.where("page_number = 1"), LocalHashEmbedder(), "local")
    assert found(engine, "nghỉ phép") == before and len(before) == 2
    monkeypatch.undo()
    commit = snapshots._commit
    monkeypatch.setattr(snapshots, "_commit", lambda spark, path, data: commit(spark, path, {**data, "version": 1}))
    with pytest.raises(RuntimeError):  # another writer was first
        engine.ingest(pages.where("page_number = 1"), LocalHashEmbedder(), "local")
    assert found(engine, "nghỉ phép") == before


def test_search_reads_no_text(spark, engine, pages, monkeypatch):
    from quarry.operators import grid

    engine.ingest(pages, LocalHashEmbedder(), "local")
    plans, hybrid = [], grid.hybrid

    def watched(rows, *a):
        plans.append(rows.select("key", "dl", "terms", "tf", "embedding")._jdf.queryExecution().executedPlan().toString())
        return hybrid(rows, *a)

    monkeypatch.setattr(grid, "hybrid", watched)
    monkeypatch.setattr(grid, "counted", lambda *a: 1 / 0)
    assert found(engine, "Thử việc", top_k=1) == [("law", 1, "Điều 1. T")]
    assert "ReadSchema" in plans[0] and "text:string" not in plans[0]


def test_the_cases_that_come_along(spark):
    path = Path(__file__).parents[1] / "eval/test_cases.yaml"
    assert tables.load_cases(spark, path).where("not answerable").count() == 2


def test_image_numbers_and_commands():
    assert [pdf.image_number(x) for x in ("a/page-10.png", "page-2.png", "page-x.png", "page.png")] == [10, 2, 0, 0]
    assert pdf.command_exists("sh") and not pdf.command_exists("no-such-command-here")
    assert pdf.run_command(["printf", "\\377a"]) == "�a"


def test_json_interchange(spark, engine, pages, tmp_path):
    engine.ingest(pages, LocalHashEmbedder(), "local", source="law.pdf")
    out = tables.export_index_json(spark, engine.settings.index_path, tmp_path / "index.json")
    back = tables.load_chunks_json(spark, str(out)).orderBy("ordinal").collect()
    want = tables.load_index(spark, engine.settings.index_path)[1].orderBy("ordinal").collect()
    assert [(r["ordinal"], r["id"], r["text"], r["article"], r["embedding"]) for r in back] == [(r["ordinal"], r["id"], r["text"], r["article"], r["embedding"]) for r in want]
    tables.write_json(tmp_path / "pages.json", {"metadata": {"pdf": "p"}, "pages": [{"page_number": 3}]})
    row = tables.load_pages_json(spark, str(tmp_path / "pages.json")).first()
    assert tuple(row) == ("p", 3, "", 0, "unknown", [])


def test_pages_round_trip(spark, pages, tmp_path):
    from pyspark.sql import functions as F

    full = pages.withColumn("char_count", F.length("text")).withColumn("source", F.lit("s")).withColumn("warnings", F.array().cast("array<string>"))
    tables.save_pages(full, str(tmp_path / "p"), "x.pdf")
    assert tables.load_pages(spark, str(tmp_path / "p")).count() == 2


def test_streaming_ingest(spark, pages, tmp_path):
    from pyspark.sql import functions as F

    full = pages.withColumn("char_count", F.length("text")).withColumn("source", F.lit("s")).withColumn("warnings", F.array().cast("array<string>"))
    full.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.page_stream(spark, str(tmp_path / "in"))
    q = streaming.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), LocalHashEmbedder())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 2


def test_pages_in_many_batches_make_the_chunks_of_one(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry import schemas
    from quarry.operators import chunking

    words = lambda n: " ".join(f"w{i}." for i in range(n))
    texts = ["no header yet", "Điều 1. One\n" + words(30), words(90), " \n", "Điều 2\n" + words(5), "Điều 3. Three\nx.\n" + words(60), words(3)]
    rows = [(d, p + 1, t, len(t), "s", []) for d in ("a", "b") for p, t in enumerate(texts if d == "a" else texts[::-1])]
    pages = spark.createDataFrame(rows, schemas.PAGES)
    for p in range(1, 8):
        where = {"a": [p], "b": [2 * p - 1, 2 * p]}  # one page and two pages a batch
        part = pages.where(F.expr(" or ".join(f"(doc_id = '{d}' and page_number = {n})" for d, own in where.items() for n in own)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streaming.ingest_stream(streaming.page_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), LocalHashEmbedder(), 120, 20)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert got.select("batch").distinct().count() >= 6
    names = [c for c in schemas.CHUNKS.names if c != "embedding"]
    want = chunking.build_chunks(pages, 120, 20)
    listed = lambda df: sorted(map(tuple, df.select(names).collect()), key=repr)
    assert listed(got) == listed(want) and want.where("article is null").count() and want.where("title is not null").count()


def test_metric_format():
    assert [report.format_metric(x) for x in (None, 0.5, 3)] == ["n/a", "0.500", "3"]
