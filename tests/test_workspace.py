"""Projects on disk: uploads, index, registry, findings, comparisons, report; settings, generators, PDF files."""

import io
import urllib.error
import zlib

import pytest
from pyspark.sql import functions as F

from tests.fixtures import architecture as arch
from tests.test_document_to_registry import frame
from tracewell.config import Settings
from tracewell.operators import profiles
from tracewell.sources import generators, pdf
from tracewell.workspace import Workspace, WorkspaceError


def make_pdf(pages, title="A title", packed=True, extra=b""):
    """A small PDF with a line per Tj."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages)), 3: b"<< /Title (%s) >>" % title.encode()}
    for i, lines in enumerate(pages):
        text = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(%s) Tj" % s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") for s in lines) + b" ET"
        body = zlib.compress(text) if packed else text
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items()) + b"trailer << /Root 1 0 R /Info 3 0 R " + extra + b">>"


def test_pdf_reader():
    pages = [["First (line) here", "second \\ line"], [], ["Über café"]]
    for packed in (True, False):
        metadata, got = pdf.read(make_pdf(pages, packed=packed))
        assert got == pages and metadata["title"] == "A title" and metadata["page_count"] == "3" and metadata["author"] == ""
    for bad in (b"", b"hello", make_pdf(pages, extra=b"/Encrypt 9 0 R "), b"%PDF-1.4 nothing"):
        with pytest.raises(pdf.PdfError):
            pdf.read(bad)
    assert pdf._lines(b"BT [(Hel) -20 (lo) -300 (you)] TJ T* <48690a> Tj ET") == ["Hello you", "Hi"]


def test_scan_marks_sparse_pages(spark):
    files = spark.createDataFrame([("a", bytearray(make_pdf([["x" * 50], ["few"]]))), ("b", bytearray(b"no")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in pdf.scan(files).collect()}
    assert [p.is_scan for p in got["a"].pages] == [False, True] and got["b"].error.startswith("PdfError") and got["c"].error
    seen = pdf.scan(files.where("path = 'a'"), ocr=lambda data, n: [f"page {n} by eye", ""]).first()
    assert seen.pages[1].lines == ["page 2 by eye"]

    def fails(data, n):
        raise RuntimeError("no engine")

    assert pdf.scan(files.where("path = 'a'"), ocr=fails).first().pages[1].lines == ["few"]


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    w = Workspace(spark, f"file://{tmp_path_factory.mktemp('space')}")
    one, two = (arch.document(m, v) for m, v in ((arch.first(), arch.V1), (arch.second(), arch.V2)))
    w.index(frame(spark, one, two))
    w.extract()
    return w


def test_registry_findings_and_comparison(space):
    f, e = space.registry(arch.V1)
    assert (e.count(), f.count()) == (165, 200)
    space.extract()
    assert (space.table("entities").count(), space.table("facts").count()) == (165 + 149, 200 + 178)
    assert space.query_registry(arch.V1, entity="c-05").first().name == "SeatAdjustSWC" and space.query_registry(arch.V2, related="C-05").count() == 0
    assert space.query_registry(arch.V1, predicate="depends_on").count() == 24 and space.query_registry(arch.V1).where("name = 'port'").first().n == 57
    with pytest.raises(WorkspaceError):
        space.registry("9.9")
    assert space.analyze(arch.V1, persist=True).count() == 0 and space.analyze(arch.V2, persist=True).count() == 1
    found = space.findings(arch.V2).first()
    space.review(arch.V2, found.finding_id, "accepted")
    space.analyze(arch.V2, persist=True)
    assert space.findings(arch.V2, status="accepted").count() == 1 and space.latest_run("findings", arch.V2).endswith("5")
    out = space.compare(arch.V1, arch.V2, persist=True, change_type="entity_changed")
    assert out["entity_changes"].count() == 1 and space.load_comparison(arch.V1, arch.V2)["impacts"].count() == 974
    space.clear_comparison(arch.V1, arch.V2)
    assert space.load_comparison(arch.V1, arch.V2) is None
    assert {"extraction_finished", "findings_finished", "reviewed", "compared", "comparison_cleared"} <= {r.action for r in space.audit().collect()}


def test_questions_and_pages(spark, space):
    q = spark.createDataFrame([(1, "Which component provides VehicleSpeedIF?"), (2, "weather tomorrow")], "question_id long, question string")
    hits = space.retrieve(q, version=arch.V1)
    assert {r.version for r in hits.collect()} == {arch.V1} and space.table("queries").count() == 2
    got = {r.question_id: r.status for r in space.ask(q, version=arch.V1).collect()}
    assert got == {1: "answered", 2: "insufficient_evidence"}
    assert "High-Level Design" in space.page_text(arch.V1, 1)
    assert space.count() > 100 and space.count("other") == 0


def test_report(space, tmp_path):
    sections = space.report(arch.V2, arch.V1, arch.V2)
    assert sections["changes"].count() == 17 + 108 and sections["impacts"].count() == 974 and sections["limitations"].count() == 3
    assert sections["evidence"].count() == sections["evidence"].select("source_chunk_id").distinct().count()
    space.write_report({k: sections[k] for k in ("findings", "changes", "limitations")}, f"file://{tmp_path}/report")
    row = space.spark.read.option("header", True).csv(f"file://{tmp_path}/report/findings.csv").first()
    assert row.entities == "component:C-05"


def test_uploads(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w", Settings(max_upload_bytes=50_000))
    body = [f"Component C-0{i}: Name{i} (SWC, Application layer). Name{i}IF (IF-0{i}) is a S-R interface. Provider: C-01 (Name1)." for i in range(1, 10)]
    hld, other = make_pdf([["Design v1.2", *body, *body, *body]]), make_pdf([["Other text v1.2 " + "y" * 60]])
    files = [("p/a.pdf", "a.pdf", hld), ("p/b.pdf", "b.pdf", hld), ("p/c.pdf", "c.pdf", other), ("p/d.pdf", "d.pdf", b""), ("p/e.pdf", "e.pdf", b"text"), ("p/f.pdf", "f.pdf", make_pdf([["x"]], extra=b"/Encrypt 1 0 R ")), ("p/g.pdf", "g.pdf", b"%PDF-" + b"z" * 60_000)]
    df = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in files], "path string, name string, content binary")
    got = {r.name: r for r in w.upload(df).collect()}
    assert {n: r.status for n, r in got.items()} == {"a.pdf": "ready", "b.pdf": "duplicate", "c.pdf": "ready", "d.pdf": "rejected", "e.pdf": "rejected", "f.pdf": "rejected", "g.pdf": "rejected"}
    assert got["a.pdf"].profile == profiles.APPLICATION and got["c.pdf"].profile == profiles.GENERIC and {got["a.pdf"].version, got["c.pdf"].version} == {"1.2", "1.2-2"}
    assert got["g.pdf"].detail == "file too large" and "encrypted" in got["f.pdf"].detail
    assert w.registry(got["a.pdf"].version)[1].count() >= 9
    assert {r.status for r in w.upload(df.where("name in ('a.pdf', 'c.pdf')")).collect()} == {"duplicate"}
    with pytest.raises(WorkspaceError, match="profiles differ"):
        w.compare_gate("1.2", "1.2-2")
    with pytest.raises(WorkspaceError, match="known are 1.2"):
        w.compare_gate("1.2", "7")
    assert w.versions().count() == 2 and w.versions().where("has_registry").count() == 1


def test_settings_and_generators():
    s = Settings.load({"TRACEWELL_TOP_K": "9", "TRACEWELL_FORCE_FIRST_CITATION": "no", "TRACEWELL_MIN_SCORE": ""})
    assert (s.top_k, s.force_first_citation, s.min_score) == (9, False, 0.10)
    with pytest.raises(ValueError):
        Settings.load({"TRACEWELL_TOP_K": "many"})
    assert generators.by_settings(Settings()) is None
    with pytest.raises(ValueError):
        generators.by_settings(Settings(llm_provider="chat"))
    calls = []

    def opener(replies):
        it = iter(replies)

        def call(request, timeout):
            calls.append(request)
            r = next(it)
            if isinstance(r, Exception):
                raise r
            return io.BytesIO(r)

        return call

    error = lambda code: urllib.error.HTTPError("u", code, "x", {}, io.BytesIO(b"why"))
    good = b'{"choices": [{"message": {"content": "hi"}}], "usage": {"total_tokens": 3}}'
    ask = generators.chat("http://x", "m", "key", retries=2, pause=0, opener=opener([error(429), urllib.error.URLError("down"), good]))
    assert ask("s", "u") == "hi" and len(calls) == 3
    for replies, words in (([error(401)], "HTTP 401: why"), ([error(503)] * 3, "HTTP 503"), ([b"<html>"], "no JSON"), ([b"{}"], "no message"), ([urllib.error.URLError("down")] * 3, "3 attempts")):
        with pytest.raises(generators.GeneratorError, match=words):
            generators.chat("http://x", "m", "secret", pause=0, opener=opener(replies))("s", "u")
    assert generators.usage({"usage": {"total_tokens": 3}}) == (0, 0, 3)
    assert F is not None
