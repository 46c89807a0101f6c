"""Findings and their reasons, the command, fetching, samples and studies."""
import io
import json
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from refsift import cli, studies
from refsift.sinks import guards
from refsift.sources import authorities, documents, samples, tables
from refsift.verifier import ARXIV, DOI, URL, WORK, Verifier

TEXT = """See doi:10.1000/right and doi:10.1000/gone and doi:10.1000/late. arXiv:2001.00001v2, https://dead.example/x and https://live.example/y.

References
[1] Müller, J. (2004). Random drift and the evolution of cultural change. Journal. doi:10.1000/wrong
[2] Smith, J. (2019). An entirely unknown study of nothing at all. Journal.
[3] Brown, A. (2018). The structure of scientific progress in small fields. Journal.
"""


@pytest.fixture(scope="module")
def verifier(spark):
    first = [("10.1000/right", "hit", "Right", ["A"], 2000), ("10.1000/wrong", "hit", "On the chemistry of salt water fish", ["Other"], 1990), ("10.1000/late", "unreachable", None, None, None)]
    works = [(1, "The structure of scientific progress in small fields", ["brown"], 2018), (2, "An entirely unknown story of something or other", ["Jones"], 2000)]
    return Verifier(
        first=spark.createDataFrame(first, DOI), second=spark.createDataFrame([("10.1000/zzz", "hit", "Z", ["A"], 2000)], DOI), arxiv=spark.createDataFrame([("2001.00001", "hit", "T", ["A"], 2020)], ARXIV),
        urls=spark.createDataFrame([("https://dead.example/x", "miss"), ("https://live.example/y", "hit")], URL), works=spark.createDataFrame(works, WORK),
    )


def test_findings_say_why(spark, verifier):
    rows = {r.identifier or r.claimed_title: r for r in verifier.verify_text(spark, TEXT).collect()}
    verdict = {k: r.verdict for k, r in rows.items()}
    assert verdict["10.1000/right"] == "verified" and "no title to compare" in rows["10.1000/right"].detail
    wrong = rows["10.1000/wrong"]
    assert wrong.verdict == "mismatch" and "record holds 'On the chemistry of salt water fish'" in wrong.detail and "year 2004 vs 1990" in wrong.detail
    assert wrong.evidence_url == "https://doi.org/10.1000/wrong" and wrong.checked_at is not None
    assert verdict["10.1000/gone"] == "not_found" and "no proof" in rows["10.1000/gone"].detail and rows["10.1000/gone"].authority == "crossref+openalex"
    assert verdict["10.1000/late"] == "unreachable" and "could not be completed" in rows["10.1000/late"].detail and rows["10.1000/late"].evidence_url is None
    assert rows["2001.00001v2"].evidence_url == "https://arxiv.org/abs/2001.00001v2"
    assert verdict["https://dead.example/x"] == "not_found" and verdict["https://live.example/y"] == "verified"
    found = rows["The structure of scientific progress in small fields"]
    assert found.verdict == "verified" and "found by its title (100%" in found.detail and found.author_overlap == 1.0
    lost = rows["An entirely unknown study of nothing at all"]
    assert lost.verdict == "not_found" and "The closest is 'An entirely unknown story of something or other'" in lost.detail
    assert all(r.detail for r in rows.values())


def test_switches(spark, verifier):
    off = Verifier(first=verifier.first, second=verifier.second, urls=verifier.urls, works=verifier.works, check_urls=False, search_unidentified=False, use_fallback=False)
    rows = {r.identifier or r.claimed_title: r for r in off.verify_text(spark, TEXT).collect()}
    assert rows["https://live.example/y"].verdict == rows["2001.00001v2"].verdict == "unverifiable" == rows["An entirely unknown study of nothing at all"].verdict
    assert rows["10.1000/gone"].verdict == "unverifiable" and "second index is disabled" in rows["10.1000/gone"].detail


def test_command(spark, verifier, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.md").write_text(TEXT)
    (tmp_path / "b.txt").write_text("Nothing to see, but doi:10.1000/right.")
    verifier.first.write.parquet(str(tmp_path / "first"))
    run = lambda *x: cli.main([*map(str, x), "--first", str(tmp_path / "first")])
    assert run(tmp_path / "b.txt", "--fail-under", "80") == 0
    assert run(tmp_path / "a.md", "--fail-under", "80") == 1
    out = tmp_path / "deep" / "er" / "r.json"
    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "summary.md"))
    assert run(tmp_path / "*.*", "-o", out, "--format", "json", "--no-urls", "--no-search", "--findings", tmp_path / "all") == 1
    got = json.loads(out.read_text())
    assert got["generated_at"] and {f["verdict"] for f in got["findings"]} >= {"verified", "mismatch", "unverifiable"} and got["quotes"]["summary"]["total"] == 0
    assert "mismatch" in (tmp_path / "summary.md").read_text() and spark.read.parquet(str(tmp_path / "all")).count() == len(got["findings"])
    assert run(tmp_path / "none.md") == 2 and "no such file" in capsys.readouterr().err
    assert run(tmp_path / "a.exe") == 2 and cli.main([str(tmp_path / "b.txt"), "--first", str(tmp_path / "nowhere")]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0


def test_build_step(spark, verifier, tmp_path):
    from refsift import ci

    (tmp_path / "a.md").write_text(TEXT)
    verifier.first.write.parquet(str(tmp_path / "first"))
    out = tmp_path / "out"
    env = {"INPUT_FILES": str(tmp_path / "*.md"), "INPUT_FIRST": str(tmp_path / "first"), "GITHUB_OUTPUT": str(out)}
    assert ci.main(env) == 1 and ci.main({"INPUT_FILES": "--strict"}) == 2 and ci.main({}) == 2
    got = dict(line.split("=") for line in out.read_text().split())
    assert set(got) == {"total", "failures", "score"} and got["failures"] == "1" and got["score"] == "50.0"
    assert ci.arguments(["x"], {"INPUT_STRICT": "True", "INPUT_FAIL_UNDER": "80"}) == ["x", "--fail-under", "80", "--strict"]


def test_functions_in_sql(spark):
    from refsift.functions import udfs

    udfs.register(spark)
    row = spark.sql("SELECT title_similarity('Deep Learning', 'learning deep') AS s, normalise_title('Café: x') AS n, author_overlap(array('Müller'), array('Jan Muller')) AS o").first()
    assert tuple(row) == (100.0, "cafe x", 1.0)


def test_word_file(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>doi:10.1000/</w:t></w:r><w:r><w:t>right</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert documents.read_all(spark, [str(tmp_path / "a.docx")]).first().text == "doi:10.1000/right\ncell"
    with pytest.raises(documents.UnsupportedDocument):
        documents.read_all(spark, [str(tmp_path / "a.exe")])


class Answer(io.BytesIO):
    status = 200


def test_getter_retries_and_verbs():
    asked, waits = [], []

    def serve(request, timeout):
        asked.append((request.get_method(), request.full_url))
        code = {"busy": 503, "none": 404, "bad": 400}.get(request.full_url.rpartition("/")[2])
        if request.full_url.endswith("nohead") and request.get_method() == "HEAD":
            code = 405
        if code:
            raise urllib.error.HTTPError(request.full_url, code, "", None, None)
        if request.full_url.endswith("down"):
            raise TimeoutError
        assert "mailto:me@x.org" in request.headers["User-agent"]
        return Answer(b"yes")

    get = authorities.Getter(mailto="me@x.org", open=serve, pause=waits.append)
    assert get("http://h/ok") == ("hit", 200, b"yes") and get("http://h/none") == ("miss", 404, None) and get("http://h/bad") == ("unreachable", 400, None)
    assert get("http://h/busy") == ("unreachable", 503, None) and waits == [1.0, 2.0]
    live = authorities.Getter(mailto="me@x.org", open=serve, pause=waits.append, alive=True)
    asked.clear()
    assert live("http://h/nohead")[0] == "hit" and [m for m, _ in asked] == ["HEAD", "GET"]
    assert live("http://h/none")[0] == "miss" and live("http://h/bad")[0] == "miss" and live("http://h/busy")[0] == "unreachable" and live("http://h/down")[0] == "unreachable"


def test_fetched_snapshots_are_kept(spark, tmp_path):
    from refsift.operators import extract

    def serve(request, timeout):  # defined here, so that it travels to the workers
        import io
        import urllib.error

        url = request.full_url
        code = 404 if "dead" in url else 503 if "late" in url else 200 if "live" in url or "crossref" in url and "right" in url else 404
        if code != 200:
            raise urllib.error.HTTPError(url, code, "", None, None)
        answer = io.BytesIO(b'{"message": {"DOI": "10.1000/RIGHT", "title": ["Right"], "author": [{"family": "A"}], "issued": {"date-parts": [[2000]]}, "type": "x"}}')
        answer.status = code
        return answer

    get = authorities.Getter(open=serve, pause=lambda s: None)
    cites = extract.extract(spark.createDataFrame([("d", TEXT)], "doc_id string, text string"))
    for _ in range(2):  # the second time from the folder, but for what couldn't be reached
        got = authorities.snapshots(spark, cites, str(tmp_path / "cache"), get, workers=2)
        assert {r.doi: r.status for r in got["first"].collect()} == {"10.1000/right": "hit", "10.1000/gone": "miss", "10.1000/late": "unreachable", "10.1000/wrong": "miss"}
        assert {r.url: r.status for r in got["urls"].collect()} == {"https://dead.example/x": "miss", "https://live.example/y": "hit"}
    kept = spark.read.parquet(str(tmp_path / "cache")).groupBy("url").count().collect()
    assert all(r["count"] == (2 if "late" in r.url else 1) for r in kept)
    assert {r.doi for r in got["second"].collect()} == {"10.1000/gone", "10.1000/wrong"}


def test_samples(spark):
    rows = [(f"10.1/{i}" if i % 5 else None, f"A title of some length {i}", ["A"] if i % 3 else [], 2000 + i % 4) for i in range(300)] * 2
    works = spark.createDataFrame(rows, "doi string, title string, authors array<string>, year int")
    got = [r.doi for r in samples.works(works, 30, (2001, 2002)).collect()]
    assert len(set(got)) == 30 and got == [r.doi for r in samples.works(works.repartition(7), 30, (2001, 2002)).collect()] != [r.doi for r in samples.works(works, 30, (2001, 2002), 1).collect()]
    assert samples.works(works.unionByName(works), 10_000, (1000, 3000)).count() == 200
    found = samples.calibration_works(works, 20, [(2000, 2001), (2002, 2003)]).collect()
    assert len(found) == 20 == len({r.doi for r in found}) and all(r.authors for r in found) and sum(r.year < 2002 for r in found) == 10
    pre = spark.createDataFrame([(f"10.48550/arXiv.{i}", i) for i in range(9)] + [("10.1/x", 1)], "doi string, year int")
    assert {r.arxiv_id for r in samples.preprints_of_index(pre, 100).collect()} == {str(i) for i in range(9)}
    feed = spark.createDataFrame([(f"{c}{i}", c, f"2020-01-{i:02}") for c in "ab" for i in range(1, 10)] + [("a9", "b", "2020-01-09")], "arxiv_id string, category string, published string")
    assert sorted(r.arxiv_id for r in samples.newest_preprints(feed, 2).collect()) == ["a8", "a9", "b8", "b9"]
    pages = spark.createDataFrame([(f"t{i % 6}", "word " * (1000 * (i % 6))) for i in range(12)] + [("s", "short insource")], "title string, text string")
    assert {r.title for r in samples.articles(pages, 10).collect()} == {"t2", "t3", "t4", "t5"} and samples.articles(pages, 2).count() == 2
    assert [r.title for r in samples.articles(pages, 9, search="insource").collect()] == ["s"]
    body = json.dumps({"query": {"pages": [{"title": "T", "revisions": [{"slots": {"main": {"content": "{{x}}"}}}]}]}})
    assert spark.createDataFrame([(body,), ("{}",), ("not json",)], "b string").select(samples.wikitext("b").alias("t")).collect() == [("{{x}}",), ("",), ("",)]


def test_studies(spark, verifier, tmp_path):
    ref = lambda i: {"doi": f"10.1000/{['right', 'gone'][i % 2]}", "title": "Right of some length", "author": "B. A", "year": "2000"}
    works = spark.createDataFrame([(f"10.9/{i}", f"T{i}", 2000 + i % 2, [ref(i), {"doi": None, "title": "x", "author": None, "year": None}]) for i in range(6)], "doi string, title string, year int, refs array<struct<doi:string,title:string,author:string,year:string>>")
    checks = studies.baserate(verifier, works, per_year=2)
    assert checks.count() == 8 and {r.mode for r in checks.collect()} == {"identifier", "withheld"}
    found = studies.write("baserate", checks, str(tmp_path / "base"))
    assert found["all"][0]["checks"] == 8 and {r["mode"] for r in found["by_mode"]} == {"identifier", "withheld"} and len(found["by_source_year"]) == 2
    assert "## By mode" in (tmp_path / "base" / "report.md").read_text() and json.loads((tmp_path / "base" / "summary.json").read_text())["study"] == "baserate"
    with pytest.raises(guards.DegradedStudy):
        studies.write("baserate", checks.limit(2), str(tmp_path / "base"))
    bib = r"\begin{thebibliography}{9}\bibitem{a} Brown, A. (2018). The structure of scientific progress in small fields. Journal. \bibitem{b} Smith, J. (2019). An entirely unknown study of nothing at all. Journal. doi:10.1000/gone \end{thebibliography}"
    sources = spark.createDataFrame([("p1", "cs.CY", bib), ("p2", "math.ST", bib)], "doc_id string, category string, text string")
    got = studies.preprints(verifier, sources)
    assert sorted((r.doc_id, r.kind, r.verdict) for r in got.collect()) == [(p, k, v) for p in ("p1", "p2") for k, v in (("bibliographic", "verified"), ("doi", "not_found"))]
    known = spark.createDataFrame([("p1",)], "arxiv_id string")
    assert studies.preprints(verifier, sources, known).count() == 2 and studies.preprints(verifier, sources, max_checks=3).count() == 3
    page = "{{cite journal|title=The structure of scientific progress|last=Brown|year=2018}} {{cite web|title=A page of the web somewhere|doi=10.1000/gone}}" + " x" * 5000
    got = studies.wikipedia(verifier, spark.createDataFrame([("T", page)], "title string, text string"))
    assert sorted((r.template, r.scholarly, r.kind) for r in got.collect()) == [("journal", True, "bibliographic"), ("web", False, "doi")]
    assert "By scholarly" in studies.render("wikipedia", studies.summary("wikipedia", got))


def test_guard_keeps_what_it_cannot_read(spark, tmp_path):
    out = str(tmp_path / "study")
    assert guards.write(spark.range(10).select("id", F.array(F.lit("a"), F.lit("b")).alias("x")), out) == 10
    assert guards.write(spark.read.csv(out, header=True), out) == 10  # reads what it replaces
    assert spark.read.csv(out, header=True).first().x == "a; b" and tables.checks(spark, str(tmp_path / "no")).count() == 0
