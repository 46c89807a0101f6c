import json
import math

import pytest
from pyspark.sql import functions as F

from refsift.functions import columns as c
from refsift.functions import text as t
from refsift.functions import titles as spans_of
from refsift.functions.udfs import author_overlap
from refsift.operators import corpora, extract, quotes, titles, verify
from refsift.plans import calibration, decisions, references
from refsift.plans.evidence import summary
from refsift.sinks import guards, report
from refsift.sources import authorities, documents, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson_and_newcombe(spark):
    low, high = c.wilson(F.lit(83 + 3), F.lit(567), 1.96)
    r = one(spark, low.alias("a"), high.alias("b"))
    assert (r.a, r.b) == pytest.approx((0.1245000006, 0.1835392173), abs=1e-9)
    assert one(spark, c.wilson(F.lit(0), F.lit(0))[0].alias("a")).a is None
    d, lo, hi = c.newcombe(F.lit(585), F.lit(1280), F.lit(539), F.lit(1280))
    r = one(spark, lo.alias("a"), hi.alias("b"))
    assert (r.a, r.b) == pytest.approx((-0.0025048830, 0.0742301053), abs=1e-9)


def test_planning():
    assert decisions.required_units(0.45, 0.05, 0.02, 0.01, 0.005) == (4347, 6217)
    assert 0 <= decisions.allocation_p(3.84) < 0.051
    with pytest.raises(ValueError):
        decisions.required_units(0.45, 0.02, 0.02, 0.01, 0.005)


def test_summary_never_counts_open_checks_as_failures(spark):
    rows = [("a", v) for v in ("verified", "not_found", "unreachable", "unverifiable")] + [("b", "verified"), ("b", "unreachable"), ("b", "unverifiable"), ("c", "unreachable")]
    got = {r.doc: r for r in summary(spark.createDataFrame(rows, "doc string, verdict string"), "doc").collect()}
    assert (got["a"].conclusive, got["a"].integrity_score) == (2, 0.5)
    assert (got["b"].integrity_score, got["b"].pass_low, got["b"].pass_high) == (1.0, pytest.approx(1 / 3), 1.0)
    assert got["c"].integrity_score is None and (got["c"].pass_low, got["c"].pass_high) == (0.0, 1.0)


DOI = "10.1038/nature12373"
TEXT = f"line one\nline two\n{DOI} and again {DOI}\n\nReferences\n[1] Smith, J. (2019). \"A good title for a paper\". doi:{DOI}\n[2] Jones, A. (2022). Another title that is long enough. Journal of X.\nhttps://doi.org/{DOI}"


def test_extract(spark):
    rows = extract.extract(spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")).orderBy("line", "pos").collect()
    dois = [r for r in rows if r.kind == "doi"]
    assert [r.line for r in dois] == [3, 6] and dois[0].claimed_title is None
    assert (dois[1].claimed_title, dois[1].claimed_authors, dois[1].claimed_year, dois[1].ref_number) == ("A good title for a paper", ["Smith"], 2019, 1)
    bib = [r for r in rows if r.kind == "bibliographic"]
    assert len(bib) == 1 and bib[0].claimed_year == 2022 and bib[0].claimed_title == "Another title that is long enough"


def only(spark, texts, *columns):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    return [tuple(r)[1:] for r in table.select("i", *columns).orderBy("i").collect()]


def test_trailing_punctuation_years_and_authors(spark):
    samples = {"10.1/a).": "10.1/a", "10.1/a(b)": "10.1/a(b)", "10.1/a(b)).": "10.1/a(b)", "x[1]]": "x[1]", "plain": "plain", "": "", "..": "", "a.,;:": "a", "f(g(h))))": "f(g(h))", None: None, 'q>"\'': "q"}
    assert only(spark, samples, extract.strip_trailing("s")) == [(v,) for v in samples.values()]
    refs = {
        "271 (1547): 1443--1450, 2004.": (2004, []), "Smith, J. A. (1850). On": (1850, ["Smith"]), "Smith et al. 1999": (1999, ["Smith"]), "none": (None, []), "A. (2019a) b": (2019, []),
        "Smith, J. A., Jones, B. and SMITH, C. The et al.": (None, ["Smith", "Jones"]),
    }
    assert only(spark, refs, c.year_in("s"), c.authors_in("s")) == list(refs.values())


def test_titles(spark):
    refs = {
        'Smith, J. (2019). "Random drift and culture change." J.': "Random drift and culture change.",
        "Smith, J. (2019). Random drift and culture change. Journal of X.": "Random drift and culture change",
        "Elham Tabassi. A framework for managing risk. NIST.": "A framework for managing risk",
        '"10.1000/xyz not a title" A good title here. J.': None,
        "Müller, Ö. 2004. «Une étude de la culture moderne» Revue.": "Une étude de la culture moderne",
        "Étude de la culture et du hasard. Revue.": "Étude de la culture et du hasard",
        "J. Smith, A. Jones and B. Brown. 12. pp. 3.": None, "": None, None: None,
    }
    assert only(spark, refs, spans_of.title_of("s")) == [(v,) for v in refs.values()]


def test_title_guards(spark):
    spans = {  # title, list of authors, name
        "pp. 12 of something": (False, False, False), "one": (False, False, False), "J. Smith, A. Jones and B. Brown": (False, True, False), "Attention is all you need": (True, False, False),
        "Edsger W. Dijkstra": (True, False, True), "Attention Is All You Need": (True, False, False), "Ann Smith and Bob Jones": (False, True, False), "Smith and Jones": (True, False, False),
        "Élan Vital": (True, False, True), "x" * 301 + " y": (False, False, False), "12 angry men of law": (False, False, False), "a 1 b 2 c 3 d 4": (False, False, False), None: (False, False, False),
    }
    assert only(spark, spans, spans_of.is_title("s"), spans_of.is_author_list("s"), spans_of.is_personal_name("s")) == list(spans.values())
    assert only(spark, ["a 1 b 2 c 3 d 4", "pp. 12 of something"], spans_of.is_title("s", True)) == [(True,), (False,)]


@pytest.mark.parametrize("s1, s2, second, want", [
    ("hit", None, True, "verified"), ("miss", "hit", True, "verified"), ("miss", "miss", True, "not_found"), ("miss", "unreachable", True, "unreachable"),
    ("miss", "miss", False, "unverifiable"), ("unreachable", "hit", True, "unreachable"),
])
def test_fallback_truth_table(spark, s1, s2, second, want):
    a = spark.createDataFrame([("10.1000/x", s1, 1)], "doi string, status string, title_key int")
    b = spark.createDataFrame([("10.1000/x", s2 or "miss", 1)], "doi string, status string, title_key int")
    cites = spark.createDataFrame([("10.1000/x", 1), ("bad", 1), (None, 1)], "identifier string, claimed_key int")
    got = {r.identifier: r.verdict for r in verify.two_stage(cites, a, b, second).collect()}
    assert got == {"10.1000/x": want, "bad": "malformed", None: "unverifiable"}


def test_assess(spark):
    rows = [(90.0, None, "verified"), (65.9, None, "mismatch"), (65.9, 0.8, "verified"), (66.0, None, "verified"), (None, 0.0, "verified")]
    got = spark.createDataFrame(rows, "sim double, overlap double, want string").select("want", c.assess("sim", "overlap").alias("v")).collect()
    assert all(r.want == r.v for r in got)


def test_quotes(spark):
    quote = "one two three four five six seven eight nine ten"
    text = f'See "{quote}" [2] here.\nOr “{quote} eleven\ntwelve” (9).\nlast\nReferences\n"{quote} never"'
    found = quotes.quotes(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = found.orderBy("pos").collect()
    assert [(r.line, r.end_line, r.marker) for r in rows] == [(1, 1, 2), (2, 3, 9)] and rows[1].text.endswith("eleven twelve")
    cites = spark.createDataFrame([(1, 7, 0, 2, "10.1/a"), (1, 4, 0, None, "10.1/b"), (1, 2, 0, None, "10.1/c")], "doc_id long, line int, pos int, ref_number int, identifier string")
    got = {r.pos: r.identifier for r in quotes.attribute(found, cites).collect()}
    assert got == {0: "10.1/a", 1: "10.1/b"}
    sources = spark.createDataFrame([("10.1/a", "full", "x " * 50), ("10.1/b", "abstract", "y " * 50)], "identifier string, coverage string, source_text string")
    verdicts = {r.pos: r.verdict for r in quotes.judge(quotes.attribute(found, cites), sources).collect()}
    assert verdicts == {0: "not_found", 1: "absent_from_abstract"}


def test_sweep(spark):
    rows = [("same", float(x)) for x in (98, 95, 92, 88, 84)] + [("different", float(x)) for x in (10, 18, 25, 33, 41)] + [("same", None)]
    curve = calibration.sweep(spark.createDataFrame(rows, "label string, similarity double"), [4, 60])
    got = {r.threshold: r for r in curve.collect()}
    assert (got[60].precision, got[60].recall) == (1.0, 1.0) and got[4].recall == 0.0 and got[4].precision is None
    assert calibration.operating_point(curve).first().threshold == 60


def test_corpora(spark):
    wiki = "{{Cite journal |title=On [[a|the thing]] in question |last=Smith |year=1999|doi=10.1000/X}} {{cite web|title=short}} {{Cite book|chapter=A chapter of some length|author=Jane Doe|date=May 2001}}"
    rows = corpora.wiki_references(spark.createDataFrame([(1, wiki)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.template, r.title, r.author, r.year, r.scholarly) for r in rows] == [("journal", "On the thing in question", "Smith", 1999, True), ("book", "A chapter of some length", "Doe", 2001, False)]
    assert corpora._bibliography(b"not an archive") is None


def test_archive_prefers_bbl():
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in (("a.bib", b"@article{x}"), ("a.bbl", b"\\bibitem{a} x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert corpora._bibliography(out.getvalue()) == "\\bibitem{a} x"


def test_authority_records(spark):
    crossref = json.dumps({"message": {"DOI": "10.1/X", "title": ["T"], "author": [{"family": "Smith"}, {"name": "Team"}], "issued": {"date-parts": [[2001, 2]]}}})
    r = one(spark, authorities.crossref(F.lit(crossref)).alias("w")).w
    assert (r.doi, r.title, r.authors, r.year) == ("10.1/x", "T", ["Smith", "Team"], 2001)
    assert one(spark, authorities.crossref(F.lit("{}")).alias("w")).w is None
    alex = json.dumps({"id": "W1", "doi": "https://doi.org/10.1/X", "display_name": "T", "authorships": [{"author": {"display_name": "Ann B Cole"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}})
    r = one(spark, authorities.openalex(F.lit(alex)).alias("w")).w
    assert (r.doi, r.title, r.authors, r.abstract) == ("10.1/x", "T", ["Cole"], "a b a")
    feed = "<feed><entry><id>http://arxiv.org/abs/1234.5678v2</id><title>A  T</title><published>2012-01-01</published><author><name>Ann Cole</name></author></entry></feed>"
    r = one(spark, authorities.arxiv(F.lit(feed)).alias("w")).w
    assert (r.arxiv_id, r.title, r.year) == ("1234.5678", "A T", 2012)
    assert one(spark, authorities.arxiv(F.lit(feed.replace("A  T", "Error"))).alias("w")).w is None


def test_fetch_asks_only_what_is_missing(spark):
    urls = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://h/c",)], "url string")
    known = spark.createDataFrame([("http://h/a", "hit", 200, None, ""), ("http://h/b", "unreachable", 500, None, "")], authorities.RESPONSE)
    got = {r.url: r.status for r in authorities.fetch(urls, known, lambda u: ("miss", 404, None)).collect()}
    assert got == {"http://h/b": "miss", "http://h/c": "miss"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"text \xff")
    (tmp_path / "b.html").write_text("<p>one</p><script>x</script>two")
    assert documents.read(spark, str(tmp_path / "a.md")).first().text.startswith("text ")
    assert documents.read(spark, str(tmp_path / "b.html")).first().text.split() == ["one", "two"]
    with pytest.raises(documents.UnsupportedDocument):
        documents.read(spark, "x.exe")
    assert documents.expand(spark, f"{tmp_path}/*.md {tmp_path}/none*")[1].endswith("none*")
    with pytest.raises(ValueError):
        documents.expand(spark, "--flag")
    out = str(tmp_path / "study")
    rows = spark.createDataFrame([(i, ["a", "b"]) for i in range(10)], "i int, names array<string>")
    assert guards.write(rows, out) == 10
    with pytest.raises(guards.DegradedStudy):
        guards.write(rows.limit(2), out)
    with pytest.raises(guards.EmptyStudy):
        guards.write(rows.limit(0), out)
    assert guards.write(rows.limit(2), out, allow_smaller=True) == 2
    assert tables.checks(spark, str(tmp_path / "none")).count() == 0


def test_report():
    rows = [{"verdict": v, "line": i, "claimed_title": f"<t|{i}>", "detail": "d"} for i, v in enumerate(("verified", "mismatch", "unreachable"))]
    assert report.counts(rows)["integrity_score"] == 0.5
    assert "&lt;t|1&gt;" in report.as_html("x", rows) and "<t" not in report.as_html("x", rows).replace("<td>", "").replace("<table>", "").replace("<title>", "").replace("<tr", "").replace("<th>", "")
    assert "\\|" in report.markdown("x", rows)
    assert report.exit_code(rows) == 1 and report.exit_code(rows[:1]) == 0 and report.exit_code(rows[2:], strict=True) == 1
    assert report.exit_code(rows[2:], fail_under=90) == 0
    half = [dict(rows[0], verdict="verified"), dict(rows[0], verdict="mismatch")]
    assert report.exit_code(rows[:1], fail_under=100) == 0 and report.counts(half)["integrity_score"] == 0.5
    one_of_two = [dict(rows[0], verdict="verified")] * 4 + [dict(rows[0], verdict="verified")]
    assert [report.exit_code(one_of_two, fail_under=x) for x in (99.0, 100.0, 100.5)] == [0, 0, 1]
    assert len(report.sparkline([0, 1] * 50)) == 46 and math.isclose(report.counts(rows)["check_coverage"], 2 / 3)


def test_stream_accumulates(spark, tmp_path):
    from refsift.streaming import lifecycle

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "arxiv_id string, n int")
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        rows.write.mode("append").parquet(src)
        lifecycle.accumulate(spark.readStream.schema(rows.schema).parquet(src), dst, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.arxiv_id for r in spark.read.parquet(dst).collect()) == ["a", "b"]


def test_verifier_and_command_line(spark, tmp_path, capsys):
    from refsift import cli
    from refsift.verifier import ARXIV, DOI, URL, WORK, Verifier

    text = (
        'Body 10.1000/a and http://dead.example/x and arXiv:1234.56789v2.\nReferences\n[1] Smith, J. (2001). "The right title of a work". doi:10.1000/b\n'
        '[2] Smith, J. (2001). "Something else entirely here". doi:10.1000/c\n[3] Jones, A. (2002). A paper on searching works well. Journal.\n[4] Doe, J. (2003). No such paper was ever printed. Journal.\n'
        "doi:10.1000/gone and doi:10.1000/down"
    )
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    first = spark.createDataFrame([("10.1000/a", "hit", "Any", ["X"], 2000), ("10.1000/b", "hit", "The Right Title of a Work", ["Smith"], 2001), ("10.1000/c", "hit", "Wholly different matter", ["Poe"], 1990), ("10.1000/down", "unreachable", None, None, None)], DOI)
    second = spark.createDataFrame([], DOI)
    arxiv = spark.createDataFrame([("1234.56789", "hit", "T", ["X"], 2012)], ARXIV)
    urls = spark.createDataFrame([("http://dead.example/x", "miss")], URL)
    works = spark.createDataFrame([(1, "A paper on searching works well", ["Jones"], 2002), (2, "Another paper", ["Roe"], 2000)], WORK)
    v = Verifier(first=first, second=second, arxiv=arxiv, urls=urls, works=works)
    got = {r.identifier or r.claimed_title: r.verdict for r in v.findings(docs).collect()}
    assert got == {
        "10.1000/a": "verified", "10.1000/b": "verified", "10.1000/c": "mismatch", "10.1000/gone": "not_found", "10.1000/down": "unreachable", "1234.56789v2": "verified",
        "http://dead.example/x": "not_found", "A paper on searching works well": "verified", "No such paper was ever printed": "not_found",
    }
    assert {r.verdict for r in Verifier().findings(docs).collect()} == {"unverifiable"}
    (tmp_path / "a.txt").write_text("See 10.1000/a.")
    first.write.parquet(str(tmp_path / "first"))
    assert cli.main([str(tmp_path / "a.txt"), "--first", str(tmp_path / "first"), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["verified"] == 1
    assert cli.main([str(tmp_path / "a.exe"), "--first", str(tmp_path / "first")]) == 2


def common_titles():
    """Titles of common words alone, some equal, some empty, one with accents and one without a word."""
    from itertools import product

    made = [f"{a} {b} of {c}" for a, b, c in product(("small", "red", "blue", "small red"), ("ring", "bolt", "gear", "rings"), ("steel", "steels", "tin", "brass"))]
    return list(enumerate([*made, *made[:9], "Café of tin", "cafe tin", "...", "", None]))


def test_nearest_titles_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(titles, "WORKS", 40)
    monkeypatch.setattr(titles, "CLAIMS", 30)
    rows = common_titles()
    works = spark.createDataFrame(rows, "work_id long, title string")
    got = {}
    for r in titles.nearest(works.toDF("claim_id", "claimed_title"), works, 2, 92.0).collect():
        got.setdefault(r.claim_id, []).append((-r.similarity, r.work_id))
    for i, a in rows:
        scores = [(-s, j) for j, b in rows if i != j and (s := t.title_similarity(a, b)) is not None and s <= 92]
        assert sorted(got.get(i, []))[:2] == sorted(scores)[:2]


def test_exact_passages_are_those_of_brute_force(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota".split()
    passages = [" ".join(words[:n]) for n in range(1, 10)] + ["", " beta gamma\ndelta  epsilon zeta eta ", "eta theta iota kappa lambda mu", "alphabet"]
    items = [*enumerate(passages), (3, "a second text of item three here"), (99, None)]
    held = [p for p in passages if len(p) > 1] + ["a second text of item three here"]
    texts = [lead + p + tail for p in held for lead, tail in (("", ""), ('see "', '".'), ("x ", " y"), ("(pre", "post)"))] + ["none", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = references.holding(docs, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()
    want = [(i, j) for i, x in enumerate(texts) for j, p in items if x is not None and p is not None and p in x]
    assert sorted(map(tuple, got)) == sorted(want)


def test_candidates_are_those_of_brute_force(spark):
    rows = common_titles()
    works = spark.createDataFrame(rows, "work_id long, title string")
    claims = [(1, "Smal red ring of steels"), (2, "blue bolts of brass"), (3, "SMALL RED RING OF STEEL"), (4, "gear of brass red"), (5, "short"), (6, "nothing at all alike here"), (7, "redd riing off steeel"), (8, None)]
    got = verify.candidates(spark.createDataFrame(claims, "claim_id long, claimed_title string"), works, 2).collect()
    want = {(i, j): s for i, a in claims for j, b in rows if a and len(a) >= verify.MIN_TITLE and (s := t.title_similarity(a, b)) is not None and s >= 75}
    assert {(r.claim_id, r.work_id): r.similarity for r in got} == want and len(got) == len(want)
    assert {i for i, _ in want} == {1, 2, 3, 4, 7}


def test_search_finds_a_misspelt_title_of_common_words(spark):
    from refsift.verifier import WORK, Verifier

    works = [(i, name, ["Smith"], 2001) for i, name in common_titles() if name]
    text = "References\n[1] Smith, J. (2001). Smal red ring of steel. Journal of X.\n[2] Smith, J. (2001). Wholly different matters of law. Journal of X."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = Verifier(works=spark.createDataFrame(works, WORK), common=2).findings(docs).where("kind = 'bibliographic'").collect()
    assert {r.claimed_title: r.verdict for r in found} == {"Smal red ring of steel": "verified", "Wholly different matters of law": "not_found"}


def test_fuzzy_passages_are_those_of_brute_force(spark):
    """Edits at every place, in every third word and in every word; short, empty and missing texts."""
    passage = "The committee found that several earlier reports had been written without any regard for evidence, and withdrew them."
    words = passage.split()
    every = lambda n: " ".join(w[:-1] if i % n == 0 and len(w) > 2 else w for i, w in enumerate(words))
    edited = [" ".join([*words[:i], w, *words[i + 1 :]]) for i in range(len(words)) for w in ("", "changed", words[i][:2] + " " + words[i][2:])]
    filler = "Of other things there is more to be said than fits on this page. " * 3
    texts = [filler + p + " " + filler for p in [passage, *edited, every(3), every(1), words[0]]] + [filler * 8 + passage.upper(), passage[:60], "", None, "to be", filler]
    items = [(1, passage), (2, "to be"), (3, "of others"), (4, ""), (5, None), (6, passage + " " + filler)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quotes.similar(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, j): s for i, x in enumerate(texts) for j, q in items if (s := t.find_passage(q, x)[0]) >= 88}
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == want and len(got) == len(want)
    assert {(i, 1) for i in range(len(edited) + 2)} <= set(want)


def test_passages_held_are_those_of_brute_force():
    """Random edits of all kinds, up to and beyond the bound, in texts of the same few syllables; long and short passages, texts shorter than a passage."""
    import random

    from refsift.functions.passages import Passages

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("th er on in re an ha ou ti a".split()) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (1, 2, 4, 9, 14, 25)] + ["", None, "Ångström ñ_1", "a b c d e f g h i j k l m n o"]

    def edited(text, share, kinds):
        out = []
        for c in text:
            kind = rng.choice(kinds) if rng.random() < share else "keep"
            out += {"keep": [c], "drop": [], "put": [c, rng.choice("thxq ")], "swap": [rng.choice("erxq ")]}[kind]
        return "".join(out)

    texts = [None, "", "a", " ".join("abcdefghijklmno")]
    for q in filter(None, passages):
        for share, kinds in ((0, ["drop"]), (0.1, ["swap"]), (0.13, ["swap"]), (0.2, ["drop"]), (0.25, ["put"]), (0.12, ["drop", "put", "swap"])):
            near = edited(q, share, kinds)
            texts += [near, near[: len(near) * 5 // 6], near + " " + prose(12), prose(12) + ", " + near.upper() + prose(6)]
    scores = {(i, j): t.find_passage(q, x)[0] for i, x in enumerate(texts) for j, q in enumerate(passages)}
    held = 0
    for least in (88.0, 70.0, 100.0):
        got = list(Passages(passages, least).held(texts))
        want = {pair: s for pair, s in scores.items() if s >= least}
        assert {(i, j): s for i, j, s in got} == want and len(got) == len(want)
        held += sum(s < 100 for s in want.values())
    assert held > 100


def test_passages_are_compared_where_they_share_runs(monkeypatch):
    """Of all blocks of passages at all places of texts of the same syllables, few are compared by edits."""
    import random

    from refsift.functions.passages import Passages

    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    passages, texts, cells = [prose(40) for _ in range(20)], [prose(600) for _ in range(10)], []
    texts[3] = prose(50) + passages[7].replace("a", "e", 9) + prose(50)
    nearest = Passages._nearest

    def counted(self, *args):
        cells.append(args[-1].size * (1 if len(args) > 1 else len(self.size)))
        return nearest(self, *args)

    monkeypatch.setattr(Passages, "_nearest", counted)
    searched = Passages(passages, 88.0)
    assert [(i, j) for i, j, _ in searched.held(texts)] == [(3, 7)]
    assert sum(cells) < 0.1 * sum(map(len, texts)) * len(searched.size)


def test_passages_by_id_are_looked_for_in_all_documents(spark, tmp_path):
    from refsift.queries import QUERIES

    passage = "several earlier reports had been written without any regard for evidence"
    items = [(0, passage), (50, "a wholly different passage of other words, that nobody quotes"), (51, passage), (100, passage.replace("earlier", "later")), (None, passage)]
    docs = [(i, f"In part {i}: " + x + " and so on.") for i, x in enumerate([passage, passage.upper(), passage.replace("earlier", "later"), passage.replace("e", ""), "nothing"])] + [(9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.verdict) for r in QUERIES["q28_passage_fuzzy"](spark, str(tmp_path)).collect()}
    want = {(i, j): (s, "found") for i, x in docs for j, q in items if j in (0, 50, 100) and (s := t.find_passage(q, x)[0]) >= 88}
    want[None, 50] = (None, "absent_from_excerpt")
    assert got == want and {(0, 0), (1, 0), (2, 0), (2, 100)} <= set(want)


def test_pages_of_one_url_keep_their_own_status(spark, tmp_path):
    """URLs that come more than once, pages without a URL or a number, and a row that comes twice."""
    import duckdb

    from refsift.queries import ORACLES, QUERIES

    rows = [(7, "http://a.example/x"), (8, "http://a.example/x"), (11, "http://a.example/x"), (11, None), (None, "http://a.example/x"), (14, "no url"), (14, "no url"), (1, None)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.connect().sql(ORACLES["q08_url_status"].replace("pages p", f"'{tmp_path}/pages.parquet/*.parquet' p")).fetchall()
    got = QUERIES["q08_url_status"](spark, str(tmp_path)).select("host", "verdict", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_search_is_first_plausible_of_all_candidates(spark, monkeypatch):
    """Over several blocks, with copies of titles, names that agree, some that don't, and none."""
    monkeypatch.setattr(titles, "WORKS", 40)
    monkeypatch.setattr(titles, "CLAIMS", 3)
    names = [["Smith"], ["Jones", "Smíth"], [], None, ["Other"]]
    works = spark.createDataFrame([(i, name, names[i % 5]) for i, name in common_titles()], "work_id long, title string, authors array<string>")
    asked = ["Smal red ring of steels", "blue bolts of brass", "SMALL RED RING OF STEEL", "gear of brass red", "short", "nothing at all alike here", "redd riing off steeel", None, "small red gear of tin and of brass and of steel " * 3]
    rows = [(2 * i + k, name, who) for i, name in enumerate(asked) for k, who in enumerate((["smith", "Nobody"], None))]
    claims = spark.createDataFrame(rows, "claim_id long, claimed_title string, claimed_authors array<string>")
    scored = verify.candidates(claims, works).join(claims.select("claim_id", "claimed_authors"), "claim_id").join(works.select("work_id", "authors"), "work_id")
    want = verify.first_plausible(scored.withColumn("overlap", author_overlap("claimed_authors", "authors"))).collect()
    got = verify.search(claims, works).collect()
    assert len(want) > 6 and any(r.accepted is None for r in want) and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pairs_of_blocks_are_not_written(spark, monkeypatch):
    """Blocks of claims and of works meet in a product of partitions, and no shuffle follows it."""
    monkeypatch.setattr(titles, "WORKS", 40)
    works = spark.createDataFrame(common_titles(), "work_id long, title string")
    plan = titles.nearest(works.toDF("claim_id", "claimed_title"), works, 2, 92.0)._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("CartesianProduct")]
    assert "MapInArrow" in head and "Exchange" not in head


def test_the_texts_of_a_check_are_read_once(spark):
    """Every kind of citation comes from one kept table, which release() gives back."""
    from refsift.verifier import WORK, Verifier

    docs = spark.createDataFrame([(1, "See doi:10.1000/a and https://a.example/x\nReferences\n[1] Smith, J. (2001). Small red ring of steel. Journal of X.")], "doc_id long, text string")
    verifier = Verifier(works=spark.createDataFrame([(1, "small red ring of steel", ["Smith"], 2001)], WORK))
    found = verifier.findings(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 4 and "Generate" not in plan.replace("InMemoryRelation", "\n").split("\n")[0]
    assert {(r.kind, r.verdict) for r in found.collect()} == {("doi", "unverifiable"), ("url", "unverifiable"), ("bibliographic", "verified")}
    kept = verifier._kept[0]
    assert kept.is_cached
    verifier.release()
    assert not kept.is_cached and not verifier._kept


def test_made_up_documents_are_read_by_all_tasks(spark):
    found = references.docs(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
    assert len(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))
