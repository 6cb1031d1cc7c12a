"""Segmentation, classification, repairs and evaluation on own fixtures; queries against DuckDB."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from winnowry.functions import handlers, segment, stopwords, text
from winnowry.functions.dom import body_of, parse
from winnowry.operators import classify, dedup, paragraphs
from winnowry.plans import evaluate, extract, output


def cut(html: str):
    return segment.paragraphs(segment.tree(html))


def test_tree_builder_repairs_pages():
    root = parse("<p>a<p>b<ul><li>c<li>d</ul><script>var x='</p>'</script><table><tr><td>1<td>2<tr><td>3</table>tail &am")
    assert [n.tag for n in body_of(root).children if not isinstance(n, str)] == ["p", "p", "ul", "script", "table"]
    assert len(list(root.iter("li"))) == 2 and [len(list(r.iter("td"))) for r in root.iter("tr")] == [2, 1]
    assert parse("").tag == "html" and parse("<div" * 400).tag == "html"


@pytest.mark.parametrize(
    ("html", "want"),
    [("", []), ("a<br/>b", ["a\nb"]), ("x <br><br> y", ["x", "y"]), ("<p>one<p>two", ["one", "two"]), ("<ol><li>a<li>b</ol>", ["1. a\n2. b"]), ("<ul class=navmenu><li>a<li>b</ul>", ["a b"]), ("<pre> x\n   y</pre>", [" x\n   y"]), ("<head><title>no</title></head><p>yes", ["yes"]), ("<button><form>x</form></button>", [])],
)
def test_segmentation(html, want):
    assert [p.text for p in cut(html)] == want


def test_paths_and_links():
    found = cut("<div><p>text <a href=x>link</a></p><p>two</p></div>")
    assert [(p.dom_path, p.xpath, p.link_chars) for p in found] == [("html.body.div.p", "/html[1]/body[1]/div[1]/p[1]", 4), ("html.body.div.p", "/html[1]/body[1]/div[1]/p[2]", 0)]


def test_data_tables_become_lines():
    rows = "".join(f"<tr><td>n{i}<td>{i}" for i in range(3))
    (p,) = cut(f"<table><tr><th>Name<th>N{rows}</table>")
    assert p.text == "Name | N\n--- | ---\nn0 | 0\nn1 | 1\nn2 | 2" and p.verbatim
    assert segment.is_calendar([["1", "2", "3", "4", "5", "6", "7"]] * 3) and not segment.is_calendar([["²", "x"]])
    assert segment.numeric_share([["1.5", "x"], ["20%", ""]]) == pytest.approx(2 / 3)


def test_handlers():
    post = lambda i: f"<div class=post><span class=username>u{i}</span><span class=date>Jan {i}, 2010</span><div id=post_message_{i}>body {i}</div></div>"
    name, out = handlers.handled(parse("<h1>T</h1>" + post(1) + post(2)), "")
    assert name == "postbit" and [p.text for p in out] == ["T", "**u1** (Jan 1, 2010):", "body 1", "**u2** (Jan 2, 2010):", "body 2"]
    assert handlers.handled(parse(post(1)), "") is None
    page = "<h1>Q</h1><div id=question><div class=post-text>ask</div></div><div class='answer accepted-answer'><div class=post-text>yes</div></div><div class=answer><div class=post-text>no</div></div>"
    assert [p.text for p in handlers.question_page(parse(page), page)] == ["Q", "**Question**", "ask", "**Answer** (accepted)", "yes", "**Answer**", "no"]
    meta = handlers.comment_meta(parse("".join(f"<li id=comment-{i}><b class=fn>a{i}</b><div class=comment-content>text {i}</div></li>" for i in (1, 2))))
    assert meta == [("text 1", "a1", ""), ("text 2", "a2", "")]
    assert handlers.with_authors(["intro", "text 1", "text 2"], meta) == [(1, "**Comments**"), (1, "*a1*:"), (2, "*a2*:")]
    data = 'window.__INITIAL_STATE__ = {"collectionAlias":"c","item":{"ocr":"' + "word " * 100 + '"}};'
    assert handlers.handled(parse(f"<script>{data}</script>"), data)[0] == "collection"


def test_text_repairs(spark):
    assert text.fix_mojibake("cafÃ© â€” naÃ¯ve") == "café — naïve" and text.fix_mojibake("plain") == "plain"
    assert text.latex_text(r"$\frac{a}{b} \leq x^2$") == "(a)/(b) ≤ x²"
    assert text.decode_bytes(b"<meta charset=iso-8859-2>\xb1") == "<meta charset=iso-8859-2>ą" and text.decode_bytes("é".encode()) == "é"
    with pytest.raises(text.DecodeError):
        text.decode_bytes(b"\xff\xfe\xfa", default="ascii", errors="strict")
    row = spark.createDataFrame([("a  \n b  c", "[[x|y]] '''z''' {{t}}", "<a@b.org>", "1 &amp;lt; 2", "cafÃ©")], "a string, b string, c string, d string, e string")
    got = row.select(text.normalize_whitespace(F.col("a")), text.clean_wiki_markup(F.col("b")), text.escape_angle_emails(F.col("c")), text.decode_double_entities(F.col("d")), text.repair_mojibake(F.col("e"))).first()
    assert list(got) == ["a\nb c", "y z ", "&lt;a@b.org&gt;", "1 &lt; 2", "café"]
    blank = spark.createDataFrame([("",), ("  \t",), ("x",)], "s string").select(text.is_blank(F.col("s")).alias("b"))
    assert [r.b for r in blank.collect()] == [True, True, False]
    assert text.repair_replacement_chars("don�t", {}, {("n", "t"): "’"}) == "don’t"


def test_stop_words():
    assert "the" in stopwords.words("en") and stopwords.words("english") == stopwords.words("en")
    with pytest.raises(ValueError):
        stopwords.words("klingon")


def context(cf: list[str], lengths: list[int], headings: list[bool], far: int = 200) -> list[str]:
    """The passes as plain loops."""

    def near(cls, i, step, also=False):
        j = i + step
        while 0 <= j < len(cls):
            if cls[j] in ("good", "bad") or (also and cls[j] == "neargood"):
                return cls[j]
            j += step
        return "bad"

    a = list(cf)
    for i, c in enumerate(cf):
        if c == "short":
            p, n = near(cf, i, -1), near(cf, i, 1)
            mixed = (p == "bad" and near(cf, i, -1, True) == "neargood") or (n == "bad" and near(cf, i, 1, True) == "neargood")
            a[i] = p if p == n else "good" if mixed else "bad"
    b = list(a)
    for i, c in enumerate(a):
        if c == "neargood":
            b[i] = "bad" if (near(a, i, -1), near(a, i, 1)) == ("bad", "bad") else "good"
    out = list(b)
    for i, c in enumerate(b):
        if headings[i] and c == "bad" and cf[i] != "bad":
            between = 0
            for j in range(i + 1, len(b)):
                if b[j] == "good":
                    if between <= far:
                        out[i] = "good"
                    break
                between += lengths[j]
    return out


def test_windows_equal_loops(spark):
    r = random.Random(3)
    rows, want = [], {}
    for page in range(60):
        n = r.randrange(1, 14)
        cf = [r.choice(["good", "neargood", "short", "bad"]) for _ in range(n)]
        lengths, headings = [r.randrange(1, 150) for _ in range(n)], [r.random() < 0.3 for _ in range(n)]
        rows += [(page, 0, i, cf[i], lengths[i], headings[i]) for i in range(n)]
        want.update({(page, i): c for i, c in enumerate(context(cf, lengths, headings))})
    df = spark.createDataFrame(rows, "page_id long, variant int, idx int, cf_class string, length int, heading boolean")
    got = {(x.page_id, x.idx): x.class_type for x in classify.in_context(df).collect()}
    assert got == want


def rows_of(spark, given):
    """(text, class, dom_path, xpath) rows of one page."""
    full = [(1, 0, i, t, c, d, x, 0.0, len(t), False) for i, (t, c, d, x) in enumerate(given)]
    return spark.createDataFrame(full, "page_id long, variant int, idx int, text string, class_type string, dom_path string, xpath string, link_density double, length int, verbatim boolean")


def test_list_and_table_repairs(spark):
    li = lambda t, c="good": (t, c, "body.ul.li", "/body[1]/ul[1]")
    got = classify.fix_list_markers(rows_of(spark, [li("-"), li("noise", "bad"), li("item"), li("a\n-\nb")])).orderBy("idx").collect()
    assert [(r.text, r.class_type) for r in got] == [("-", "bad"), ("noise", "bad"), ("- item", "good"), ("a\n- b", "good")]
    got = classify.fix_doubled_numbers(rows_of(spark, [li("1. 1 mix"), li("2. 2 bake"), li("3."), li("3 eat")])).orderBy("idx").collect()
    assert [(r.text, r.class_type) for r in got] == [("1. mix", "good"), ("2. bake", "good"), ("3.", "bad"), ("3. eat", "good")]
    table = [(f"row {i} abc", "good" if i < 2 else "bad", "body.table.tr", f"/body[1]/table[1]/tr[{i}]") for i in range(9)]
    assert {r.class_type for r in classify.merge_table_rows(rows_of(spark, table)).collect()} == {"good"}
    assert {r.class_type for r in classify.merge_table_rows(rows_of(spark, table[:7])).collect()} == {"good", "bad"}
    assert classify.drop_ui_labels(rows_of(spark, [li("Share"), li("Shares")])).where("class_type = 'good'").count() == 1


def test_dedup_by_index_equals_all_comparisons():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = [" ".join(word() for _ in range(20)) for _ in range(60)]
    texts += [texts[3], texts[4].replace(texts[4][10], "z", 1), " ".join(texts[5].split()[:12])]
    flags = dedup.greedy(texts)
    assert flags == [False] * 60 + [True] * 3
    few = ["abcdefghijkl", "ponmlkjihgfe"] + ["".join(r.choice("ab ") for _ in range(r.randrange(12, 70))) for _ in range(150)]
    long = ["".join(r.choice("abcdef ") for _ in range(r.randrange(40, 300))) for _ in range(12)]
    for t in list(long):
        for n in (1, 2, 4, 8):
            edited = list(t)
            for _ in range(n):
                edited[r.randrange(len(edited))] = r.choice(["", "z", "yz"])
            long.append("".join(edited)[r.randrange(0, 9) :])
    for some in (texts, few, long, ["same text of it"] * 5):
        kept, want = [], []
        for t in some:
            want.append(any(dedup.same(t, k) for k in kept))
            if not want[-1]:
                kept.append(t)
        assert dedup.greedy(some) == want
    assert dedup.partial_ratio("abc", "xxabcxx") == 100 and dedup.ratio("", "") == 100


def test_near_duplicates_of_long_pages_take_few_comparisons(monkeypatch):
    r = random.Random(8)
    word = [f"{a}{b}en" for a in ("st", "br", "kl", "m", "w") for b in ("a", "e", "o", "u")]
    texts = [" ".join(r.choice(word) for _ in range(r.randrange(12, 60))) for _ in range(300)]
    texts += [texts[7][:-1] + "x", texts[9][10:]]
    made = []
    monkeypatch.setattr(dedup, "lcs", lambda a, b, lcs=dedup.lcs: made.append(1) or lcs(a, b))
    flags = dedup.greedy(texts)
    assert flags == [False] * 300 + [True] * 2 and len(made) < 2_000
    monkeypatch.setattr(dedup, "SEARCHED", 0)
    assert dedup.greedy(texts) == flags


def test_white_space_without_rewriting_equals_rewriting(spark):
    r = random.Random(4)
    given = ["", " ", "a", "a b", " a", "a ", "a  b", "\r", "a \r b", "a\n\n b\u2003c", "x\x85y", "tab\tz \u3000", "“q” \u00a0é", "\U0001f600 a  b"]
    given += ["".join(r.choice("ab é \t\n\r\x1c\u2028😀") for _ in range(r.randrange(1, 15))) for _ in range(300)]
    c = F.col("c")
    df = spark.createDataFrame([(t,) for t in [*given, None]], "c string")
    rows = df.select("c", text.squeezed(c).alias("s"), text.one_line(c).alias("o"), text.words(c).alias("w"), text.strip(c).alias("t"), text.normalize_whitespace(c).alias("n")).collect()
    import re

    for x in rows:
        if x.c is None:
            assert x.s is x.o is x.w is x.t is x.n is None
            continue
        lines = re.sub(r"\s+", lambda m: "\n" if "\n" in m[0] or "\r" in m[0] else " ", x.c)
        assert (x.s, x.o, x.w, x.t, x.n) == (lines.strip(), " ".join(x.c.split()), x.c.split(), x.c.strip(), lines)
    # long runs of blanks took the square of their length
    long = spark.createDataFrame([("a" + " " * 300_000 + "b",)], "c string")
    assert long.select(text.squeezed(c).alias("s"), text.normalize_whitespace(c).alias("n")).first() == ("a b", "a b")


def test_scores(spark):
    df = spark.createDataFrame([("a b c", "a c d"), ("", ""), ("x", "")], "pred string, gold string")
    got = evaluate.score(df).collect()
    assert got[0].rougeL_f == pytest.approx(2 / 3) and got[1].rougeL_f == 1.0 and got[2].rougeL_f == 0.0
    assert got[1].lev_similarity == 1.0 and got[0].lev_distance == 2
    with pytest.raises(ValueError):
        evaluate.guard_split("test")
    ops = df.limit(1).select(evaluate.diff(F.col("gold"), F.col("pred")).alias("d")).first().d
    assert [o.op for o in ops] == ["equal", "insert", "equal", "delete"]


def test_extract_and_outputs(spark):
    good = "This is the text that we want to have and it is long enough to be of the good kind for all of us."
    html = f"<html lang=en><body><ul><li><a href=x>home</a><li><a href=y>about</a></ul><h1>Title</h1><p>{good}</p><p>{good[:60]}</p><p>&copy; us</p></body></html>"
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert got[1].text.startswith("Title\n\nThis is") and "home" not in got[1].text and got[2].text == got[3].text == ""
    rows = extract.classified(pages, variants=False)
    lines = [r.line for r in output.default(rows).orderBy("idx").collect()]
    assert lines[0] == "<h> Title" and lines[1].startswith("<p> This")
    assert any("\t" in r.line for r in output.krdwrd(rows).collect()) and 'xpath="/html[1]' in output.detailed(rows).first().line
    nav = html.replace("<body>", "<body><div><a href=a>one two</a> <a href=b>three</a></div>")
    assert extract.extract(spark.createDataFrame([(1, nav)], "page_id long, html string")).first().text == got[1].text


def test_stream_segments_pages(spark, tmp_path):
    spark.createDataFrame([(1, "<p>one<p>two")], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    from winnowry import streaming

    stream = spark.readStream.schema("page_id long, html string").parquet(str(tmp_path / "in"))
    q = streaming.segment_stream(stream).writeStream.format("memory").queryName("seg").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.text for r in spark.table("seg").orderBy("idx").collect()] == ["one", "two"]


def test_wiki_marks_are_undone_by_paragraph(spark):
    long = "This is what we have to say of it, and it is as long as it must be for it to be kept by the rules."
    pages = spark.createDataFrame([(1, f"<p>{long} [[Page|Link]]</p><pre>a == '''x'''</pre><p>{long} '''y'''</p>")], "page_id long, html string")
    got = extract.extract(pages).first().text
    assert "Link" in got and "[[" not in got and "'''y'''" in got


def test_extract_drops_repeats_and_takes_models(spark):
    from winnowry.operators import learned

    long = "This is what we have to say of it, and it is as long as it must be for it to be kept by the rules."
    pages = spark.createDataFrame([(1, f"<p>{long}<p>{long[:-1]}!<p>{long[:60]} and then something else of the same kind that we want.")], "page_id long, html string")
    counts = [extract.extract(pages, drop_repeats=x).first().n_kept for x in (False, True)]
    assert counts == [3, 2]
    rows = learned.features(extract.classified(pages)).withColumn("label", F.lit(1.0))
    model = learned.forest(learned.columns()).fit(rows.select("label", *learned.columns()).unionByName(rows.select("label", *learned.columns()).withColumn("label", F.lit(0.0))))
    assert extract.extract(pages, model=model).count() == 1


ORACLES = [(m, name) for m in ("queries", "page_queries", "table_queries") for name in sorted(__import__(f"winnowry.{m}", fromlist=["QUERIES"]).QUERIES)]


@pytest.mark.parametrize("module,name", ORACLES)
def test_queries_match_duckdb(spark, module, name):
    import importlib
    import os

    duckdb = pytest.importorskip("duckdb")
    module = importlib.import_module(f"winnowry.{module}")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    sql = module.oracles().get(name)
    if sql is None:
        pytest.skip("not for SQL")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    a, b = module.QUERIES[name](spark, d).toPandas(), con.execute(sql).df()
    cols = sorted(a.columns)
    key = lambda x: sorted(map(tuple, x[cols].astype(str).values.tolist()))
    assert cols == sorted(b.columns) and key(a) == key(b)


def test_overlap_is_looked_up_in_sets(spark):
    lines = [(1, 0, "a B c a"), (1, 1, "x_1 a"), (1, 2, ""), (2, 0, "é z"), (3, 0, "none"), (4, 0, None), (None, 0, "a")]
    rows = spark.createDataFrame(lines, "page_id long, idx int, text string")
    gold = spark.createDataFrame([(1, "A b"), (2, "É"), (2, "y"), (4, "a"), (5, "a"), (None, "a")], "page_id long, gold string")
    labels = evaluate.oracle_labels(rows, gold, 0.5)
    got = sorted((r.page_id, r.idx, r.text, r.overlap, r.keep) for r in labels.collect())
    assert got == [(1, 0, "a B c a", 0.75, True), (1, 1, "x_1 a", 0.5, True), (1, 2, "", 0.0, False), (2, 0, "é z", 0.0, False), (2, 0, "é z", 0.5, True), (4, 0, None, 0.0, False)]
    # a search of the page's tokens for each token is what took the time
    assert "array_contains" not in labels._jdf.queryExecution().toString()


def test_broken_encodings_are_found_by_first_letters():
    import re

    plainly = re.compile("[\u00c2\u00c3][\u0080-\u00bf]|\u00e2\u20ac|\u00e2\u0080|\u00f0\u0178|\u00f0\u009f|[\u00c2\u00c3]\u0192|\u00c3[\u0152-\u2122]")
    sequence = re.compile(f"[\u00c2-\u00df][{text._LATER}]|[\u00e0-\u00ef][{text._LATER}]{{2}}|[\u00f0-\u00f4][{text._LATER}]{{3}}")
    r = random.Random(6)
    letters = "a\u00c2\u00c3\u00e2\u00f0\u20ac\u0080\u0178\u009f\u0192\u0152\u2122\u00bf\u00e9\u00f4\u00df\u00a9"
    for _ in range(20_000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(1, 9)))
        assert bool(plainly.search(t)) == bool(text._BROKEN.search(t))
        assert [m.span() for m in sequence.finditer(t)] == [m.span() for m in text._SEQUENCE.finditer(t)]


def test_pages_are_parsed_once(monkeypatch):
    made = []
    monkeypatch.setattr(paragraphs, "parse", lambda html, parse=paragraphs.parse: made.append(1) or parse(html))
    monkeypatch.setattr(segment, "parse", lambda html, parse=segment.parse: made.append(1) or parse(html))
    rows = paragraphs.page_rows(1, "<h1>T</h1><p>caf\u00c3\u00a9 <b>x</b><ul><li>a</ul>", variants=False)
    assert [r[3] for r in rows] == ["T", "caf\u00e9 x", "- a"] and len(made) == 1


def test_single_blanks_are_not_rewritten():
    assert segment.squeeze("a b\t c \r d  e\x0bf\n") == "a b c\nd e f\n" and segment.RUN.search("a b c") is None
