"""Segmenters: numbering, filters, fences, HTML blocks, office formatters."""

import pytest

from polyglint.sources import segmenters as G


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_text_lines_number_every_line(spark):
    out = G.segment_lines(docs(spark, ["a\n\n  ab \r\nx\rcd\n"])).collect()
    assert [(r.location, r.text) for r in out] == [("Line 3", "ab"), ("Line 5", "cd")]


def test_markdown_fences_and_headings(spark):
    text = "# Title\nkeep me\n```\ncode\n```\n## sub\nafter\n  ```py\nhidden\n"
    out = G.segment_markdown(docs(spark, [text])).collect()
    assert [(r.location, r.text) for r in out] == [("Line 2", "keep me"), ("Line 7", "after")]


def test_unclosed_fence_swallows_rest(spark):
    assert G.segment_markdown(docs(spark, ["```\nsecret\nmore"])).count() == 0


def test_fence_parity(spark):
    out = G.fence_parity(docs(spark, ["a\n```\nb\n```\nc"])).orderBy("line_no").collect()
    assert [(r.is_fence, r.in_code) for r in out] == [(False, False), (True, False), (False, True),
                                                       (True, True), (False, False)]


HTML = ('<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head>'
        '<body><nav><ul><li>Menu item</li></ul></nav><!-- <p>comment</p> -->'
        '<h1>Head &amp; title</h1><p><b>Bold</b> text <i>here</i><br><p>Second &quot;q&quot;'
        '<div>ad block</div><ul><li>Item one</li><li>x</li></ul>'
        '<table><tr><td>Cell A</td><th>Head B</th></tr></table>'
        '<pre>code</pre><footer><p>foot</p></footer><P CLASS="z">' + "y" * 45 + '</P></body></html>')


def test_html_blocks(spark):
    pages = spark.createDataFrame([(7, HTML)], "page_id long, html string")
    out = G.segment_html(pages).orderBy("seq").collect()
    assert [(r.tag, r.text) for r in out] == [
        ("h1", "Head & title"), ("p", "Boldtexthere"), ("p", 'Second "q"'),
        ("li", "Item one"), ("td", "Cell A"), ("th", "Head B"), ("p", "y" * 45)]
    assert out[0].location == '<h1> "Head & title"'
    assert out[-1].location == '<p> "' + "y" * 40 + '..."'


def test_cell_admission(spark):
    cells = spark.createDataFrame(
        [("w", "S", 0, 1, 1, "0", "int"), ("w", "S", 0, 1, 2, "False", "bool"),
         ("w", "S", 0, 1, 3, " ", "str"), ("w", "S", 0, 1, 4, "x", "str"),
         ("w", "S", 0, 2, 1, "7", "int"), ("w", "S", 0, 2, 2, None, "str")],
        "workbook_id string, sheet string, sheet_idx long, row_no long, col_no long, "
        "value string, value_type string")
    truthy = [r.location for r in G.segment_cells(cells, "truthy").orderBy("seq").collect()]
    assert truthy == ["S!D1", "S!A2"]
    assert G.cell_map(cells).count() == 4        # zero and False are kept
    assert G.scan_cells(cells).count() == 1      # strings only


def test_office_formatters(spark):
    paras = spark.createDataFrame([(1, 1, "Title", " T "), (1, 2, "Normal", "x"), (1, 3, None, " ")],
                                  "doc_id long, para_no long, style string, text string")
    assert [r.location for r in G.segment_paragraphs(paras).orderBy("seq").collect()] == [
        "Paragraph 1 [Title]", "Paragraph 2"]
    pages = spark.createDataFrame([(1, 2, "ab\nc\n  de ")], "doc_id long, page_no long, text string")
    assert [(r.location, r.text) for r in G.segment_page_lines(pages).orderBy("seq").collect()] == [
        ("Page 2, Line 1", "ab"), ("Page 2, Line 3", "de")]
    slides = spark.createDataFrame([(1, 3, 1, 2, " s ")],
                                   "doc_id long, slide_no long, shape_no long, para_no long, text string")
    assert G.segment_slides(slides).first().location == "Slide 3, Paragraph 2"


def test_route_format(spark):
    d = spark.createDataFrame([(1, "/x/a.MD", "# h\nbody text"), (2, "/x/b", "plain text"),
                               (3, "/x/c.htm", "<p>para text</p>"), (4, "/x/d.docx", "bin")],
                              "doc_id long, path string, text string")
    r = {x.doc_id: (x.format, x.parser) for x in G.route_format(d).collect()}
    assert r == {1: ("md", "md"), 2: ("", "txt"), 3: ("htm", "html"), 4: ("docx", "docx")}
    segs = {(x.doc_id, x.text) for x in G.segment_routed(d).collect()}
    assert segs == {(1, "body text"), (2, "plain text"), (3, "para text")}


def test_many_fences_binary_search(spark):
    """Documents with more fences than the direct-count threshold take the
    binary-search path; parity must equal a running count."""
    import random
    random.seed(7)
    lines = []
    for i in range(600):
        lines.append("```" if random.random() < 0.2 else f"line {i}")
    text = "\n".join(lines)
    got = [(r.line_no, r.in_code) for r in
           G.fence_parity(docs(spark, [text])).orderBy("line_no").collect()]
    seen, expect = 0, []
    for i, ln in enumerate(lines):
        expect.append((i + 1, seen % 2 == 1))
        if ln.startswith("```"):
            seen += 1
    assert got == expect
    segs = [r.text for r in G.segment_markdown(docs(spark, [text])).orderBy("seq").collect()]
    inside, keep = False, []
    for ln in lines:
        if ln.startswith("```"):
            inside = not inside
            continue
        if not inside:
            keep.append(ln)
    assert segs == keep


def test_load_text_files_and_route(spark, tmp_dir):
    import os
    from polyglint.sources.readers import load_text_files
    files = {"a.md": "# T\n```\nx\n```\nmarkdown body\n", "b.txt": "one\n\ntwo lines\n",
             "sub/c.html": "<p>html para</p><nav><p>menu</p></nav>", "d": "no suffix text"}
    for name, text in files.items():
        p = os.path.join(tmp_dir, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as fh:
            fh.write(text)
    docs = load_text_files(spark, tmp_dir)
    assert docs.count() == 4
    segs = {(os.path.basename(r.doc_id), r.location, r.text)
            for r in G.segment_routed(docs).collect()}
    assert segs == {("a.md", "Line 5", "markdown body"), ("b.txt", "Line 1", "one"),
                    ("b.txt", "Line 3", "two lines"), ("c.html", '<p> "html para"', "html para"),
                    ("d", "Line 1", "no suffix text")}


def test_review_corpus_end_to_end(spark, tmp_dir):
    import os
    from polyglint.plans.review import review_corpus
    from polyglint.sources.readers import load_text_files
    with open(os.path.join(tmp_dir, "t.md"), "w", encoding="utf-8") as fh:
        fh.write("# H\nWe must attack 中文 here\n```\nbomb\n```\nWe must attack 中文 here\n")
    with open(os.path.join(tmp_dir, "p.html"), "w", encoding="utf-8") as fh:
        fh.write("<p>Taiwan Strait</p><p>Taiwan</p>")
    r = review_corpus(load_text_files(spark, tmp_dir))
    f = sorted((os.path.basename(x.doc_id), x.location, x.description) for x in r["findings"].collect())
    assert f == [("p.html", '<p> "Taiwan"', "Possible Taiwan reference: 'Taiwan'"),
                 ("t.md", "Line 2", "Untranslated Chinese: 'We must attack 中文 here'"),
                 ("t.md", "Line 2", "Violence-related term: 'attack'"),
                 ("t.md", "Line 6", "Untranslated Chinese: 'We must attack 中文 here'"),
                 ("t.md", "Line 6", "Violence-related term: 'attack'")]
    t = [x for x in r["review_texts"].collect() if x.text == "We must attack 中文 here"][0]
    assert (t.occurrence_count, t.locations) == (2, "Line 2; Line 6")


def test_html_text_nodes_are_stripped_one_by_one(spark):
    html = ('<p>a <!-- c --> b</p><p>x <span>y</span>&nbsp;<b>z</b></p>'
            '<p>left <nav>menu</nav> right &amp;lt;ok&amp;gt;</p>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = [r.text for r in G.segment_html(pages).orderBy("seq").collect()]
    assert out == ["ab", "xyz", "leftright &lt;ok&gt;"]


def test_load_text_files_glob(spark, tmp_dir):
    import os
    from polyglint.sources.readers import load_text_files
    for name in ("a.md", "b.txt", "c.md"):
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as fh:
            fh.write("hello world\n")
    got = sorted(os.path.basename(r.path) for r in load_text_files(spark, tmp_dir, glob="*.md").collect())
    assert got == ["a.md", "c.md"]


def html(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [[(r.tag, r.text) for r in G.segment_html(df).where(f"doc_id = {i}").orderBy("seq").collect()]
            for i in range(len(pages))]


def test_html_keeps_nested_text(spark):
    got = html(
        spark, "<li><div>nested 中文 kill</div></li>", "<td>Hello <div>world</div></td>",
        "<ul><li>one<ul><li>two</li></ul>three</li><li>four</ul>", "<p>open <b>bold<p>next",
        "<table><tr><td>aa<td>bb<tr><th>cc</table><p>dd</p>", "<p>xx</div>yy</p>", "x < 3 and <p>y > 2 < then</p>", "", None,
        "<p>&eacute;&rsquo;&#20013;&#x4e2d;&nbsp;</p><p>&amp;lt;&lt;&#60;&#x3E;&bogus;&#0;&#55555555;&</p>",
        "<li><p>inner</p></li>", "<h1>ab<h2>cd</h2>", "<p title='z'>attr</p><P\n class=x>upper</P>")
    assert got[0] == [("li", "nested 中文 kill")] and got[1] == [("td", "Helloworld")]
    assert got[2] == [("li", "onetwothree"), ("li", "two"), ("li", "four")]
    assert got[3] == [("p", "openbold"), ("p", "next")]
    assert got[4] == [("td", "aa"), ("td", "bb"), ("th", "cc"), ("p", "dd")]
    assert got[5] == [("p", "xxyy")] and got[6] == [("p", "y > 2 < then")] and got[7] == [] and got[8] == []
    assert got[9] == [("p", "é’中中"), ("p", "&lt;<<>&bogus;\ufffd\ufffd&")]
    assert got[10] == [("li", "inner"), ("p", "inner")] and got[11] == [("h1", "ab"), ("h2", "cd")]
    assert got[12] == [("p", "attr"), ("p", "upper")]


def test_html_text_of_bare_signs(spark):
    df = spark.createDataFrame([("x < 3 and y > 2 then",), ("a<b>c</b>",), ("1 <2 <!-- c --> 3",)], "t string")
    assert [r[0] for r in df.select(G.html_text("t")).collect()] == ["x < 3 and y > 2 then", "ac", "1 <23"]


def test_order_keys_never_collide(spark):
    n = 20_000
    cells = spark.range(n).selectExpr("1L as doc_id", "1L as page_no", "id as row_no", "1L as col_no", "'tt' as text")
    both = cells.selectExpr("*", "1L as table_no").unionByName(cells.selectExpr("*", "2L as table_no"))
    segs = G.segment_page_tables(both)
    assert segs.select("seq").distinct().count() == 2 * n
    ordered = segs.orderBy("seq").selectExpr("location").limit(n + 1).collect()
    assert ordered[0].location == "Page 1, Table Row 0, Col 1" and ordered[n].location == "Page 1, Table Row 0, Col 1"
    import pytest


def test_order_keys_of_large_places(spark):
    """Thousands of tables, columns and shapes sort as their numbers, and an
    impossible ordinal doesn't end the run."""
    from pyspark.sql import functions as F
    from polyglint.operators import checks as K
    from polyglint.operators import report as R
    big = [(1, 1, 5000, 1, 1), (1, 1, 5000, 1, 5000), (1, 1, 2, 70000, 3), (1, 1, 1024, 1, 1), (1, 1, 1023, 4000000000, 1), (1, 2, 1, 1, -3), (1, 9, 1, 1, 1)]
    cells = spark.createDataFrame([(*r, f"at {k}") for k, r in enumerate(big)],
                                  "doc_id long, page_no long, table_no long, row_no long, col_no long, text string")
    got = [big[int(r.text.split()[1])] for r in G.segment_page_tables(cells).orderBy("seq").collect()]
    assert got == sorted(big)
    slides = spark.createDataFrame([(1, s, p, n, "kill") for s, p, n in ((2, 1, 1), (1, 5000, 1), (1, 4095, 2), (1, 4096, 1))],
                                   "doc_id long, slide_no long, shape_no long, para_no long, text string")
    segs = G.segment_slides(slides)
    assert [(r.location, r.shape_no) for r in segs.orderBy("seq").collect()] == [
        ("Slide 1, Paragraph 2", 4095), ("Slide 1, Paragraph 1", 4096), ("Slide 1, Paragraph 1", 5000), ("Slide 2, Paragraph 1", 1)]
    # findings of such places merge with those of lines and cells
    lines = K.automated_findings(G.segment_lines(docs(spark, ["bomb"])))
    merged = R.merge_findings(lines, K.automated_findings(segs), K.sensitive_findings(segs))
    assert [r.location for r in R.report_detail(merged).orderBy("n").collect()][:3] == ["Line 1", "Slide 1, Paragraph 2", "Slide 1, Paragraph 1"]
    # the last column of the sheet format
    assert spark.range(1).select((G.cell_seq(F.lit(0), F.lit(1), F.lit(16384)) < G.cell_seq(F.lit(0), F.lit(2), F.lit(1))).alias("b")).first().b


def fold_html(tags):
    """Text elements (i, tag, j) of a list of tags, kept on a stack one by one."""
    from polyglint import catalog as C
    far, done, open_ = 1 << 30, [], []

    def end(n, j):
        for _ in range(n):
            i, t = open_.pop()
            if t in C.HTML_TEXT_TAGS:
                done.append((i, t, j))

    for j, tag in enumerate(tags, 1):
        names = [t for _, t in reversed(open_)]
        near = lambda ts: min([names.index(t) + 1 for t in ts if t in names], default=far)
        if tag[0] == "/":
            end(near([tag[1:]]) % far, j)
            continue
        gone = 1 if names and (names[0] == "p" or (names[0][0] == tag[0] == "h" and names[0][1:].isdigit() and tag[1:].isdigit())) else 0
        for starts, ended, fence in C.HTML_IMPLIED_ENDS:
            if tag in starts and near(ended) < near(fence):
                gone = max(gone, near(ended))
        end(gone, j)
        open_.append((j, tag))
    return sorted(done + [(i, t, far) for i, t in open_ if t in C.HTML_TEXT_TAGS])


def test_html_elements_match_a_plain_stack(spark):
    import random
    from pyspark.sql import functions as F
    from polyglint import catalog as C
    rnd = random.Random(11)
    pages, want = [], []
    for k in range(300):
        some = rnd.sample(C.HTML_BLOCK_TAGS, rnd.randint(1, 6)) + ["li", "p", "h1", "h2"]
        tags = []
        for _ in range(rnd.choice([0, 3, 40, 200])):
            t = rnd.choice(some)
            tags += rnd.choice([[t], ["/" + t], [t, "/" + t], [t, "/" + t] * 3, [t, t]])
        pages.append((k, "".join(f"<{t}>x" for t in tags)))
        want.append(fold_html(tags))
    df = spark.createDataFrame(pages, "k int, html string").repartition(4)
    got = df.select("k", G.html_elements(G.html_pieces("html")).alias("e")).collect()
    for r in got:
        assert [tuple(e) for e in r.e] == want[r.k], pages[r.k]


@pytest.mark.parametrize("make", [
    lambda n: "<ul>" + "<li>item</li>" * n + "</ul>", lambda n: "<ul>" + "<li>item" * n,
    lambda n: "<table>" + "<tr><td>aa<td>bb" * (n // 3), lambda n: "<div><h1>t</h1><p>x</div>" * (n // 4)])
def test_html_time_is_in_proportion_to_length(spark, make):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, make(n))], "page_id long, html string")
        out = G.segment_html(df)
        out.count()                       # planned and compiled
        t = time.time()
        out.selectExpr("sum(length(text))").collect()
        return time.time() - t

    small, large = min(seconds(4000) for _ in range(2)), min(seconds(16000) for _ in range(2))
    assert large < 8 * small + 1.5, (small, large)


@pytest.mark.parametrize("split", ["64b", "1000b", "128m"])
def test_lines_read_in_splits_equal_whole_files(spark, tmp_dir, split):
    """Line numbers and fence parity go on over the splits of a file."""
    import os
    import random
    from polyglint.sources import readers as L
    rnd = random.Random(5)
    words = ["```", "```py", "# head", "", "  ", "x", "long line " * 9, "\u4e2d\u6587 text", "ab", "  ``` tail", "\u3000"]
    for k in range(5):
        text = "".join(rnd.choice(words) + rnd.choice(["\n", "\r\n", "\n\n"]) for _ in range(rnd.choice([0, 1, 200]))) + rnd.choice(["", "end"])
        with open(os.path.join(tmp_dir, f"f{k}.md"), "w", encoding="utf-8", newline="") as fh:
            fh.write(text)
    whole = L.load_text_files(spark, tmp_dir)
    want = {n: sorted(map(tuple, f(whole).select("doc_id", "seq", "location", "text").collect()))
            for n, f in (("txt", G.segment_lines), ("md", G.segment_markdown))}
    parity = {(r.doc_id, r.line_no): (r.is_fence, r.in_code) for r in G.fence_parity(whole).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert sorted(map(tuple, L.segment_text_lines(L.load_text_lines(spark, tmp_dir)).collect())) == want["txt"]
        lines = L.load_text_lines(spark, tmp_dir, fences=True)
        assert sorted(map(tuple, L.segment_markdown_lines(lines).collect())) == want["md"]
        got = {(r.doc_id, r.line_no): (r.is_fence, r.in_code) for r in lines.collect()}
        assert got.items() <= parity.items() and len(parity) - len(got) <= 5
        if split == "64b":
            assert L.load_text_lines(spark, tmp_dir).rdd.getNumPartitions() > 20
        p = L.load_text_lines(spark, tmp_dir)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in p.split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
