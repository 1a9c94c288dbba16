"""Residual and sensitive-term checks."""

from polyglint.operators import checks as K
from polyglint.sources.segmenters import segment_lines
from polyglint.operators import rulepacks as RP


def segs(spark, texts, is_source=None):
    rows = [(1, i + 1, f"Line {i + 1}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, location string, text string")
    if is_source is not None:
        from pyspark.sql import functions as F
        df = df.withColumn("is_source", F.lit(is_source))
    return df


def test_residual_finding_wording(spark):
    long = "中" * 70
    f = K.residual_findings(segs(spark, ["abc", long])).collect()
    assert len(f) == 1
    assert f[0].dimension == "漏翻" and f[0].severity == "P1" and f[0].location == "Line 2"
    assert f[0].description == "Untranslated Chinese: '" + "中" * 60 + "'"


def test_source_documents_get_no_findings(spark):
    assert K.automated_findings(segs(spark, ["中 Taiwan"], is_source=True), "basic5").count() == 0
    assert K.automated_findings(segs(spark, ["中 Taiwan"], is_source=False), "basic5").count() == 2


def test_taiwan_lookahead_and_word_boundary(spark):
    texts = ["中Taiwan x Taiwan, taiwan  strait", "Taiwan Straits", "Taiwan Taiwan Strait"]
    m = K.sensitive_matches(segs(spark, texts), "basic5").orderBy("seq", "match_no").collect()
    assert [(r.seq, r.term) for r in m] == [(1, "Taiwan"), (3, "Taiwan")]


def test_kelvin_sign_folds_to_k(spark):
    m = K.sensitive_matches(segs(spark, ["Kill them"]), "basic5").collect()
    assert [r.rule_id for r in m] == ["violence"]


def test_one_finding_per_match_original_case(spark):
    f = K.sensitive_findings(segs(spark, ["Drug drug DRUG drugs"]), "basic5") \
        .orderBy("sub").collect()
    assert [r.description for r in f] == ["Sensitive term: 'Drug'", "Sensitive term: 'drug'",
                                          "Sensitive term: 'DRUG'"]


def test_security_rule_and_exemption(spark):
    texts = ["hack hacke Hacker cracker cracking crack", "Security exploit", "an exploit"]
    m = K.sensitive_matches(segs(spark, texts), "extended7").orderBy("seq", "match_no").collect()
    assert [(r.seq, r.term) for r in m] == [(1, "hacke"), (1, "Hacker"), (1, "cracker"),
                                            (1, "cracking"), (3, "exploit")]


def test_extended_pack_has_politics_and_criminal(spark):
    m = K.sensitive_matches(segs(spark, ["Mao was criminal"]), "extended7").collect()
    assert sorted(r.rule_id for r in m) == ["legal", "politics"]
    assert K.sensitive_matches(segs(spark, ["Mao was criminal"]), "basic5").count() == 0


def test_cell_wording(spark):
    from polyglint.sources.segmenters import scan_cells
    cells = spark.createDataFrame([("w", "S", 0, 1, 1, "bomb 中文")],
                                  "workbook_id string, sheet string, sheet_idx long, row_no long, "
                                  "col_no long, value string")
    f = K.scan_findings(scan_cells(cells)).orderBy("sub").collect()
    assert f[0].description == "Cell contains untranslated Chinese: 'bomb 中文'"
    assert f[1].description == "暴力相关词汇: 'bomb' in 'bomb 中文'"
    assert f[0].location == "S!A1"


def test_fullwidth_punct(spark):
    f = RP.fullwidth_punct_findings(segs(spark, ["Hello，world。", "中文，好", "plain"])).collect()
    assert len(f) == 1 and f[0].description == "Full-width punctuation in target: '。，'"  # code-point order


def test_register_mix(spark):
    docs = spark.createDataFrame([(1, "Können Sie das? Du bist da."), (2, "sie und du"),
                                  (3, "Vous et tu"), (4, "usted y tú")], "doc_id long, text string")
    f = RP.register_mix_findings(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.description) for r in f] == [
        ("1", "Mixed formal and informal address (de): 'Sie' and 'du'"),
        ("3", "Mixed formal and informal address (fr): 'vous' and 'tu'"),
        ("4", "Mixed formal and informal address (es): 'usted' and 'tú'")]


def test_register_mix_jako(spark):
    docs = spark.createDataFrame([(1, "行きます。食べました。食べる。"), (2, "합니다. 해요."),
                                  (3, "です。ます。")], "doc_id long, text string")
    c = {r.doc_id: r for r in RP.register_mix_jako(docs).collect()}
    assert (c[1].ja_polite, c[1].ja_plain) == (2, 1)
    assert (c[2].ko_formal, c[2].ko_polite) == (1, 1)
    assert (c[3].ja_polite, c[3].ja_plain) == (2, 0)
    f = RP.register_mix_jako_findings(docs).collect()
    assert sorted((r.doc_id, int(r.sub)) for r in f) == [("1", 0), ("2", 1)]


def test_sentence_endings_of_long_texts(spark):
    from pyspark.sql import functions as F
    texts = ["", "。。です", "です。", "ab.cde!ながいぶん。。요？ rest", "\U00020000漢字です\n。x", None, "a\n\nます．でした\n!", "!?"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # as leftmost matches of up to four characters before a mark
    by_match = F.regexp_extract_all("text", F.lit("([^。．！？!?.]{1,4})[。．！？!?.]"), 1)
    rows = docs.select(RP.sentence_endings(F.col("text")).alias("got"), by_match.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and rows[3].got == ["ab", "cde", "ながいぶん"[-4:], "요"]
    c = {r.doc_id: r[1:] for r in RP.register_mix_jako(docs).collect()}
    assert (c[4], c[5], c[6]) == ((1, 0, 0, 0), (None,) * 4, (2, 0, 0, 0))
    # the text is looked at once, whatever is counted or reported
    for df in (RP.register_mix_jako(docs), RP.register_mix_jako_findings(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and "regexp_extract_all" not in plan


def test_terminology_equi_join_matches_contains(spark):
    pairs = spark.createDataFrame(
        [("w", "S", "A1", "数据库 服务", "database service", 1),
         ("w", "S", "A2", "数据库", "data store", 2),
         ("w", "S", "A3", "服务", None, 3)],
        "workbook_id string, sheet string, coordinate string, source string, target string, "
        "pair_seq long")
    gloss = spark.createDataFrame([("数据库", "database"), ("数据", "data"), ("服务", "service")],
                                  "term string, approved string")
    f = RP.terminology_findings(pairs, gloss).collect()
    # A1: all terms rendered; A2: 数据库 not rendered as database (数据 -> data is fine)
    assert [(r.location, r.description.split("'")[1]) for r in f] == [("S!A2", "数据库")]


def test_rule_pack_as_table(spark):
    rules = K.rules_table(spark, "extended7")
    assert rules.count() == 7
    texts = ["hack the Security system", "a backdoor", "Mao"]
    by_name = sorted((r.seq, r.term) for r in K.sensitive_matches(segs(spark, texts), "extended7").collect())
    by_table = sorted((r.seq, r.term) for r in K.sensitive_matches(segs(spark, texts), rules).collect())
    assert by_name == by_table == [(2, "backdoor"), (3, "Mao")]
    custom = [("brand", r"\bAcme\b", "P2", "Competitor name", "partner")]
    m = K.sensitive_matches(segs(spark, ["acme rocks", "Acme partner deal"]), custom).collect()
    assert [(r.seq, r.term, r.rule_desc) for r in m] == [(1, "acme", "Competitor name")]


def test_document_prefilter_is_exact(spark):
    from polyglint.sources.segmenters import segment_lines, segment_markdown
    texts = ["clean text\nnothing here", "see Taiwan\nStrait ahead", "x\n中文 left\nkill", "Taiwan Strait",
             "```\nbomb\n```\nok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for seg in (segment_lines, segment_markdown):
        full = K.automated_findings(seg(docs), "basic5")
        pre = K.document_findings(docs, seg, "basic5")
        cols = ["doc_id", "location", "description"]
        assert sorted(tuple(r) for r in full.select(cols).collect()) == \
            sorted(tuple(r) for r in pre.select(cols).collect())
    got = sorted((r.doc_id, r.location) for r in K.document_findings(docs, segment_lines).collect())
    assert got == [("1", "Line 1"), ("2", "Line 2"), ("2", "Line 3"), ("4", "Line 2")]


def test_dedup_then_check_equals_direct(spark):
    from polyglint.plans import fixtures as FX
    from conftest import SF_SMALL
    segs = FX.fx_sensitive_lines(spark, SF_SMALL)
    from pyspark.sql import functions as F
    segs = segs.withColumn("text", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("中 "), "text"))
                           .otherwise(F.col("text")))
    a = K.automated_findings(segs, "extended7")
    b = K.automated_findings(segs, "extended7", dedup=True)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_document_prefilter_sensitive_only(spark):
    from polyglint.sources.segmenters import segment_lines
    docs = spark.createDataFrame([(0, "中文 only"), (1, "a Taiwan\nStrait b"), (2, "hacke it")],
                                 "doc_id long, text string")
    a = K.sensitive_findings(segment_lines(docs), "extended7")
    b = K.document_findings(docs, segment_lines, "extended7", include_residual=False)
    cols = ["doc_id", "location", "description"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    assert b.count() == 2


def test_document_filter_is_exact_for_every_pack(spark):
    """Anchors and look-arounds see lines, so those packs are not filtered."""
    docs = spark.createDataFrame([(1, "a\nfoo bar"), (2, "a foo\nbar"), (3, "x foo"), (4, "foo"), (5, "foo\u2028 bar"),
                                  (6, "a\n  foo\n")], "doc_id long, text string")
    for body in (r"^foo\b", r"foo$", r"(?<=a )foo", r"foo(?= bar)", r"(?<!a )foo", r"\Afoo", r"foo\z", r"[$^]|foo",
                 r"foo(?!\s+bar)", r"(?:^a|foo)", r"(f)oo\b"):
        pack = [("r", body, "P1", "d")]
        want = sorted((f.doc_id, f.location) for f in K.automated_findings(segment_lines(docs), pack).collect())
        got = sorted((f.doc_id, f.location) for f in K.document_findings(docs, segment_lines, pack).collect())
        assert got == want, body
    assert K.loose_pattern([("r", "^foo", "P1", "d")]) is None and K.loose_pattern("basic5")


def test_large_and_small_glossaries_agree(spark):
    pairs = spark.createDataFrame(
        [("w", "S", "A1", 1, "甲乙丙", "one two"), ("w", "S", "A2", 2, "乙", "x"), ("w", "S", "A3", 3, "甲乙", None),
         ("w", "S", "A4", 4, None, "y"), ("w", "S", "A5", 5, "丁", "four")],
        "workbook_id string, sheet string, coordinate string, pair_seq long, source string, target string")
    glossary = spark.createDataFrame([("甲", "one"), ("乙", "2"), ("甲乙", "one two"), ("", "z"), ("乙", "2")],
                                     "term string, approved string")
    rows = lambda n: sorted(tuple(r) for r in RP.terminology_findings(pairs, glossary, inline_terms=n).collect())
    assert rows(10) == rows(1) and len(rows(10)) == 2
    assert RP.terminology_findings(pairs, glossary.limit(0)).count() == 0


def every_rule_for_itself(text, rules):
    """(rule_no, match_no, term) with one pass of Spark's regex a rule."""
    from pyspark.sql import functions as F
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(K.rule_pattern(r[1])), 0), _numbered(no))
                               for no, r in enumerate(rules)]))


def _numbered(no):
    from pyspark.sql import functions as F
    return lambda t, i: F.struct(F.lit(no).alias("rule_no"), i.alias("match_no"), t.alias("term"))


def test_literal_rules_of_a_large_pack_find_the_same(spark):
    """Phrases that begin others, rules that share phrases, all cases, words beside
    marks and signs, phrases that may overlap, and rules that are no phrases."""
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(3)
    words = ["kill", "killer", "Kill Switch", "kill switch off", "switch", "off", "e-mail", "mail", "\u4e2d\u6587", "\u00e9tat", "stra\u00dfe", "kelvin", "sink",
             "a", "ab", "a b", "b a", "\u03a3\u03af\u03c3", "x_1", "i", "r&d"]
    rules = [(f"r{k}", r"\b(" + "|".join(rnd.sample(words, rnd.randint(1, 4))) + r")\b", rnd.choice(["P0", "P1"]), f"d{k}") for k in range(60)]
    rules += [("opt", r"\bkills?\b", "P2", "o"), ("look", r"\bmail\b(?!\s+man)", "P2", "l"), ("one", r"\bsink\b", "P3", "s", "Stop")]
    pieces = words + ["KILL", "\u212aill", "\u017fink", "S\u0130NK", "s\u0131nk", "\u00c9TAT", "e\u0301tat", "kill\u0301", " ", "  ", "-", ".", "man", "STRASSE", "\u03c3\u03af\u03c2", "stop", "A"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice([" ", " ", "-", "", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    plain, _ = K.resolve_rules(rules)
    from polyglint.operators import literals
    pack = literals.compiled(tuple(r[1] for r in plain))
    assert pack is not None and 0 < len(pack.others) < 40
    got = df.select("doc_id", F.array_sort(K.rule_hits(F.col("text"), plain)).alias("h"),
                    F.array_sort(every_rule_for_itself(F.col("text"), plain)).alias("w")).collect()
    assert sum(len(r.h) for r in got) > 1000
    for r in got:
        assert [tuple(x) for x in r.h] == [tuple(x) for x in r.w], texts[r.doc_id]
    # the exemption and both readers of the hits
    flat = sorted((r.doc_id, r.rule_no, r.match_no, r.term) for r in K.sensitive_matches(df, rules).collect())
    want = sorted((r.doc_id, *tuple(x)) for r in got for x in r.w if plain[x[0]][0] != "one" or "stop" not in texts[r.doc_id].lower())
    assert flat == want
    inside = df.select("doc_id", F.inline(K.finding_hits("text", rules, include_residual=False))).collect()
    assert sorted((r.doc_id, r["sub"]) for r in inside) == sorted((d, (n + 1) * K.RULE_STRIDE + m) for d, n, m, _ in want)


def test_five_thousand_rules_cost_little_more_than_seven(spark):
    import itertools
    import time
    syllables = ["ba", "ke", "lo", "mi", "nu", "pra", "sto", "tri", "vel", "zan"]
    names = ["".join(p) for p in itertools.product(syllables, repeat=4)][:5000]
    rules = [(f"r{k}", rf"\b({n}|{n} {n[:2]}x)\b", "P1", "d") for k, n in enumerate(names)]
    prose = spark.range(4000).selectExpr(
        "id as doc_id", "array_join(transform(sequence(1, 400), i -> concat('w', substring(md5(concat(id, ':', i)), 1, 5))), ' ')"
        " || case when id % 50 = 0 then ' bakelomi' else ' stop' end as text").repartition(4).cache()
    prose.count()

    def seconds(pack):
        m = K.sensitive_matches(prose, pack)
        n, t = m.count(), time.time()
        m.selectExpr("sum(rule_no)").collect()
        return n, time.time() - t

    n_small, small = seconds([("one", r"\b(bakelomi)\b", "P1", "d")] + [r for r in K.resolve_rules("basic5")[0]] + [("two", r"\b(nubake)\b", "P1", "d")])
    n_large, large = seconds(rules)
    assert n_small == n_large == 80
    assert large < 3 * small + 1.0, (small, large)


def test_large_glossary_under_a_hot_source(spark):
    """A source on a third of all pairs: same rows as inside the row, and no task
    joins over twice the median."""
    import statistics
    from pyspark.sql import functions as F
    n = F.col("id")
    pairs = spark.range(24_000).select(
        F.lit("w").alias("workbook_id"), F.lit("s").alias("sheet"), F.concat(F.lit("A"), n).alias("coordinate"),
        F.when(n % 3 == 0, "the hot term here").otherwise(F.concat(F.lit("t"), n % 500, F.lit(" word"), n % 7)).alias("source"),
        F.when(n % 4 == 0, "rendered hot").otherwise("else").alias("target"), n.alias("pair_seq")).repartition(8)
    terms = [("hot term", "rendered"), ("t", "T"), ("he", "HE"), ("word3", "w3"), ("t499", "x"), ("absent phrase", "y"), ("here", "else")]
    glossary = spark.createDataFrame(terms + [(f"filler{i}", "z") for i in range(3000)], "term string, approved string")
    rows = lambda k: sorted(map(tuple, RP.terminology_findings(pairs, glossary, inline_terms=k).collect()))
    assert rows(10_000) == rows(100)
    assert RP._joined_misses(pairs, glossary, 40).count() == len(rows(100))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in RP._joined_misses(pairs, glossary, 40).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) <= 2 * statistics.median(sizes), sizes


def test_terms_are_filed_under_their_rarest_gram(spark):
    glossary = spark.createDataFrame([("abcx", "1"), ("abcy", "2"), ("abc", "3"), ("zz", "4"), ("", "5")], "term string, approved string")
    got = {r.term: r.gram for r in RP.filed_terms(glossary).collect()}
    assert got == {"abcx": "bcx", "abcy": "bcy", "abc": "abc", "zz": "zz"}
