"""Golden cases of the operators, invariants of the folds, readers and streams."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import dictionaries as dic
from lexloom.functions import predicates as p
from lexloom.functions import text as tx
from lexloom.functions.dialect import Spark
from lexloom.operators import decks, dedup, documents, generation, lexical, naming, numeric, ranges, split, tagging, topics, web
from lexloom.sources import files, sinks
from lexloom.streaming import streams


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column).collect()]


def test_ngrams_bridge_stop_words(spark):
    docs = spark.createDataFrame([("L’équipe de soins. L'équipe de soins et la santé",)], "text string")
    assert docs.select(lexical.tokens("text")).first()[0] == ["équipe", "soins", "équipe", "soins", "santé"]
    assert [tuple(r) for r in lexical.top_ngrams(docs).collect()] == [(2, "équipe soins", 2)]
    assert one(spark, lexical.ngrams(F.split("x", " "), 3), "a b", "a b c") == [[], ["a b c"]]


def test_text_functions(spark):
    assert one(spark, tx.scientific("x"), "1 × 10⁻⁷", "le 10 - 7", "10-12/2024", "10²") == ["1 × 10^-7", "le 10^-7", "10-12/2024", "102"]
    assert one(spark, tx.column(tx.bullets_off, "x"), "2024 saw growth", "- a") == ["saw growth", "a"]
    assert one(spark, tx.column(tx.url_normal, "x"), "https://a.fr/x//#top") == ["https://a.fr/x"]
    assert one(spark, tx.column(tx.url_filename, "x"), "https://www.site.fr/actus/2026/titre/?q=a b&x=1") == ["site.fr_actus_2026_titre_q_a_b_x_1.html"]
    assert one(spark, tx.column(tx.video_id, "x"), "https://youtu.be/abcDEF_123", "https://x.y/?v=abcdefg", "none") == ["abcDEF_123", "abcdefg", None]
    assert one(spark, tx.number_suffix("x"), "x-10.md", "x-2.md", "notes.md") == [10, 2, None]
    assert one(spark, tx.model_title("x"), '"Titre : Rapport annuel.pdf"', "", "Title: A/B") == ["Rapport annuel", "TITRE INCONNU", "A_B"]
    assert one(spark, F.expr(tx.final_name(Spark, "'2024'", "x")), "Étude: santé/soins") == ["2024 - ETUDE_ SANTE_SOINS.pdf"]
    assert one(spark, tx.pdf_year("x"), "D:20240115103000", "made 1999", "x") == [2024, 1999, None]
    assert one(spark, tx.column(tx.ascii_fold, "x"), " Kinésithérapie Œuf ß") == ["kinesitherapie oeuf ss"]
    assert one(spark, tx.url_line("x"), "https://x https://x https://y", "see https://x https://x") == ["https://x https://y", "see https://x https://x"]
    assert one(spark, tx.markdown_off("x"), "# **H**\n![i](u)[t](v) **b** *c* `d`\n|---|---|") == ["# **H**\nt b c d"]
    assert one(spark, F.expr(tx.idea_key(Spark, "x")), "Café noir", "CAFE NOIR") == ["caf noir", "cafe noir"]


def test_score_and_flags(spark):
    s = "The mass was measured at 5.3 kg with a precision of 0.2 percent."
    assert one(spark, p.column(p.score, "x"), s) == [10]
    assert one(spark, p.column(p.unit, "x"), "This is a test", "5 kmh-1", "none here?") == [True, True, False]
    assert one(spark, p.column(p.date_only, "x"), "On 12 May 2024", "12/05/2024", "May 2024", "5 in 2024") == [False, True, True, False]
    assert one(spark, p.column(p.page_counter, "x"), "3 of 10", "page 4", "of 10") == [True, True, False]
    assert one(spark, p.column(p.layout_fragment, "x"), "", "12, 3.", "page 3", "a 3") == [True, True, True, False]


def test_patterns_are_guarded_alike(spark):
    """What spares Spark work changes no answer; DuckDB's SQL has no part of it."""
    import duckdb

    from lexloom.functions.dialect import B, E, Duck

    texts = ["the", "xthe", "thé the", "the\n", "_the", "a  the b", "", "et al (2)", "Doe, J.", "élan, J. x", "x,J.", "9a, B.", "in vitro", "in  vitro", "invitro", "the the"]
    plain = lambda x, q: one(spark, F.expr(f"rlike(x, {Spark.lit(q)})"), *texts)
    for words in (["the"], ["in vitro"], ["al"]):
        told = tagging.keyword_hits(Spark, "x", words)
        assert "contains" in told and "contains" not in tagging.keyword_hits(Duck, "x", words)
        assert [bool(v) for v in one(spark, F.expr(told), *texts)] == plain("x", B + r"\s+".join(words[0].split()) + E)
    assert "(?=[" in Spark.match("x", p.METADATA) and "(?=[0-9])" in Spark.match("x", p.NUMBER) and "(?=[" not in Duck.match("x", p.METADATA)
    texts += ["Nature 5, 3 - 9", "ISSN", "xissn", "é-mail e-mail", "5 µm", "5µm", "x5", "_5", "5 KG", "MAY 2024", "Fig. 3", "it Showed."]
    for f in p.FLAGS.values():
        assert one(spark, p.column(f, "x"), *texts) == [duckdb.execute(f"select {f(Duck, 'x')} from (select ? x)", [t]).fetchall()[0][0] for t in texts], f.__name__
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(["thee und this", "undt this", "nothing", "auf-thee; thee"])], "doc_id int, pos int, sentence string")
    got = tagging.classify(rows, dic.ONTOLOGY, dic.SYNONYMS).withColumn("plain", F.expr(tagging.synonyms("normalized", dic.SYNONYMS))).orderBy("doc_id").collect()
    assert [r.rewritten for r in got] == [r.plain for r in got] == ["the und the", "und the", "nothing", "und-the thee"]


def test_tags_and_ontology(spark):
    words = files.keyword_file("#KINE;kinesytherap,kine\n\nbad line\n#DYSP,dyspnee\n#DYSP,essouffle,dyspnee\n")
    docs = spark.createDataFrame([(1, "Kinésithérapie pour DYSPNÉE\nrien")], "doc_id long, text string")
    got = tagging.tag_phrases(docs, words).orderBy("pos").collect()
    assert [(r.phrase, r.tags, r.motcle) for r in got] == [("kinesitherapie pour dyspnee", "#KINE;#DYSP", "kine;dyspnee"), ("rien", "", "")]
    cats, syn = files.ontology_file("ontology:\n- {id: imagerie, label: Imagerie, keywords: [scanner, irm]}\n- {id: douleur, label: Douleur, keywords: [douleur]}\n- 3\nsynonyms:\n- {canonical: scanner, variants: [tdm]}\n")
    rows = split.posed(spark.createDataFrame([(1, "Le TDM montre une lésion. Douleur après scanner et IRM!\nRien.")], "doc_id long, text string"), split.sentences("text"), "sentence", "doc_id")
    got = tagging.classify(rows, cats, syn).orderBy("pos").collect()
    assert [(r.all_categories, r.all_scores, r.dominant) for r in got] == [("imagerie", "1", "imagerie"), ("imagerie;douleur", "2;1", "imagerie"), ("unclassified", "0", "unclassified")]
    stats = {r.category_id: (r.occurrences, round(r["share"], 3)) for r in tagging.category_stats(tagging.classify(rows, cats, syn), cats).collect()}
    assert stats == {"imagerie": (2, 0.667), "douleur": (1, 0.333), "unclassified": (1, 0.333)}
    with pytest.raises(ValueError):
        files.ontology_file("x: 1")


def test_dedup(spark):
    docs = spark.createDataFrame([(1, "a\n\nhttps://x https://x https://y\na\nhttps://x https://y\nb")], "doc_id long, text string")
    assert [r.line for r in dedup.lines(docs).orderBy("pos").collect()] == ["a", "https://x https://y", "b"]
    rows = spark.createDataFrame([(1, 0, "A b", 3), (1, 1, "a  b", 5), (1, 2, "c", 1)], "doc_id long, pos int, s string, score int")
    assert [r.s for r in dedup.best_of(rows, tx.column(tx.numeric_key, "s"), "score", "s", ["doc_id"]).orderBy("pos").collect()] == ["a  b", "c"]
    names = spark.createDataFrame([("n.pdf", 2), ("n.pdf", 1), ("m.pdf", 1)], "name string, o int")
    assert {(r.o, r.name) for r in dedup.rank_names(names, "name", "o").collect()} == {(1, "n.pdf"), (2, "n_2.pdf"), (1, "m.pdf")}


def test_folds():
    assert split.pack_paragraphs(["aaa", "bbb", "c" * 12], 10) == ["aaa\n\nbbb", "c" * 10, "cc"]
    assert split.pack_words(["a b", "c d", "e f g h"], 3) == ["a b", "c d", "e f g", "h"]
    assert [len(x) for x in split.split_by_size(["abc\n"] * 5, 8)] == [8, 8, 4]
    rng = random.Random(1)
    for _ in range(200):
        lines = ["w " * rng.randint(0, 30) for _ in range(rng.randint(0, 12))]
        text = "".join(x + "\n" for x in lines)
        assert "".join(split.split_by_size([x + "\n" for x in lines], 50)) == text
        got = split.pack_words(lines, 20)
        assert " ".join(got).split() == text.split() and all(len(g.split()) <= 20 for g in got)
        assert " ".join(split.pack_lines(lines, 25, 10)).split() == text.split()


def test_sections_and_sentences(spark):
    text = "# T\nlost\n## Abstract\nsum\n## S1\nx\n### S1a\ny"
    got = split.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.title, r.section, r.subsection, r.is_abstract, r.line) for r in got] == [("T", "Abstract", None, True, "sum"), ("T", "S1", None, False, "x"), ("T", "S1", "S1a", False, "y")]
    assert one(spark, split.numeric_sentences("x"), "See Fig. 3 here. It is 5 kg; 6 m. done") == [["See Fig. 3 here.", "It is 5 kg;", "6 m. done"]]
    assert one(spark, numeric.merge_broken(F.split("x", r"\|")), "We found 5 kg of:|salt and more|Next one has nothing at all to say.") == [["We found 5 kg of: salt and more", "Next one has nothing at all to say."]]
    facts = numeric.numeric_facts(spark.createDataFrame([(1, "The mass was measured at 5.3 kg with a precision of 0.2 percent. Published 2024.\n\npage 3")], "doc_id long, text string")).collect()
    assert [(r.score, r.sentence) for r in facts] == [(10, "The mass was measured at 5.3 kg with a precision of 0.2 percent.")]


def test_web(spark):
    html = '<article><time datetime="2025-01-02"></time><a class=x href="/b/">B</a><a href="c?page=2">C</a><a href="//o.fr/z">O</a><a href="/b">B</a><a href="/x.pdf">P</a></article>'
    pages = spark.createDataFrame([(1, "https://www.a.fr/d/e", html)], "page_id long, url string, html string")
    assert [(r.link, r["class"]) for r in web.links(pages).orderBy("pos").collect()] == [("https://www.a.fr/b", "article"), ("https://www.a.fr/d/c?page=2", "pagination"), ("https://o.fr/z", "off_domain"), ("https://www.a.fr/x.pdf", "other")]
    assert pages.selectExpr(web.news_score(Spark, "html"), web.page_year(Spark, "html", "url")).first()[:] == (4, 2025)
    assert one(spark, F.expr(web.page_year(Spark, "''", "x")), "https://x.fr/2026/03/a", "https://x.fr/view/titre-2026a1000ais") == [2026, 2026]
    assert one(spark, F.expr(web.link_class(Spark, "x", "'https://x.fr'", r"x\.fr/actus/[^/?#]+")), "https://x.fr/actus/12", "https://x.fr/actus/a", "https://x.fr/b") == ["pagination", "article", "other"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, link string")
    assert {tuple(r) for r in web.frontier(edges, spark.createDataFrame([("a",)], "url string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    robots = spark.createDataFrame([("x.fr", "/no", False)], "host string, prefix string, allow boolean")
    assert [r.link for r in web.allowed(spark.createDataFrame([("https://x.fr/no/a",), ("https://x.fr/yes",)], "link string"), robots).collect()] == ["https://x.fr/yes"]


def test_ranges(spark):
    rows = spark.createDataFrame([(1, a, b) for a, b in [(0, 3), (3, 5), (7, 9), (8, 10), (4, 4)]], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in ranges.merge_ranges(rows, ["k"]).collect()) == [(0, 5), (7, 10)]
    spans = ranges.protected_ranges("see https://a.b/c and x2y 5 kg Term", ["term"])
    assert [("see https://a.b/c and x2y 5 kg Term")[a:b] for a, b in spans] == ["https://a.b/c", "x2y", "5 kg", "Term"]
    assert ranges.correct("teh caf x2y", lambda t: [(0, 3, ["the", "tea"]), (4, 3, ["café"]), (8, 3, ["no"])]) == "the café x2y"
    assert ranges.best_replacement("cafe", ["cape", "café"]) == "café"
    assert ranges.styled_runs("aabb", [1, 1, 2, 2]) == [("aa", 1), ("bb", 2)]
    assert ranges.projected_styles("abc", "abXc", [1, 1, 2]) == [1, 1, 1, 2]


def test_statistics(spark):
    lex = {"bon": 2.0, "mal": -2.0}
    docs = spark.createDataFrame([(1, "Bon! Mal. Rien. Rien ici."), (2, "")], "doc_id long, text string")
    got = {r.doc_id: (r.positif, r.negatif, r.neutre) for r in lexical.sentiment(docs, lex, split.sentences("text")).collect()}
    assert got == {1: (25.0, 25.0, 50.0), 2: (0.0, 0.0, 0.0)}
    rows = [(i, "chat chien lapin " * 3 if i % 2 else "moteur roue frein " * 3) for i in range(12)]
    weights = lexical.tfidf(spark.createDataFrame(rows, "doc_id long, text string"), ["le"])
    norms = [r[0] for r in weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2)).select(F.col("sum(POWER(weight, 2))")).collect()]
    assert all(abs(n - 1) < 1e-9 for n in norms)
    names, assigned = topics.nmf(weights, topics=2, rounds=6)
    by = {r.doc_id: r.topic_id for r in assigned.collect()}
    assert len({by[i] for i in by if i % 2}) == 1 and len(set(by.values())) == 2 and names.count() == 2
    with pytest.raises(ValueError):
        topics.nmf(weights.where("doc_id < 2"))
    guess = lexical.language(spark.createDataFrame([("der Hund und die Katze",), ("zzz",)], "text string"), dic.LANGUAGE_WORDS).collect()
    assert [r.detected for r in guess] == ["de", None]


def test_topics_of_all_terms(spark):
    rng = random.Random(3)
    rows = [(i, f"w{j}", rng.random() + (j % 3 == i % 3)) for i in range(60) for j in rng.sample(range(90), 12)]
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    chunks = spark.range(61).withColumnRenamed("id", "doc_id")
    told = lambda held: {r.doc_id: (r.topic_id, r.confidence) for r in topics.nmf(weights, topics=3, chunks=chunks, held=held, block=32, rounds=6, tol=0)[1].collect()}
    whole = told(1000)
    assert len(whole) == 61 and whole[60] == (0, 0.0)  # each chunk is there, also one without terms
    dense = np.zeros((60, 90))
    for i, w, v in rows:
        dense[i, int(w[1:])] = v
    i, j = dense.nonzero()
    w, h, used = topics.factors(topics.Held(i, j, dense[i, j], {"d": 60, "t": 90}), 3, 400, 1e-4, dense.sum() / (61 * 90), 42)
    assert w.shape == (3, 60) and h.shape == (3, 90) and 8 < used < 400 and (h.max(0) > 0).all()  # all terms; ends by the tolerance
    cells, single = told(0), told(1000)
    assert all(cells[k][0] == single[k][0] and abs(cells[k][1] - single[k][1]) < 1e-6 for k in single)


def test_tfidf_terms_are_all_there(spark, tmp_path):
    from lexloom.plans.queries import QUERIES

    rows = [("c", i, "u", x) for i, x in enumerate(["zebra alpha", "zebra beta", "alpha beta", "alpha gamma", "delta epsilon", "beta iota"])]
    spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {(r.term, r.n) for r in QUERIES["tfidf_terms"](spark, str(tmp_path)).collect()} == {("zebra", 2), ("alpha", 3), ("beta", 3)}


def test_python_holds_few_rows_at_a_time(spark):
    import pyarrow as pa

    seen = []
    for made, rows in ((split.by_steps(lambda v: v, pa.string(), "string"), pa.array([str(i) for i in range(1000)])), (split.by_steps(lambda a, b: [a, *b], pa.list_(pa.string()), "array<string>"), pa.array([{"a": "x", "b": [str(i)]} for i in range(1000)]))):
        seen.append(list(made.func(iter([rows, rows.slice(0, 0)]))))
        assert max(map(len, seen[-1])) <= 64 and sum(map(len, seen[-1])) == 1000
    assert seen[0][-1][-1].as_py() == "999" and seen[1][-1][-1].as_py() == ["x", "999"]
    texts = spark.createDataFrame([(i, None if i % 7 == 0 else f"{i}\n" * (i % 5)) for i in range(500)], "i int, x string").coalesce(1)
    got = {r.i: r.y for r in texts.select("i", split.folded(split.pack_words, F.split("x", "\n"), 2).alias("y")).collect()}
    assert all(got[i] == (None if i % 7 == 0 else split.pack_words((f"{i}\n" * (i % 5)).split("\n"), 2)) for i in range(500))
    told = generation.folded_rows(texts.select("i", F.split("x", "\n").alias("l"), F.lit("t").alias("t")), lambda ws, t: [t, str(None if ws is None else len(ws))], ["l", "t"], "y")
    assert {r.i: r.y for r in told.collect()} == {i: ["t", str(None if i % 7 == 0 else i % 5 + 1)] for i in range(500)}


def test_documents_are_cut_without_shuffles(spark):
    text = "lost\n### A\nsub of none\n# Abstract\nshort\n## One\nx y\n\n###  Part \nz\n# Two\n####### no head\n## abstract\nmore"
    assert documents.outlined(text)[0] == "A"
    title, plan, parts = documents.outlined("# T\nlost\n" + text)
    assert title == "T" and plan == "TITLE: T\nABSTRACT: present\n1. Untitled section\n   1.1 A\n2. One\n   2.1 Part\n3. Two"
    assert parts == [(True, "Abstract", "", "short\nmore"), (False, "Untitled section", "A", "sub of none"), (False, "One", "", "x y"), (False, "One", "Part", "z"), (False, "Two", "", "####### no head")]
    docs = spark.createDataFrame([(1, text), (2, None), (None, "plain"), (4, "# only")], "doc_id long, text string")
    chunks = documents.section_chunks(docs, 60, 20)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.chunk, r.section, r.text) for r in chunks.where("doc_id is null or doc_id > 1").orderBy("doc_id").collect()] == [(None, 0, documents.WHOLE, "plain"), (2, 0, documents.WHOLE, None), (4, 0, documents.WHOLE, "# only")]
    lists = documents.idea_lists(chunks, documents.plans(docs))
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3  # chunks and plans meet, and no more


def test_generation(spark):
    dual = spark.createDataFrame([("### NUMERIC DATA\n- 5 %\n### IDEAS\n- idea\ntext",)], "x string").select(generation.two_sections("x").alias("r")).first().r
    assert (dual.numeric, dual.ideas) == (["5 %"], ["idea"])
    chunks = spark.createDataFrame([(1, i, f"Point {i} has 7 things. Other sentence {i}.") for i in range(8)], "doc_id long, chunk int, text string")
    assert generation.ideas(chunks).where("idea like 'Point%'").count() == 8
    assert generation.summaries(chunks).first().summary.startswith("- ")

    def broken(prompt):
        raise ValueError("down")

    assert "ERREUR ValueError: down" in generation.summaries(chunks, broken).first().summary


def test_naming(spark):
    rows = spark.createDataFrame([("p1", "a.pdf", "Rapport annuel", 2024), ("p2", "b.pdf", "Rapport annuel", 2024), ("p3", "c.pdf", "ERREUR x", None)], "path string, old string, title string, year int")
    plan = {r.path: (r.new, r.action) for r in naming.rename_plan(rows).collect()}
    assert plan["p1"] == ("2024 - RAPPORT ANNUEL.pdf", "renamed") and plan["p2"] == ("2024 - RAPPORT ANNUEL_2.pdf", "renamed") and plan["p3"][1] == "failed"
    assert one(spark, naming.best_title(F.split("x", ",")), "abc,Vrai titre", "abc", "TITRE INCONNU,ok fine") == ["Vrai titre", "abc", "ok fine"]


def test_sources_and_sinks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_bytes("été".encode("cp1252"))
    (src / "b.md").write_text("# x\ny")
    with zipfile.ZipFile(src / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p/></w:d>')
    with zipfile.ZipFile(src / "s.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<a:d xmlns:a="u"><a:p><a:t>slide {n}</a:t></a:p></a:d>')
    (src / "bad.docx").write_bytes(b"no zip")
    got = {files.local_name(r.path): r for r in files.documents(spark, str(src)).collect()}
    assert got["a.txt"].text == "été" and got["d.docx"].text == "Hello\n" and got["s.pptx"].text == "slide 2\nslide 10" and "BadZipFile" in got["bad.docx"].error
    assert files.pptx_status("s.pptx", (src / "s.pptx").read_bytes()).startswith("missing")
    assert files.lines(spark, str(src), "*.md").select("pos", "line").collect()[1][:] == (2, "y")
    rows = spark.createDataFrame([("b", "B"), ("a", "A")], "n string, t string")
    assert rows.agg(sinks.joined(["n"], "t")).first()[0] == "A\n" + "=" * 50 + "\nB"
    sinks.csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert files.terms_file("﻿A\n# c\na\nB\n") == ["A", "B"] and files.sites_file("defaults: {date_regex: d}\nsites:\n- {name: x, start_urls: [u]}\n- {name: y}") == [{"date_regex": "d", "name": "x", "start_urls": ["u"]}]
    assert files.html_markdown("<h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><script>x</script>") == "# T\n\na **b** [c](u)"


def test_streams(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "1.txt").write_text("a\nb\na\n")
    run = lambda: streams.once(streams.distinct_lines(streams.text_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    (src / "2.txt").write_text("b\nc\n")
    run()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_letters_with_marks(spark):
    import unicodedata

    words = ["Łódź Dvořák", "Ångström ǆ Ǆ", "Việt Nam", "İstanbul", "e\u0301te\u0301", "straße œuf", "ΆΈ й ё", "ﬁ ①"]
    bare = ["".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in words]
    assert one(spark, F.expr(Spark.accents("x")), *words) == bare and bare[0] == "Łodz Dvorak"
    assert one(spark, naming.plain_name("x"), "Dvořák.PDF") == ["dvorak.pdf"]


FLAGGED = [
    ("25°C was reached", "unit"), ("It took 5 ms", "unit"), ("a 3 % share", "unit"), ("p.p.m.x", "unit"), ("5.3 ± 0.2", "measure"), ("1.2(3)x", "measure"), ("3 x 10^-7", "measure"), ("1e5", "measure"), ("It was found", "verb"),
    ("12. Smith", "reference_entry"), ("Nature 5 (2020)", "journal"), ("Phys. Rev. 1, 2-3", "journal"), ("Doe et al (2019)", "journal"), ("Fig. 3a shows", "caption"), ("Extended data table 2", "caption"), ("a | b | c", "axis_fragment"),
    ("time (s) axis", "axis_fragment"), ("1 2.5 -3 only", "axis_fragment"), ("Alpha beta gamma", "axis_fragment"), ("Signal (a.u.) one two", "axis_fragment"), ("3 of 10 pages", "page_counter"), ("1.2 Methods", "section_title"), ("Appendix", "section_title"),
    ("https://x.y", "metadata"), ("see doi 10", "metadata"), ("by smith, J. and", "reference_fragment"), ("a (b) ; c (d) ; e ;", "reference_fragment"), ("But this goes on and on for some time", "incomplete"), ("Short one", "incomplete"), ("and so on", "continuation"), ("] rest", "continuation"), ("No unit here at all?", None), ("Alpha beta", None),
]


def test_each_flag_by_example(spark):
    for x, flag in FLAGGED:
        got = spark.createDataFrame([(x,)], "x string").select(*(p.column(f, "x").alias(n) for n, f in p.FLAGS.items())).first().asDict()
        if flag:
            assert got[flag], (x, flag)
        else:
            assert not got["unit"] and not got["axis_fragment"] and not got["measure"], (x, got)


MARKDOWN = "# T\nlost\n## Abstract\nsum one\nsum two\n### Early\nwords of early\n## S1\nx of s1\n### S1a\ny of s1a\n### S1b\n## S2\nz of s2"


def test_plans_and_section_chunks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "plain text\nwithout headings"), (3, "# Only title\nlost")], "doc_id long, text string")
    plans = {r.doc_id: (r.title, r.plan) for r in documents.plans(docs).collect()}
    assert plans[1] == ("T", "TITLE: T\nABSTRACT: present\n1. Untitled section\n   1.1 Early\n2. S1\n   2.1 S1a\n   2.2 S1b\n3. S2")
    assert plans[2] == (None, "") and plans[3] == ("Only title", "TITLE: Only title")
    got = [(r.doc_id, r.section, r.subsection, r.text) for r in documents.section_chunks(docs).orderBy("doc_id", "chunk").collect()]
    assert got[:5] == [(1, "Abstract", "", "sum one\nsum two"), (1, "Untitled section", "Early", "words of early"), (1, "S1", "", "x of s1"), (1, "S1", "S1a", "y of s1a"), (1, "S2", "", "z of s2")]
    assert got[5:] == [(2, "Full document", "", "plain text\nwithout headings"), (3, "Full document", "", "# Only title\nlost")]


def test_ideas_in_three_passes(spark):
    """The gap check is told what has been found, also by itself; consolidation replaces the list unless it is silent."""
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    chunks, plan = documents.section_chunks(docs), documents.plans(docs)

    def generate(prompt):
        text = prompt.rpartition("TEXT:\n")[2]
        if prompt.startswith("Extract"):
            assert "PLAN:\nTITLE: T" in prompt
            return "NONE" if "sum" in text else f"- idea of {text.split()[-1]}"
        if prompt.startswith("Return only"):
            told = prompt.split("ALREADY FOUND:\n")[1]
            return "NONE" if "extra" in told else "- extra idea\n- idea of s1"
        assert prompt.startswith("Clean") and "- extra idea" in text
        return text.replace("- idea of s2\n", "").replace("idea of s1a", "Idea of S1A!")

    assert [r.idea for r in documents.ideas(chunks, plan, generate).orderBy("pos").collect()] == ["idea of early", "idea of s1", "Idea of S1A!", "extra idea"]
    silent = lambda p: "" if p.startswith("Clean") else generate(p)
    assert [r.idea for r in documents.ideas(chunks, plan, silent).orderBy("pos").collect()] == ["idea of early", "idea of s1", "idea of s1a", "idea of s2", "extra idea"]
    done = documents.process(spark.createDataFrame([(1, "# Title\n## S\nThe mass was measured at 5.3 kg with a precision of 0.2 percent."), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert done[0].report == "TITRE : Title\n\nLES IDEES DU DOCUMENT :\n- The mass was measured at 5.3 kg with a precision of 0.2 percent.\n\nLES CHIFFRES DU DOCUMENT :\n- ## S The mass was measured at 5.3 kg with a precision of 0.2 percent.\n" or "5.3 kg" in done[0].report
    assert "No idea extracted." in done[1].report and "Unknown title" in done[1].report


def test_fused_extraction(spark):
    chunks = spark.createDataFrame([(1, 0, "Sales grew 12 % in all. Page 3. Trees are green."), (1, 1, "Nothing here.")], "doc_id long, chunk int, text string")
    seen = []

    def generate(prompt):
        if prompt.startswith("Extract"):
            return "### NUMERIC DATA\n- Sales grew 12 %\n- Page 3\n### IDEAS\n- Trees are green" if "Sales" in prompt else "### NUMERIC DATA\nNONE\n### IDEAS\nNONE"
        if prompt.startswith("REVIEW"):
            return "- Sales grew 12 %\nnoise"
        assert "- Sales grew 12 %\n" in prompt
        return "### NUMERIC DATA\n- Sales grew 12 %\n### IDEAS\n- more" + ("" if "- more\n" not in prompt else "\n- yet more")

    got = generation.numeric_and_ideas(chunks, generate).first()
    assert (got.numeric, got.ideas) == (["Sales grew 12 %"], ["Trees are green", "more", "yet more"]) and not seen
    told = spark.createDataFrame([(["a"], [])], "numeric array<string>, ideas array<string>").select(generation.fused_report()).first()[0]
    assert told == "## Numeric data\n\n- a\n\n## Ideas\n\n_None found._\n"
    assert one(spark, generation.bullet_list("x"), "- a\n* b\nc\n-  d\n- ") == [["a", "d"]]
    assert one(spark, generation.bullet_lines("x"), "- a\n* b\n\nNONE\n3. c  d") == [["a", "b", "c d"]] and generation.lines_of("- a\n* b\n\nNONE\n3. c  d") == ["a", "b", "c d"]


def test_older_tagger_and_modes(spark):
    docs = spark.createDataFrame([(1, "abc def\n\nxyz")], "doc_id long, text string")
    got = [(r.phrase, r.tags, r.motcle) for r in tagging.legacy_tags(docs, ["#AB,abc,def\n", "#A,def\n", "#X,xyz\n", "#E,q,"]).orderBy("pos").collect()]
    assert got == [("abc def", "#AB;#E", "abc;"), ("", "#E", ""), ("xyz", "#X;#E", "xyz\n;")]  # #A is part of #AB, the empty word in all
    rows = spark.createDataFrame([(1, 0, "der the and"), (1, 1, "und"), (1, 9, "the")], "doc_id long, pos int, sentence string")
    multi = {r.pos: r for r in tagging.classify(rows, dic.ONTOLOGY).collect()}
    assert (multi[0].all_categories, multi[0].all_labels, multi[0].all_keywords) == ("en;de", "English forms;German forms", "the,and;der")
    single = {r.pos: r for r in tagging.classify(rows, dic.ONTOLOGY, multi=False, most=5).collect()}
    assert set(single) == {0, 1} and (single[0].all_categories, single[0].all_scores, single[0].all_keywords) == ("en", "2", "the,and")
    order = [tuple(r) for r in lexical.word_order(spark.createDataFrame([(2, "b a"), (1, "c a c")], "doc_id long, text string"), []).collect()]
    assert order == [("c", 2, 1, 0), ("a", 2, 1, 1), ("b", 1, 2, 0)]


def test_crawl(spark):
    def fetch(url):
        if "down" in url:
            raise TimeoutError("slow")
        return (404, "") if "gone" in url else (200, f"<article><time></time>{url}</article>" if "news" in url else "<p>plain")

    pages = web.fetched(spark.createDataFrame([(u,) for u in ("http://s/news/2024/a", "http://s/news/2023/b", "http://s/plain", "http://s/gone", "http://s/down", "http://s/news/c")], "url string"), fetch)
    got = {r.url.rpartition("/")[2]: (r.status, r.year, r.file, r.detail) for r in web.visited(pages, current=2024).collect()}
    assert got == {"a": ("saved", 2024, "s_news_2024_a.html", None), "b": ("skipped_year", 2023, None, None), "plain": ("not_article", None, None, None), "gone": ("error", None, None, "404"), "down": ("error", None, None, "TimeoutError: slow"), "c": ("saved", None, "s_news_c.html", None)}
    assert {r.status: r.n for r in web.crawl_stats(web.visited(pages, article="/news/", current=2024, undated=False)).collect()} == {"saved": 1, "skipped_year": 2, "not_article": 1, "error": 2}
    when = "<div><span class=\"x date\">Paris, 03/02/2021</span> on 01/01/2020</div>"
    for selector, want in ((".date", 2021), ("span.date", 2021), ("#no", 2021), (None, 2021)):
        assert one(spark, F.expr(web.page_year(Spark, "x", "'u'", selector=selector)), when) == [want], selector
    assert one(spark, F.expr(web.page_year(Spark, "x", "'u'", pattern=r"on (\d\d/\d\d/20\d\d)")), when) == [2020]

    links = {"s0": [("p1", "pagination"), ("a1", "article")], "p1": [("p2", "pagination"), ("s0", "pagination"), ("a2", "article")], "p2": [("p3", "pagination"), ("a1", "article")], "p3": [("a9", "article")]}
    asked = []

    def read(new):
        urls = sorted(r.url for r in new.collect())
        asked.extend(urls)
        return spark.createDataFrame([(u, *x) for u in urls for x in links.get(u, [])] or [("none", "none", "other")], "url string, link string, class string")

    start = spark.createDataFrame([("site", "s0")], "site string, url string")
    cached = spark.createDataFrame([("p1", *x) for x in links["p1"]], "url string, link string, class string")
    articles, cache = web.listing(start, cached, read, most=3)
    assert [r.url for r in articles.orderBy("place", "url").collect()] == ["a1", "a2"] and asked == ["s0", "p2"]  # p1 from the cache, p3 beyond the bound
    todo = spark.createDataFrame([("s", i, f"u{i}") for i in range(6)], "site string, o int, url string")
    seen = spark.createDataFrame([("u0", "saved"), ("u1", "error")], "url string, status string")
    assert [r.url for r in web.at_most(todo, seen, ["o"], most=3).orderBy("o").collect()] == ["u2", "u3"]
    robots = spark.createDataFrame([("x.fr", "/no", False), ("x.fr", "/no/yes", True)], "host string, prefix string, allow boolean")
    urls = spark.createDataFrame([(f"https://x.fr{u}",) for u in ("/no/a", "/no/yes/b", "/a/no", "")] + [("https://y.fr/no",)], "link string")
    assert sorted(r.link for r in web.allowed(urls, robots).collect()) == ["https://x.fr", "https://x.fr/a/no", "https://x.fr/no/yes/b", "https://y.fr/no"]


A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def deck(*slides):
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("ppt/presentation.xml", "_rels/.rels", "ppt/_rels/presentation.xml.rels", "[Content_Types].xml"):
            z.writestr(name, "<x/>")
        for i, body in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="urn:p" xmlns:a="{A}">{body}</p:sld>')
    return out.getvalue()


def test_decks(spark, tmp_path):
    import re

    run = lambda t, props="": f"<a:r><a:rPr {props}/><a:t>{t}</a:t></a:r>"
    text = "<a:p>" + run("I has ", 'b="1"') + run("a a dog", 'i="1"') + "<a:br/>" + run("see https://teh.x teh") + "</a:p>"
    font = '<a:p><a:r><a:rPr><a:latin typeface="Calibri Light"/></a:rPr><a:t>plain</a:t></a:r></a:p>'
    table = f'<a:tbl><a:tr><a:tc><a:txBody><a:p>{run("teh")}</a:p></a:txBody></a:tc><a:tc hMerge="1"><a:txBody><a:p>{run("teh")}</a:p></a:txBody></a:tc></a:tr></a:tbl>'
    good, same, broken = deck(text + font, table), deck(f"<a:p>{run('fine')}</a:p>"), b"no zip"

    def check(t):
        found = [decks.Match(m.start(), 3, ["the", "tea"]) for m in re.finditer("teh", t)] + [decks.Match(m.start(), 3, ["have"], category="GRAMMAR", issue="other") for m in re.finditer(r"\bhas\b", t)]
        return found + [decks.Match(m.start(), 3, [], issue="grammar") for m in re.finditer("dog", t)] + [decks.Match(0, 1, ["Me"], rule="STYLE_X") for m in re.finditer("^I ", t)] + [decks.Match(0, 1, ["x"], issue="other") for m in re.finditer("^see", t)]

    files_ = spark.createDataFrame([(f"{tmp_path}/{n}.pptx", d) for n, d in (("good", good), ("same", same), ("broken", broken))], "path string, content binary")
    done = decks.correct_decks(files_, lambda lang: check, detect=lambda t: ("en", "")).cache()
    got = {r.path.rpartition("/")[2]: r for r in done.collect()}
    assert {k: r.status for k, r in got.items()} == {"good.pptx": "CORRECTED", "same.pptx": "UNCHANGED", "broken.pptx": "SKIPPED"} and got["broken.pptx"].reason == "no archive"
    g = got["good.pptx"]
    assert (g.applied, g.protected, g.style, g.without, g.ignored, g.fonts, g.slides) == (3, 1, 1, 1, 4, 1, 2)
    assert decks.summary(done).first()[:] == (3, 1, 1, 1, 0, 3, 4, 1)
    (tmp_path / "good.pptx").write_bytes(good)
    assert [r.error for r in decks.replace_files(done).collect()] == [None]
    with zipfile.ZipFile(tmp_path / "good.pptx") as z:
        xml, two = z.read("ppt/slides/slide1.xml").decode(), z.read("ppt/slides/slide2.xml").decode()
    assert files.office_text("good.pptx", (tmp_path / "good.pptx").read_bytes()).split("\n")[0] == "I have a a dogsee https://teh.x the" and 'typeface="Aptos Light"' in xml
    assert re.findall(r'b="1" ?/><a:t>([^<]*)', xml) == ["I have "] and xml.count("<a:br") == 1 and two.count("the<") == 1 and two.count("teh<") == 1
    assert decks.language("the cat and the dog " * 30)[0] == "en" and decks.language("short")[0] is None and decks.language("der Hund und die Katze ist da " * 20)[1].endswith("de")
    assert decks.language_text("see https://a.b now") == "see now"
    with pytest.raises(ValueError, match="no folder.*no file"):
        decks.validated(str(tmp_path / "none"), str(tmp_path))


def pdf(*pages, extra=b""):
    import zlib

    out = b"%PDF-1.4\n1 0 obj <</CreationDate (D:20190203) /ModDate (D:2021)>> endobj\n" + extra
    for i, p in enumerate(pages):
        body = zlib.compress(p) if i % 2 else p
        out += b"%d 0 obj <</Length %d%s>> stream\n" % (i + 5, len(body), b" /Filter /FlateDecode" if i % 2 else b"") + body + b"\nendstream endobj\n"
    return out + b"%%EOF"


def test_pdf(spark, tmp_path):
    data = pdf(b"BT /F1 12 Tf 1 0 0 1 5 5 Tm (Hello \\(a\\) ) Tj T* [(Wor) -20 (ld \\351)] TJ ET", b"BT <48 69> Tj ET", b"q 1 0 0 1 0 0 cm Q")
    assert files.pdf_pages(data) == ["Hello (a) \nWorld é", "Hi"] and files.pdf_text(data, 1) == "Hello (a) \nWorld é" and files.pdf_dates(data) == ["D:20190203", "D:2021"]
    with pytest.raises(ValueError):
        files.pdf_pages(b"x")
    src = tmp_path / "in"
    src.mkdir()
    (src / "b.pdf").write_bytes(data)
    (src / "A.html").write_text("<h1>T</h1>")
    (src / "~$c.docx").write_bytes(b"")
    (src / "e.zip").write_bytes(b"z")
    (src / "enc.pdf").write_bytes(pdf(b"BT (x) Tj ET", extra=b"/Encrypt 3 0 R"))
    got = {files.local_name(r.path): (r.text, r.error) for r in files.documents(spark, str(src)).collect()}
    assert got["b.pdf"][0].endswith("Hi") and got["A.html"] == ("# T", None) and "encrypted" in got["enc.pdf"][1]
    assert [(r.name, r.supported) for r in files.listed(spark, str(src)).collect()] == [("A.html", True), ("b.pdf", True), ("e.zip", False), ("enc.pdf", True)]
    raw = spark.createDataFrame([("p", b"\x01\x02")], "path string, content binary")
    images = files.page_images(raw, lambda data, first, dpi: [data, data * 2, data * 3, data * 4])
    assert images.count() == 3 and raw.select(files.base64_file()).first()[0] == "AQI="

    def ask(image):
        if len(image) > 4:
            raise OSError("model")
        return f"Title {len(image)}"

    titles = files.image_titles(images, ask).first().titles
    assert titles == ["Title 2", "Title 4", "ERREUR OSError: model"] and files.missing_models(str(src), ("b.pdf", "m.bin")) == ["m.bin"]
    fetch = lambda video, lang: [" a ", "", "b"] if lang == "en" else (_ for _ in ()).throw(type("NoTranscriptFound", (Exception,), {})())
    rows = files.transcripts(spark.createDataFrame([("https://youtu.be/abcdefg",), ("none",)], "url string"), fetch).collect()
    assert [(r.language, r.text, r.code) for r in rows] == [("en", "a\nb", 0), (None, None, 1)]
    assert files.decode(b"\xe9", ("utf-8:ignore",)) == "" and files.decode(b"\x81", ("utf-8", "cp1252:replace")) == "\ufffd"


def test_reports_and_workbooks(spark, tmp_path):
    from xml.etree import ElementTree

    rows = spark.createDataFrame([("a<b", 1, None), ("é", 2, "x")], "t string, n int, m string").coalesce(1)
    sinks.xlsx(rows, f"{tmp_path}/r.xlsx")
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        cells = [[("".join(c.itertext())) for c in r] for r in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))[0]]
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    assert cells == [["t", "n", "m"], ["a<b", "1", ""], ["é", "2", "x"]]
    sinks.csv_with_mark(rows, f"{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbft,n,m\na<b,1,\n")
    done = sinks.named_files(rows, f"{tmp_path}/out", "n", "t", "_extraction.txt").orderBy("name").collect()
    assert [(r.name, r.bytes, r.error) for r in done] == [("1", 3, None), ("2", 2, None)] and (tmp_path / "out" / "2_extraction.txt").read_text() == "é"
    (tmp_path / "out" / "sub").mkdir()
    assert sinks.cleared(spark, f"{tmp_path}/out") == 2 and (tmp_path / "out" / "sub").exists() and sinks.cleared(spark, f"{tmp_path}/out", tree=True) == 1 and not (tmp_path / "out").exists()
    journal = spark.createDataFrame([("u", "saved", None)], "url string, status string, detail string")
    assert files.journal(spark, f"{tmp_path}/j").count() == 0
    sinks.save_journal(journal, f"{tmp_path}/j")
    sinks.save_journal(journal, f"{tmp_path}/j")
    assert files.journal(spark, f"{tmp_path}/j").count() == 2
    named = spark.createDataFrame([("x-10.md", "C"), ("notes.md", "D"), ("x-2.md", "B")], "n string, t string").select("t", *sinks.by_number("n"))
    assert named.agg(sinks.joined(["_none", "_number", "_name"], "t", "|")).first()[0] == "B|C|D"


def test_growing_lists(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()

    def run():
        stream = spark.readStream.schema("doc_id long, item string").json(str(src))
        streams.once(streams.growing_lists(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)

    (src / "1.json").write_text('{"doc_id": 1, "item": "a"}\n{"doc_id": 1, "item": "b"}\n{"doc_id": 1, "item": "a"}\n{"doc_id": 2, "item": "a"}\n')
    run()
    (src / "2.json").write_text('{"doc_id": 1, "item": "b"}\n{"doc_id": 1, "item": "c"}\n{"doc_id": 2, "item": null}\n')
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.place, r.item) for r in got) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a")]


def test_queries_have_columns_and_oracles():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
