"""The engine's queries over the supplied tables: (spark, sf_dir) -> DataFrame.

Names say the operators; the row ids are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dictionaries as dic
from ..functions import predicates as p
from ..functions import text as tx
from ..functions.dialect import Spark
from ..operators import decks, dedup, documents as sectioned, generation, lexical, naming, numeric, ranges, split, tagging, topics, web
from ..sources import sinks

QUERIES = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; where its scan has fewer tasks than the cluster has cores, its rows are spread.

    Large tables have more splits than that and are read as they lie, without a shuffle.
    """
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query
def ngrams_top(spark, sf_dir):
    """T5, F2, T7, A2, W1."""
    return lexical.top_ngrams(documents(spark, sf_dir), by=["lang"])


@query
def ngrams_by_role(spark, sf_dir):
    return lexical.top_ngrams(table(spark, sf_dir, "conversations"), by=["role"], sizes=(2,), top=50)


@query
def word_freq(spark, sf_dir):
    """T6, F1, P1, A1."""
    return lexical.word_freq(documents(spark, sf_dir))


@query
def cloud_weights(spark, sf_dir):
    """P36, A3."""
    return lexical.cloud_weights(documents(spark, sf_dir))


def sentences(spark, sf_dir):
    return split.posed(documents(spark, sf_dir), split.sentences("text"), "sentence", "doc_id")


@query
def sentence_split(spark, sf_dir):
    """T1, F3."""
    return sentences(spark, sf_dir)


@query
def block_chunks(spark, sf_dir):
    """T8-T10, F4."""
    return split.posed(documents(spark, sf_dir), split.topic_chunks("text"), "chunk", "doc_id")


@query
def line_dedup(spark, sf_dir):
    """F5, P33, D1."""
    return dedup.lines(documents(spark, sf_dir))


@query
def text_dedup(spark, sf_dir):
    """Regardless of case and white space, the first stays."""
    return dedup.first_rows(documents(spark, sf_dir).select("doc_id", "text"), F.lower(tx.column(tx.squeeze, "text")), ["doc_id"])


@query
def idea_dedup(spark, sf_dir):
    """P10, P11, D3, L5 on sentences."""
    rows = sentences(spark, sf_dir).withColumn("idea", tx.column(tx.idea, "sentence")).withColumn("key", F.expr(tx.idea_key(Spark, "idea"))).where("key <> ''")
    return dedup.first_rows(rows.select("doc_id", "pos", "key", "idea"), "key", ["pos"], ["doc_id"])


@query
def tag_lines(spark, sf_dir):
    """S8, P2, J1, C15."""
    return tagging.tag_phrases(documents(spark, sf_dir), dic.TAGS)


@query
def tag_counts(spark, sf_dir):
    """A11, with the untagged and all lines beside."""
    tagged = tagging.tag_phrases(documents(spark, sf_dir), dic.TAGS)
    every = F.when(F.col("tags") == "", F.array(F.lit("(all)"), F.lit("(untagged)"))).otherwise(F.array_append(F.split("tags", ";"), F.lit("(all)")))
    return tagged.select(F.explode(every).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


@query
def ontology_sentences(spark, sf_dir):
    """P4, P34, P35, J3, F33, A6-A8, J10."""
    return tagging.classify(sentences(spark, sf_dir), dic.ONTOLOGY, dic.SYNONYMS).drop("sentence")


@query
def ontology_stats(spark, sf_dir):
    """A5, U3, O2."""
    return tagging.category_stats(tagging.classify(sentences(spark, sf_dir), dic.ONTOLOGY, dic.SYNONYMS), dic.ONTOLOGY)


@query
def sentence_flags(spark, sf_dir):
    """F14-F30."""
    return sentences(spark, sf_dir).select("doc_id", "pos", *(p.column(f, "sentence").alias(n) for n, f in p.FLAGS.items()))


@query
def numeric_score(spark, sf_dir):
    """A19, P15."""
    rows = sentences(spark, sf_dir).where(p.column(p.number, "sentence"))
    return rows.select("doc_id", "pos", p.column(p.score, "sentence").alias("score"), p.column(p.alpha_words, "sentence").cast("long").alias("n_words"), p.column(p.digits, "sentence").cast("long").alias("n_digits"))


@query
def numeric_best(spark, sf_dir):
    """F31, P14, D4, L2."""
    rows = sentences(spark, sf_dir).where(p.column(p.number, "sentence")).withColumn("score", p.column(p.score, "sentence")).where("score >= 1")
    best = dedup.best_of(rows, tx.column(tx.numeric_key, "sentence"), "score", "sentence", ["doc_id"])
    return best.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where("_r <= 400").drop("_r")


@query
def numeric_facts(spark, sf_dir):
    """T3, T18, P6, P7, P12, P13, C2, C3, J8, U1."""
    return numeric.numeric_facts(documents(spark, sf_dir))


@query
def page_links(spark, sf_dir):
    """T23, P26, P27, F6-F9, J9."""
    return web.links(table(spark, sf_dir, "pages"))


@query
def link_classes(spark, sf_dir):
    return web.links(table(spark, sf_dir, "pages")).groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("link").alias("n_links"))


@query
def page_names(spark, sf_dir):
    """P26-P29, P31 on page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", tx.column(tx.url_normal, "url").alias("normal"), tx.column(tx.domain, "url").alias("domain"), tx.column(tx.url_filename, "url").alias("file"), tx.column(tx.year_in, "url").alias("year"), tx.column(tx.video_id, "url").alias("video"))


@query
def page_features(spark, sf_dir):
    """F10-F13, C8."""
    pages = table(spark, sf_dir, "pages").withColumn("score", F.expr(web.news_score(Spark, "html"))).withColumn("year", F.expr(web.page_year(Spark, "html", "url")))
    return pages.select("page_id", "score", (F.col("score") >= 3).alias("is_news"), "year", web.antibot("html").alias("blocked"))


@query
def journal_unseen(spark, sf_dir):
    """The pages whose address is in no journal row (here: listing pages have been seen)."""
    pages = table(spark, sf_dir, "pages")
    return web.unseen(pages.select("page_id", "url"), pages.where(F.col("url").rlike(web.PAGING)).select("url"))


@query
def crawl_frontier(spark, sf_dir):
    """Steps from the first address over links between hosts, and between pages of one title length."""
    links = web.links(table(spark, sf_dir, "pages"))
    pages = table(spark, sf_dir, "pages").select("page_id", tx.column(tx.domain, "url").alias("url"), F.length("url").alias("k"))
    edges = pages.join(links.select("page_id", tx.column(tx.domain, "link").alias("link")), "page_id").select("url", "link").union(pages.select("url", F.lag("url").over(W.partitionBy("k").orderBy("page_id")).alias("link"))).where("link is not null").distinct()
    return web.frontier(edges, pages.agg(F.min("url").alias("url")))


@query
def concat_by_source(spark, sf_dir):
    """A13, K13 as a digest: the joined texts of each conversation, in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sinks.joined(["turn", "text"], "text").alias("joined"))
    return rows.select("conv_id", F.length("joined").cast("long").alias("n_chars"), F.md5(F.col("joined").cast("binary")).alias("md5"))


@query
def sentiment_pct(spark, sf_dir):
    """T4, A4, X5."""
    return lexical.sentiment(documents(spark, sf_dir), dic.SENTIMENT, split.sentences("text"), ["doc_id"])


@query
def language_guess(spark, sf_dir):
    """X3 against documents.lang."""
    return lexical.language(documents(spark, sf_dir), dic.LANGUAGE_WORDS).groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query
def tfidf_terms(spark, sf_dir):
    """J7, A9 on conversation turns, the weights summed by term."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    w = lexical.tfidf(rows, dic.TOPIC_STOPWORDS)
    return w.groupBy("term").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("n"))


@query
def topics_nmf(spark, sf_dir):
    """A10, O3, L4."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return topics.nmf(lexical.tfidf(rows, dic.TOPIC_STOPWORDS), chunks=rows)[1]


@query
def title_names(spark, sf_dir):
    """Names from first lines, conflicts numbered."""
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.substring_index("text", "\n", 1), F.lit(".pdf")).alias("line"))
    rows = rows.select("doc_id", tx.column(tx.title_part, "line").alias("title"), F.expr(tx.final_name(Spark, "'2024'", "line")).alias("name"))
    return dedup.rank_names(rows, "name", "doc_id")


@query
def merged_ranges(spark, sf_dir):
    """Ranges of line items by part."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end"))
    return ranges.merge_ranges(rows, ["l_suppkey"])


@query
def chunk_words(spark, sf_dir):
    """T14."""
    return split.posed(documents(spark, sf_dir), split.folded(split.pack_words, F.split("text", "\n"), 120), "chunk", "doc_id")


@query
def chunk_chars(spark, sf_dir):
    """T11, T12."""
    return split.posed(documents(spark, sf_dir), split.folded(split.pack_paragraphs, F.split("text", "\n"), 700), "chunk", "doc_id")


@query
def chunk_lines(spark, sf_dir):
    """T15, P9."""
    return split.posed(documents(spark, sf_dir), split.folded(split.pack_lines, F.split("text", "\n"), 160, 60), "chunk", "doc_id")


@query
def size_parts(spark, sf_dir):
    """T22, K14."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.concat(s, F.lit("\n")))
    return split.posed(documents(spark, sf_dir), split.folded(split.split_by_size, lines, 2000), "part", "doc_id")


def markdown(spark, sf_dir):
    """The texts as Markdown without its other signs: the first line made the title, each fourth other one a heading, some of them of the abstract."""
    name = lambda s, i: F.when(i % 12 == 5, F.lit("Abstract")).otherwise(s)
    head = F.transform(F.split("text", "\n"), lambda s, i: F.when(i == 0, F.concat(F.lit("# "), s)).when(i % 4 == 1, F.concat(F.lit("## "), name(s, i))).when(i % 4 == 3, F.concat(F.lit("### "), s)).otherwise(s))
    return documents(spark, sf_dir).select("doc_id", tx.markdown_off(F.array_join(head, "\n")).alias("text"))


@query
def markdown_sections(spark, sf_dir):
    """P8, T16, W3."""
    return split.sections(markdown(spark, sf_dir))


@query
def doc_plans(spark, sf_dir):
    """P37."""
    return sectioned.plans(markdown(spark, sf_dir))


@query
def section_chunks(spark, sf_dir):
    """T17, T15, P6; small chunks, so that sections are cut."""
    return sectioned.section_chunks(markdown(spark, sf_dir), 60, 20)


@query
def doc_reports(spark, sf_dir):
    """Ideas in three passes and figures of each document, with the offline generator."""
    return sectioned.process(markdown(spark, sf_dir)).select("doc_id", "title", F.size("ideas").alias("n_ideas"), F.size("facts").alias("n_facts"), "report")


@query
def fused_facts(spark, sf_dir):
    """The fused extraction with its growing lists, with the offline generator."""
    chunks = split.posed(documents(spark, sf_dir), split.folded(split.pack_words, F.split("text", "\n"), 1000), "text", "doc_id").withColumnRenamed("pos", "chunk")
    return generation.numeric_and_ideas(chunks).select("doc_id", F.size("numeric").alias("n_numeric"), F.size("ideas").alias("n_ideas"), generation.fused_report().alias("report"))


@query
def doc_ideas(spark, sf_dir):
    """P38, X1, C4, C6, T19, D3, U1, U2 with the offline generator."""
    chunks = split.posed(documents(spark, sf_dir), split.folded(split.pack_words, F.split("text", "\n"), 1000), "text", "doc_id").withColumnRenamed("pos", "chunk")
    return generation.ideas(chunks)


@query
def doc_summaries(spark, sf_dir):
    """T12, T13, C7, K8, F38."""
    chunks = split.posed(documents(spark, sf_dir), split.folded(split.pack_paragraphs, F.split("text", "\n")), "text", "doc_id").withColumnRenamed("pos", "chunk")
    return generation.summaries(chunks)


@query
def line_segments(spark, sf_dir):
    """The parts of a turn between line ends, with how many basic sentences each is."""
    rows = split.posed(table(spark, sf_dir, "conversations"), split.line_segments("text"), "segment", "conv_id", "turn")
    return rows.withColumn("n", F.size(split.basic_sentences("segment")))


@query
def legacy_tags(spark, sf_dir):
    """The older tagger, whose tags suppress one another, with an empty last keyword."""
    return tagging.legacy_tags(documents(spark, sf_dir), dic.TAG_LINES)


@query
def ontology_single(spark, sf_dir):
    """A6, A8, L1, O2's labels: the dominant category alone, of the first five sentences of each text."""
    return tagging.classify(sentences(spark, sf_dir), dic.ONTOLOGY, dic.SYNONYMS, multi=False, most=5).drop("sentence", "normalized", "rewritten")


@query
def word_order(spark, sf_dir):
    """O1."""
    return lexical.word_order(documents(spark, sf_dir))


def visits(spark, sf_dir):
    """Pages as fetched: each twelfth with an HTTP error; dates of 2024 in the path of others."""
    pages = table(spark, sf_dir, "pages").withColumn("code", F.when(F.col("page_id") % 12 == 0, 404).otherwise(200))
    dated = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/2024/x"))).when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/2023/x"))).otherwise(F.col("url"))
    marked = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<time datetime="x"></time>'), "html")).otherwise(F.col("html"))
    return web.visited(pages.withColumn("url", dated).withColumn("html", marked), current=2024)


@query
def crawl_visits(spark, sf_dir):
    """The journal row of each page."""
    return visits(spark, sf_dir).select("page_id", "url", "status", "year", "file", "detail")


@query
def crawl_stats(spark, sf_dir):
    """A12."""
    return web.crawl_stats(visits(spark, sf_dir))


@query
def crawl_quota(spark, sf_dir):
    """At most three pages more a host, those that the journal has not seen."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.substring_index(tx.column(tx.domain, "url"), ".", -1).alias("site"))
    journal = pages.where("page_id % 4 = 0").select("url", F.when(F.col("page_id") % 8 == 0, "saved").otherwise("error").alias("status"))
    return web.at_most(pages, journal, ["page_id"], most=20)


@query
def rename_plan(spark, sf_dir):
    """A name from the first line and the latest year of the text."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("file-"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".pdf")).alias("old"), F.substring_index("text", "\n", 1).alias("title"), naming.document_year(F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("text")).alias("year"))
    return naming.rename_plan(rows)


@query
def rename_counts(spark, sf_dir):
    """A15."""
    return naming.counters(rename_plan(spark, sf_dir))


@query
def turn_corrections(spark, sf_dir):
    """Doubled words of the turns corrected outside of protected spans; what was done."""
    import pandas as pd

    def check(text):
        import re

        return [decks.Match(m.start(), m.end() - m.start(), [m[1]], issue="duplication") for m in re.finditer(r"\b(\w+) \1\b", text)]

    def run(batches):
        for pdf in batches:
            rows = []
            for conv, turn, text in zip(pdf["conv_id"], pdf["turn"], pdf["text"]):
                told = decks.Counts()
                new = decks.corrected(text or "", check, (), told)
                rows.append((conv, turn, told.applied, told.ignored, told.protected, new))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "applied", "ignored", "protected", "text"])

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, applied long, ignored long, protected long, text string")
