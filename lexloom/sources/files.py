"""Readers of text, office files and configuration (rows S1-S16, S22, S23, S27)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFICE = (".docx", ".pptx")
#: What a converter takes; the rest of a folder is listed as ignored.
SUPPORTED = tuple(f".{x}" for x in "adoc asciidoc bmp csv docx htm html jpeg jpg md pdf png pptx tif tiff txt webp xhtml xlsx".split())


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(path, name, bytes, changed, supported), by name whatever the case; lock files (~$) are left out."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed")).where(~F.startswith(F.col("name"), F.lit("~$")))
    return rows.withColumn("supported", F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).isin(*suffixes)).orderBy(F.lower("name"), "name")


def missing_models(path: str, names: tuple[str, ...]) -> list[str]:
    """Which model files a converter's folder lacks, before a job starts."""
    return [n for n in names if not (Path(path) / n).exists()]


def base64_file(content: str = "content"):
    """P25."""
    return F.base64(F.col(content))


_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T[*dDJjm]|TJ|'|\"|BT|ET|\[|\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each content stream of a PDF, in the order of the file: strings that show operators show.

    Plain and deflated streams with one-byte encodings; no OCR and no embedded code maps. Encrypted
    files are an error.
    """
    import zlib

    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF")
    if b"/Encrypt" in data:
        raise ValueError("an encrypted PDF")
    pages = []
    for m in re.finditer(rb"<<((?:[^<>]|<[^<]|>[^>]|<<[^<>]*>>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if b"/Subtype" in m[1] or b"/FontFile" in m[1] or b"/Type" in m[1]:
            continue
        if b"FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        if b"BT" not in raw:
            continue
        out: list[str] = []
        for t in _TEXT.findall(raw):
            if t[:1] in (b"(", b"<"):
                out.append(_pdf_string(t))
            elif t in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"', b"BT"):
                out.append("\n")
        pages.append(re.sub(r"\n+", "\n", "".join(out)).strip())
    return pages


def pdf_text(data: bytes, first: int | None = None) -> str:
    return "\n".join(pdf_pages(data)[:first])


def pdf_dates(data: bytes) -> list[str]:
    """The creation and change dates of a PDF's metadata, as they are written."""
    return [_pdf_string(m[2]) for key in (b"CreationDate", b"ModDate") for m in re.finditer(rb"/(" + key + rb")\s*(\((?:\\.|[^\\()])*\))", data)]


def page_images(files: DataFrame, render, first: int = 3, dpi: int = 160) -> DataFrame:
    """(path, page, image): ``render(bytes, first, dpi)`` gives PNG bytes; no renderer comes with the package."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, x) for p, d in zip(pdf["path"], pdf["content"]) for i, x in enumerate(render(bytes(d), first, dpi)[:first])]
            yield pd.DataFrame(rows, columns=["path", "page", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, image binary")


def image_titles(images: DataFrame, ask) -> DataFrame:
    """(path, titles): a vision model's title of each page image, in order; an error is the title ERREUR …"""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x):
            try:
                return ask(bytes(x)) or "TITRE INCONNU"
            except Exception as e:
                return f"ERREUR {type(e).__name__}: {e}"

        for b in batches:
            yield b.map(one)

    titled = images.withColumn("_t", run.asNondeterministic()("image"))
    return titled.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "_t"))), lambda s: s["_t"]).alias("titles"))


def whole_text(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text), a row a file."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, line number from 1, line)."""
    return whole_text(spark, path, glob).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def decode(data: bytes, encodings: tuple[str, ...] = ("utf-8", "cp1252", "latin-1")) -> str:
    """The first encoding that fits; one named ``x:ignore`` or ``x:replace`` always does."""
    for e in encodings:
        name, _, errors = e.partition(":")
        try:
            return data.decode(name, errors or "strict")
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def _xml_text(xml: bytes, paragraph: str, run: str) -> list[str]:
    root = ElementTree.fromstring(xml)
    local = lambda e: e.tag.rpartition("}")[2]
    return ["".join(t.text or "" for t in p.iter() if local(t) == run) for p in root.iter() if local(p) == paragraph]


def office_text(name: str, data: bytes) -> str:
    """Paragraphs of a .docx or of a .pptx's slides in order, tables and groups included."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name.lower().endswith(".docx"):
            return "\n".join(_xml_text(z.read("word/document.xml"), "p", "t"))
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return "\n".join(t for n in slides for t in _xml_text(z.read(n), "p", "t") if t.strip())


def pptx_status(name: str, data: bytes) -> str:
    """ok, or why the archive is no readable deck."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if bad := z.testzip():
                return f"broken part {bad}"
            missing = {f"{at}/{part}" for at, part in (("ppt", "presentation.xml"), ("_rels", ".rels"), ("ppt/_rels", "presentation.xml.rels"))} - names
            return f"missing {sorted(missing)[0]}" if missing else "ok" if any(n.startswith("ppt/slides/slide") for n in names) else "no slide"
    except zipfile.BadZipFile:
        return "no archive"


def text_of(name: str, data: bytes, encodings: tuple[str, ...] = ("utf-8", "cp1252", "latin-1")) -> str:
    """By suffix: office files, PDF, HTML as Markdown, else text."""
    low = name.lower()
    if low.endswith(OFFICE):
        return office_text(name, data)
    if low.endswith(".pdf"):
        return pdf_text(data)
    return html_markdown(decode(data, encodings)) if low.endswith((".html", ".htm", ".xhtml")) else decode(data, encodings)


def documents(spark: SparkSession, path: str, recursive: bool = False, encodings: tuple[str, ...] = ("utf-8", "cp1252", "latin-1")) -> DataFrame:
    """(path, text, error, year of change) of any mix of text, HTML, PDF and office files.

    A file that can't be read has an error and no text; the others aren't affected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(name, data):
            try:
                return text_of(name, data, encodings), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            got = [one(n, bytes(d)) for n, d in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in got], "error": [e for _, e in got], "year": pdf["year"]})

    rows = files.where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content", F.year("modificationTime").alias("year"))
    return rows.mapInPandas(run, "path string, text string, error string, year int")


def keyword_file(text: str) -> list[tuple[int, str, str, int]]:
    """Lines ``#TAG,word,word`` (the first separator may be ``;``); repeated tags are merged."""
    out: list[tuple[int, str, str, int]] = []
    order: dict[str, int] = {}
    count: dict[str, int] = {}
    for line in text.splitlines():
        m = re.match(r"\s*([^,;]*)[,;](.*)", line)
        tag, words = (m[1].strip(), [w.strip() for w in m[2].split(",") if w.strip()]) if m else ("", [])
        if tag and words:
            at = order.setdefault(tag, len(order))
            for w in words:
                count[tag] = count.get(tag, -1) + 1
                out.append((at, tag, w, count[tag]))
    return out


def ontology_file(text: str) -> tuple[list[tuple[int, str, str, list[str]]], list[tuple[str, list[str]]]]:
    """Categories (ord, id, label, keywords) and synonyms (canonical, variants) of a YAML text."""
    import yaml

    root = yaml.safe_load(text) or {}
    if "ontology" not in root:
        raise ValueError("the key ontology is missing")
    cats = []
    for x in root["ontology"] or []:
        if isinstance(x, dict) and x.get("id"):
            if not isinstance(x.get("keywords", []), list):
                raise ValueError(f"keywords of {x['id']} are no list")
            cats.append((len(cats), str(x["id"]), str(x.get("label") or x["id"]), [str(k) for k in x.get("keywords", [])]))
    syn = [(str(s.get("canonical", "")).lower().strip(), [str(v).lower().strip() for v in s.get("variants") or [] if str(v).strip()]) for s in root.get("synonyms") or []]
    return cats, [s for s in syn if s[0] and s[1]]


def sites_file(text: str) -> list[dict]:
    """Sites with the defaults filled in; those without start URLs are skipped."""
    import yaml

    root = yaml.safe_load(text) or {}
    return [{**(root.get("defaults") or {}), **s} for s in root.get("sites") or [] if s.get("start_urls")]


def terms_file(text: str) -> list[str]:
    """One term a line, comments skipped, the first of each kept regardless of case."""
    seen: dict[str, str] = {}
    for line in text.lstrip("﻿").splitlines():
        if (t := line.strip()) and not t.startswith("#"):
            seen.setdefault(t.casefold(), t)
    return list(seen.values())


def journal(spark: SparkSession, path: str) -> DataFrame:
    """The state table, empty where there is none yet; one that can't be read is an error."""
    schema = "url string, status string, detail string"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def local_name(path: str) -> str:
    return Path(path).name


def html_markdown(html: str) -> str:
    """S24, the HTML part: headings, paragraphs, list items, links and emphasis as Markdown."""
    from html.parser import HTMLParser

    class Writer(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip, self.href = [], 0, None

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "head"):
                self.skip += 1
            elif re.fullmatch("h[1-6]", tag):
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("p", "div", "section", "article", "table", "tr", "ul", "ol"):
                self.out.append("\n\n")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag == "br":
                self.out.append("\n")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag == "a":
                self.href = dict(attrs).get("href")
                self.out.append("[" if self.href else "")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag == "a" and self.href:
                self.out.append(f"]({self.href})")
                self.href = None

        def handle_data(self, data):
            if not self.skip:
                self.out.append(re.sub(r"\s+", " ", data))

    w = Writer()
    w.feed(html)
    w.close()
    return re.sub("\n\n\n+", "\n\n", "".join(w.out)).strip()


def transcript(snippets) -> str:
    """The snippets' texts, trimmed, empty ones out, a line each."""
    return "\n".join(t for s in snippets if (t := (s or "").strip()))


#: Why a transcript is missing: kind of error -> exit code.
TRANSCRIPT_ERRORS = {"NoVideoId": 1, "TranscriptsDisabled": 2, "NoTranscriptFound": 3, "VideoUnavailable": 4, "EmptyTranscript": 5}


def transcripts(videos: DataFrame, fetch, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """(url, video, language, text, code): ``fetch(video, language)`` gives snippets; the first language that has some counts.

    ``code`` is 0, or that of the error's kind (6 for others).
    """
    from ..functions import text as tx

    rows = videos.select("url", tx.column(tx.video_id, "url").alias("video"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(video):
            if video is None:
                return None, None, TRANSCRIPT_ERRORS["NoVideoId"]
            code = TRANSCRIPT_ERRORS["EmptyTranscript"]
            for lang in languages:
                try:
                    if text := transcript(fetch(video, lang)):
                        return lang, text, 0
                except Exception as e:
                    code = TRANSCRIPT_ERRORS.get(type(e).__name__, 6)
            return None, None, code

        for pdf in batches:
            got = [one(v) for v in pdf["video"]]
            yield pdf.assign(language=[g[0] for g in got], text=[g[1] for g in got], code=[g[2] for g in got])

    return rows.mapInPandas(run, "url string, video string, language string, text string, code int")
