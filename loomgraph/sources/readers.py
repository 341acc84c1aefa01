"""Documents from files and feeds. Parsers of a format run in Arrow batches next to the bytes they read."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import strip

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scribbles(rows: DataFrame) -> DataFrame:
    """Notes (text, title), stripped; blank ones are refused."""
    return rows.withColumn("text", strip(F.col("text"))).where(F.length("text") > 0)


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs, then table rows with cells joined by ' | '."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    parts = [text(p) for p in body.findall(f"{W}p")]
    rows = [" | ".join(text(c).strip() for c in r.findall(f"{W}tc")) for t in body.findall(f"{W}tbl") for r in t.findall(f"{W}tr")]
    return "\n".join(x for x in parts + rows if x.strip())


MIME = {"md": "text/markdown", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf"}


def files(spark: SparkSession, path: str, pdf_pages=None) -> DataFrame:
    """Files under a path: (source_uri, title, mime_type, text, error). Markdown and Word files are read here, and PDFs by
    ``pdf_pages`` (bytes to a list of page texts), which the caller passes. A file of another suffix, a damaged or blank one
    has a null text and says why."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = raw.select(F.col("path").alias("source_uri"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("title"), suffix.alias("suffix"), "content")

    @F.pandas_udf("string")
    def word(data: pd.Series) -> pd.Series:
        def one(b):
            try:
                return docx_text(b)
            except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError):
                return None

        return data.map(one)

    @F.pandas_udf("array<string>")
    def pages(data: pd.Series) -> pd.Series:
        return data.map(lambda b: list(pdf_pages(b)))

    of = lambda name: rows.where(F.col("suffix") == name)
    shape = lambda df, text: df.select("source_uri", "title", "suffix", text.alias("text"))
    out = shape(of("md"), F.decode("content", "UTF-8")).unionByName(shape(of("docx"), word("content")))
    if pdf_pages is not None:
        read = of("pdf").select("source_uri", "title", "suffix", pages("content").alias("pages"))
        clean = page_texts(read.select(F.col("source_uri").alias("id"), "pages")).withColumnRenamed("id", "source_uri")
        out = out.unionByName(read.drop("pages").join(clean, "source_uri", "left").select("source_uri", "title", "suffix", "text"))
    known = ["md", "docx"] + (["pdf"] if pdf_pages is not None else [])
    out = out.unionByName(shape(rows.where(~F.col("suffix").isin(known)), F.lit(None).cast("string")))
    text = F.nullif(strip(F.col("text")), F.lit(""))
    why = F.when(~F.col("suffix").isin(known), F.concat(F.lit("unsupported suffix: "), "suffix")).when(F.col("text").isNull(), "damaged").when(text.isNull(), "blank")
    kind = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[F.col("suffix")]
    return out.select("source_uri", "title", kind.alias("mime_type"), text.alias("text"), why.alias("error"))


FEED = """struct<channel:struct<item:array<struct<title:string,description:string,link:string,pubDate:string>>>,
  entry:array<struct<title:string,summary:string,content:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string>>>"""


def feed_items(bodies: DataFrame) -> DataFrame:
    """bodies (feed_url, xml) of RSS or Atom feeds to (feed_url, title, text, source_uri, published): the text of the summary,
    or of the title without one; the feed's address where an item has none; blank items go. A body that isn't XML has none."""
    x = F.from_xml("xml", FEED, {"mode": "PERMISSIVE"})
    rss = F.transform(F.col("x.channel.item"), lambda i: F.struct(i["title"].alias("title"), i["description"].alias("summary"), i["link"].alias("link"), i["pubDate"].alias("published")))
    href = lambda e: F.coalesce(F.get(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
    atom = F.transform(F.col("x.entry"), lambda e: F.struct(e["title"].alias("title"), F.coalesce(e["summary"], e["content"]).alias("summary"), href(e).alias("link"), F.coalesce(e["published"], e["updated"]).alias("published")))
    none = F.array().cast("array<struct<title:string,summary:string,link:string,published:string>>")
    rows = bodies.select("feed_url", x.alias("x")).select("feed_url", F.explode(F.concat(F.coalesce(rss, none), F.coalesce(atom, none))).alias("i"))
    text = X.strip_html(F.coalesce(F.nullif(F.trim("i.summary"), F.lit("")), "i.title"))
    return rows.select("feed_url", "i.title", text.alias("text"), F.coalesce("i.link", "feed_url").alias("source_uri"), "i.published").where("text <> ''")


def scraped(pages: DataFrame) -> DataFrame:
    """(url, title, text) of web pages; challenge pages and blank ones are left out."""
    good = pages.where(~X.is_challenge_page(F.col("html")))
    return good.select("url", X.html_title(F.col("html")).alias("title"), X.strip_html(F.col("html")).alias("text")).where("text <> ''")


#: Elements whose content is no article text, and tags that end a line of it.
ASIDE = ("script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "figure")
BREAKS = r"(?i)</?(?:p|div|article|main|section|h[1-6]|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|pre|blockquote|br|hr|body|html|head|title)\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def article(html: Column) -> Column:
    """(title, author, date, text) of a web page: comments and what isn't content go, the article or main element is taken if
    there is one, and of its lines those that aren't mostly links. Null text if nothing is left."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    meta = lambda name: F.nullif(F.trim(F.regexp_extract(c, rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]*?content=[\"']([^\"']*)[\"']", 1)), F.lit(""))
    bare = c
    for tag in ASIDE:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    inner = [F.nullif(F.regexp_extract(bare, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit("")) for tag in ("article", "main", "body")]
    words = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    plain = lambda x: words(F.regexp_replace(x, r"(?is)<a\b[^>]*>.*?</a\s*>", " "))
    parts = F.filter(F.split(F.coalesce(*inner, bare), BREAKS), lambda x: (words(x) != "") & (2 * F.length(plain(x)) >= F.length(words(x))))

    def decoded(t: Column) -> Column:
        for mark, char in ENTITIES:
            t = F.replace(t, F.lit(mark), F.lit(char))
        return t

    title = F.coalesce(meta("og:title"), F.nullif(X.html_title(c), F.lit("")), F.nullif(words(F.regexp_extract(c, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)), F.lit("")))
    return F.struct(decoded(title).alias("title"), meta("author").alias("author"), meta("article:published_time").alias("date"), F.nullif(decoded(F.array_join(F.transform(parts, words), "\n")), F.lit("")).alias("text"))


def reader_page(text: Column, least: int = 50) -> Column:
    """(title, text) of what a reader service returns; null below ``least`` characters. A first line '# ...' or 'Title: ...'
    is the title."""
    t = strip(text)
    head = F.regexp_extract(t, r"^(?:# |Title: )([^\n]*)", 1)
    return F.when(F.length(t) >= least, F.struct(F.when(t.rlike("^(?:# |Title: )"), F.trim(head)).alias("title"), t.alias("text")))


def transcripts(lines: DataFrame) -> DataFrame:
    """(video, text) from caption lines (video, place, text); videos without a spoken word are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("place", F.trim("text").alias("text"))))
    said = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")
    return lines.groupBy("video").agg(F.array_join(said, " ").alias("text")).where("text <> ''")


def captions(tracks: DataFrame) -> DataFrame:
    """tracks (video, xml) to caption lines (video, place, text) for transcripts."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<text\b[^>]*>(.*?)</text>"), F.lit(1))
    text = F.col("text")
    for mark, char in ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(char))
    return tracks.select("video", F.posexplode(found).alias("place", "text")).select("video", "place", F.regexp_replace(text, r"\s+", " ").alias("text"))


#: Fixed patterns of a printed page: its number, a line with a form of its own, the end of a sentence, and what follows a
#: paper's text.
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?$"
OWN_FORM = r"(?i)^(?:[-*+•]\s+|\d+[.)]\s+|\d+(?:\.\d+)+\s+|(?:figure|table)\s+\d+[.:]?\s+|(?:abstract|keywords?)\b|(?:references|bibliography|appendix|acknowledg(?:e)?ments?)\b|\[\d+\]|doi:)"
CLOSED = "[.!?][\"”’)\\]]?$"
BACKMATTER = r"(?i)^(?:references|bibliography|appendix(?:\b|[\s:.-])|appendices(?:\b|[\s:.-])|acknowledg(?:e)?ments?)"


#: From so many paragraphs on a text may have matter at its back, beyond so many and so large a part; fixed values.
MANY_BLOCKS, FRONT_BLOCKS, FRONT_PART = 24, 8, 0.35


def page_texts(pages: DataFrame) -> DataFrame:
    """PDF pages (id, pages array<string>) to (id, text).

    Of three pages or more, lines that repeat (but for numbers) among the first two and last two of at least max(3, half) of
    the pages go, as do page numbers. Lines of a page flow together into paragraphs, hyphens at their ends joined, up to the
    end of a sentence or a line of a form of its own. From 24 paragraphs on, what follows a heading like References beyond
    the eighth and the first 35 per cent is left out. Documents without text are left out."""
    lines_of = F.filter(F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    split = pages.select("id", F.size("pages").alias("n"), F.posexplode("pages").alias("page", "text")).select("id", "n", "page", lines_of.alias("ls"))
    key = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"\bpage\s+\d+(?:\s+of\s+\d+)?\b", " "), r"\b\d+\b", " "), r"\s+", " "))
    probable = F.filter("ls", lambda x: (F.length(x) <= 160) & (x.rlike(PAGE_NUMBER) | (key(x) != "")))
    edge = F.array_distinct(F.filter(F.transform(F.concat(F.slice(probable, 1, 2), F.slice(F.reverse(probable), 1, 2)), key), lambda k: k != ""))
    margins = split.where("n >= 3").select("id", "n", F.explode(edge).alias("k")).groupBy("id", "n", "k").agg(F.count(F.lit(1)).alias("c"))
    margins = margins.where(F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2))).groupBy("id").agg(F.collect_set("k").alias("margins"))
    both = split.join(margins, "id", "left").withColumn("margins", F.coalesce("margins", F.array().cast("array<string>")))
    kept = F.filter("ls", lambda x: ~F.array_contains("margins", key(x)) & ~x.rlike(PAGE_NUMBER))
    own = lambda x: x.rlike(OWN_FORM) | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) <= 120))

    def flow(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        hyphen = F.endswith(last, F.lit("-")) & x.rlike(r"^\p{Ll}")
        return (
            F.when(F.size(acc) == 0, F.array(x))
            .when(hyphen, F.concat(rest, F.array(F.concat(F.substr(last, F.lit(1), F.length(last) - 1), x))))
            .when(own(last) | own(x) | last.rlike(CLOSED), F.concat(acc, F.array(x)))
            .otherwise(F.concat(rest, F.array(F.concat_ws(" ", last, x))))
        )

    flowed = both.select("id", "page", F.aggregate(kept, F.array().cast("array<string>"), flow).alias("blocks"))
    joined = flowed.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "blocks"))), lambda r: r["blocks"])).alias("blocks"))
    floor = F.greatest(F.lit(FRONT_BLOCKS), F.floor(F.size("blocks") * FRONT_PART).cast("int"))
    ends = F.array_min(F.filter(F.transform("blocks", lambda x, i: F.when((i >= floor) & x.rlike(BACKMATTER), i)), lambda i: i.isNotNull()))
    size = F.when(F.size("blocks") >= MANY_BLOCKS, F.coalesce(ends, F.size("blocks"))).otherwise(F.size("blocks"))
    return joined.select("id", F.array_join(F.slice("blocks", F.lit(1), size), "\n\n").alias("text")).where("text <> ''")


def cases(spark: SparkSession, path: str, chosen: str = "full") -> DataFrame:
    """Evaluation cases from JSON lines; 'smoke' are those marked so, 'full' are all."""
    rows = spark.read.json(path)
    return rows.where(F.col("set") == "smoke") if chosen == "smoke" else rows
