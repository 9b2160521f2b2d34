"""Queries that write papers in other formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import ids, text
from evigraph.plans.text import PAPERS_SQL, WS, papers
from evigraph.sources import parsers, read_table

_BAD_XML = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{fffe}\x{ffff}]"


def _xml(c) -> F.Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), _BAD_XML, " ")
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _squash_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '{_BAD_XML}', ' ', 'g'), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def abstract_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts through their inverted index and back."""
    p = papers(spark, d, "abstract").filter("abstract is not null")
    w = p.select("paper_id", F.posexplode(F.split("abstract", " ")).alias("pos", "word"))
    inv = w.groupBy("paper_id", "word").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    m = inv.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("inverted"))
    return m.select("paper_id", parsers.rebuild_abstract(F.col("inverted")).alias("abstract"))


def openalex_works(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "title", "pub_year", "venue", "abstract", "open_access_url")
    j = F.to_json(
        F.struct(
            "title", F.col("pub_year").alias("publication_year"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source"), F.lit(None).cast("string").alias("pdf_url")).alias("primary_location"),
            F.struct(F.col("open_access_url").alias("oa_url")).alias("open_access"), F.array(F.lit("W1"), F.col("paper_id")).alias("referenced_works"),
        )
    )
    o = parsers.openalex(p.select("paper_id", j.alias("j")), "paper_id", "j")
    return o.select("paper_id", "title", "year", "venue", "open_access_url", F.array_join(F.transform("references", lambda r: F.concat(r["ref_id"], F.lit("="), r["work"])), ";").alias("refs"))


def crossref_works(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "title", "pub_year", "venue")
    j = F.to_json(F.struct(F.array("title").alias("title"), F.struct(F.array(F.array("pub_year")).alias("date-parts")).alias("issued"), F.array("venue").alias("container-title")))
    return parsers.crossref(p.select("paper_id", j.alias("j")), "paper_id", "j").select("paper_id", "title", "year", "venue")


def _lines(f) -> F.Column:
    """Each line of the methods text as an element."""
    return F.array_join(F.transform(F.split(F.coalesce("methods_text", F.lit("")), text.LINE_END), f), "")


def jats_papers(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a methods section, a figure and a results section; only the methods come back."""
    p = papers(spark, d, "title", "pub_year", "methods_text")
    x = F.concat(
        F.lit("<article><front><article-meta><title-group><article-title>"), _xml(F.col("title")), F.lit("</article-title></title-group><pub-date><year>"), F.coalesce(F.col("pub_year").cast("string"), F.lit("")),
        F.lit("</year></pub-date></article-meta></front><body><sec><title>Results</title><p>none</p></sec><sec><title>Materials and Methods</title><fig><p>a figure</p></fig>"),
        _lines(lambda l: F.concat(F.lit("<p>"), _xml(l), F.lit("</p>"))), F.lit("</sec></body></article>"),
    )
    o = parsers.xml_papers(p.select("paper_id", x.alias("x")), "paper_id", "x", "jats")
    return o.select("paper_id", "title", "year", F.md5("methods").alias("methods_md5"))


def tei_papers(spark: SparkSession, d: str) -> DataFrame:
    """Processed PDFs whose methods run from their heading to the results."""
    p = papers(spark, d, "title", "methods_text")
    x = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), _xml(F.col("title")), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body><div><head>Introduction</head><p>none</p></div><div><head>Methods</head>"),
        _lines(lambda l: F.concat(F.lit("<p>"), _xml(l), F.lit("</p>"))), F.lit("</div><div><head>Results</head><p>none</p></div></body></text></TEI>"),
    )
    o = parsers.xml_papers(p.select("paper_id", x.alias("x")), "paper_id", "x", "tei")
    return o.select("paper_id", "title", F.md5("methods").alias("methods_md5"))


_METHODS_MD5 = rf"md5(array_to_string(list_filter(list_transform(string_split_regex(coalesce(methods_text, ''), '{text.LINE_END}'), lambda l: {_squash_sql('l')}), lambda l: l <> ''), chr(10)))"


def landing_pages(spark: SparkSession, d: str) -> DataFrame:
    """The PDF of each paper's landing page: from its meta tag where the paper has no venue, else by its links."""
    p = papers(spark, d, "venue")
    slug = F.sha1("paper_id")
    meta = F.when(F.col("venue").isNull(), F.concat(F.lit('<meta name="citation_pdf_url" content="/m/'), slug, F.lit('.pdf">'))).otherwise("")
    html = F.concat(F.lit("<html><head>"), meta, F.lit('</head><body><a href="s.pdf">Supplementary PDF</a><a href="plain.pdf">x</a><a class="btn" href="a/'), slug, F.lit('.pdf?v=1">Full article</a><a href="b.pdf">Download</a></body></html>'))
    return parsers.pdf_links(p.select("paper_id", F.lit("https://host.example.org/dir/page.html").alias("url"), html.alias("html")), "paper_id", "url", "html")


def url_check(spark: SparkSession, d: str) -> DataFrame:
    """Which open-access addresses may be fetched."""
    p = papers(spark, d, "open_access_url").filter("open_access_url is not null")
    return p.select("paper_id", ids.acceptable_url(F.col("open_access_url")).alias("acceptable"))


def print_folding(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "paper_refs").dropDuplicates(["ref_row_id"])
    return r.select("ref_row_id", text.fold_print(F.col("raw_citation")).alias("printed"))


FOLD_SQL = "SELECT DISTINCT ref_row_id, replace(replace(replace(replace(replace(translate(raw_citation, 'µμ×−–—‘’“”', 'uux---' || chr(39) || chr(39) || chr(34) || chr(34)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS printed FROM paper_refs"


def queries() -> dict:
    return {f.__name__: f for f in (abstract_rebuild, openalex_works, crossref_works, jats_papers, tei_papers, landing_pages, url_check, print_folding)}


def oracle_sql() -> dict:
    return {
        "abstract_rebuild": f"SELECT paper_id, abstract FROM ({PAPERS_SQL}) WHERE abstract IS NOT NULL",
        "openalex_works": f"SELECT paper_id, title, pub_year AS year, venue, open_access_url, 'ref_1=W1;ref_2=' || paper_id AS refs FROM ({PAPERS_SQL})",
        "crossref_works": f"SELECT paper_id, title, pub_year AS year, venue FROM ({PAPERS_SQL})",
        "jats_papers": f"SELECT paper_id, {_squash_sql('title')} AS title, pub_year AS year, {_METHODS_MD5} AS methods_md5 FROM ({PAPERS_SQL})".replace("md5(array", "md5('Materials and Methods' || CASE WHEN len(list_filter(list_transform(string_split_regex(coalesce(methods_text, ''), '" + text.LINE_END + "'), lambda l: " + _squash_sql("l") + "), lambda l: l <> '')) > 0 THEN chr(10) ELSE '' END || array"),
        "tei_papers": f"SELECT paper_id, {_squash_sql('title')} AS title, {_METHODS_MD5} AS methods_md5 FROM ({PAPERS_SQL})",
        "landing_pages": f"SELECT paper_id, CASE WHEN venue IS NULL THEN 'https://host.example.org/m/' || sha1(paper_id) || '.pdf' ELSE 'https://host.example.org/dir/a/' || sha1(paper_id) || '.pdf?v=1' END AS pdf_url FROM ({PAPERS_SQL})",
        "url_check": f"SELECT paper_id, regexp_matches(open_access_url, '^https?://[^/@]+(/|$)') AND NOT regexp_matches(open_access_url, '^https?://(localhost|10\\.|127\\.|192\\.168\\.)') AS acceptable FROM ({PAPERS_SQL}) WHERE open_access_url IS NOT NULL",
        "print_folding": FOLD_SQL,
    }
