"""Documents of other formats to papers: JATS and TEI XML, landing pages, works in JSON, PDF checks.

XML goes through one Arrow function per format (the standard library's parser); JSON through
``from_json``; HTML links through regular expressions and a ranking. Malformed documents give null
fields, never an error. No network access is made; folders of downloaded files are the sources.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAPER_JSON = "paper_id string, source string, title string, authors array<struct<name:string,orcid:string,affiliation:string>>, year int, venue string, abstract string, sections map<string,struct<name:string,text:string>>, references array<struct<ref_id:string,raw_citation:string,doi:string,arxiv_id:string,pmc_id:string,title:string,year:int,resolved:boolean>>, open_access_url string, full_text_available boolean, ingested_at string, aliases array<string>"
_METHOD = ("method", "material", "experimental")
#: Elements that hold no running text; patterns of headings; words of preferred and of supplementary links.
_SKIP = {"fig", "table-wrap", "supplementary-material", "fig-group", "table"}
_METHOD_HEAD = re.compile(r"\b(method|materials?|experimental|sample preparation|data processing|image analysis)\b", re.I)
_METHOD_START = re.compile(r"^(online )?(materials? and )?methods?$", re.I)
_METHOD_STOP = re.compile(r"^(results?|discussion|conclusions?|references?|bibliography|extended data|acknowledg|author contributions?|competing interests?|data availability|additional information|supplementary)", re.I)
_BIBLIOGRAPHY = re.compile(r"^\d+\.\s+[A-Z][A-Za-z'-]+,\s+[A-Z]\.")
PREFERRED, SUPPLEMENT = ("pdf", "full", "article", "download", "fulltext"), ("supplement", "appendix", "suppl")


#: Papers that may be given to every task.
MOST_BUNDLED = 10_000


def paper_files(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of a folder of JSON files, a missing ingest time filled with now, with each file's path."""
    p = spark.read.schema(PAPER_JSON).option("multiLine", True).json(folder)
    return p.withColumn("ingested_at", F.coalesce(F.try_to_timestamp(F.nullif("ingested_at", F.lit(""))), F.current_timestamp())).withColumn("file", F.input_file_name())


def methods_text(sections: Column) -> Column:
    return F.coalesce(F.try_element_at(sections, F.lit("methods"))["text"], F.lit(""))


def find_paper(idents: DataFrame, papers: DataFrame) -> DataFrame:
    """(ident, paper_id, rule): bundled paper an identifier names: its id, id without scheme, alias, title, two shared words, author and year; the first rule, then the first file wins.

    The bundled papers are a small fixed set, given to every task; more than ``MOST_BUNDLED`` are an error.
    """
    from evigraph.functions.text import author_year, share_distinctive_token

    if papers.select("paper_id").limit(MOST_BUNDLED + 1).count() > MOST_BUNDLED:
        raise ValueError(f"more than {MOST_BUNDLED} bundled papers: match them by retrieve.best_paper or a keyed join")
    p = F.broadcast(papers.select("paper_id", "title", "aliases", "year", F.try_element_at("authors", F.lit(1))["name"].alias("author"), "file"))
    i, low = F.col("ident"), F.lower("ident")
    rule = (
        F.when(i == F.col("paper_id"), 0)
        .when(i == F.substring_index("paper_id", ":", -1), 1)
        .when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == low), 2)
        .when((low != "") & (F.contains(F.lower("title"), low) | F.contains(low, F.lower("title"))), 3)
        .when(share_distinctive_token(i, F.col("title")), 4)
        .when(author_year(i, F.col("author"), F.col("year")), 5)
    )
    j = idents.select("ident").distinct().join(p, rule.isNotNull()).withColumn("rule", rule)
    w = Window.partitionBy("ident").orderBy("rule", "file")
    return j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("ident", "paper_id", "rule")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ElementTree.Element, refs: str) -> str:
    """Text with bibliographic links as [id]; ``refs``: 'jats' or 'tei'."""
    out = [e.text or ""]
    for c in e:
        name = _local(c)
        if refs == "jats" and name == "xref" and c.get("ref-type") == "bibr":
            out.append(f"[{(c.get('rid') or '').split(' ')[0]}]")
        elif refs == "tei" and name == "ref" and c.get("type") == "bibr" and c.get("target"):
            out.append(f"[{c.get('target').lstrip('#')}]")
        elif name not in _SKIP:
            out.append(_text(c, refs))
        out.append(c.tail or "")
    return "".join(out)


def _squash(s: str) -> str:
    return " ".join(s.split())


def _find(e: ElementTree.Element, *path: str) -> list[ElementTree.Element]:
    level = [e]
    for name in path:
        level = [c for x in level for c in x.iter() if c is not x and _local(c) == name]
    return level


def parse_jats(xml: str) -> dict | None:
    """Title, authors, year, abstract, methods and references of an article."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    title = next((_squash(_text(t, "")) for t in _find(root, "article-title")), None)
    years = [y.text for y in _find(root, "pub-date", "year") if y.text and y.text.strip().isdigit()]
    authors = [_squash(f"{''.join(g.text or '' for g in _find(c, 'given-names'))} {''.join(s.text or '' for s in _find(c, 'surname'))}") for c in _find(root, "contrib") if c.get("contrib-type", "author") == "author"]
    out: list[str] = []

    def sections(e: ElementTree.Element, chosen: bool) -> None:
        for c in e:
            name = _local(c)
            if name in _SKIP:
                continue
            if name == "sec":
                head = next((_squash(_text(t, "")).lower() for t in c if _local(t) == "title"), "")
                sections(c, chosen or any(m in head for m in _METHOD))
            elif chosen and name in ("title", "p"):
                t = _squash(_text(c, "jats"))
                if t:
                    out.append(t)
            elif name not in ("ref-list", "back"):
                sections(c, chosen)

    for body in _find(root, "body"):
        sections(body, False)
    refs = [{"ref_id": r.get("id") or "", "raw_citation": _squash(_text(r, "")), "doi": next((p.text for p in _find(r, "pub-id") if p.get("pub-id-type") == "doi"), None)} for r in _find(root, "ref")]
    abstract = _squash(" ".join(_text(a, "") for a in _find(root, "abstract"))) or None
    return {"title": title, "year": int(years[0]) if years else None, "authors": authors, "abstract": abstract, "methods": "\n".join(out), "references": refs}


def parse_tei(xml: str) -> dict | None:
    """As ``parse_jats`` for TEI of processed PDFs.

    Methods: the division headed as methods with its own divisions, or the run of top-level divisions from that
    heading up to a heading of results and the like; else divisions whose heading has a method word; else all.
    """
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    title = next((_squash(_text(t, "")) for t in _find(root, "titleStmt", "title")), None)
    when = next((d.get("when") for d in _find(root, "date") if d.get("when")), "") or ""
    authors = [_squash(" ".join(x.text or "" for x in p.iter() if _local(x) in ("forename", "surname"))) for p in _find(root, "sourceDesc", "persName")]
    body = next(iter(_find(root, "body")), None)
    divs = [d for d in (body if body is not None else []) if _local(d) == "div"]

    def head(d: ElementTree.Element) -> str:
        return next((_squash(_text(h, "")) for h in d if _local(h) == "head"), "")

    start = next((i for i, d in enumerate(divs) if _METHOD_START.match(head(d))), None)
    if start is None:
        chosen: list[ElementTree.Element] = []
        inner: set[ElementTree.Element] = set()
        for d in _find(body, "div") if body is not None else []:
            if d not in inner and _METHOD_HEAD.search(head(d)):
                chosen.append(d)
                inner.update(_find(d, "div"))
        chosen = chosen or divs
    elif any(_local(c) == "div" for c in divs[start]):
        chosen = [divs[start]]
    else:
        stop = next((i for i in range(start + 1, len(divs)) if _METHOD_STOP.match(head(divs[i]))), len(divs))
        chosen = divs[start:stop]
    paras = [_squash(_text(p, "tei")) for d in chosen for p in d.iter() if _local(p) == "p"]
    paras = [p for p in paras if p and not _BIBLIOGRAPHY.match(p)]
    refs = [{"ref_id": b.get("{http://www.w3.org/XML/1998/namespace}id") or "", "raw_citation": _squash(" ".join(b.itertext())), "doi": next((i.text for i in _find(b, "idno") if (i.get("type") or "").lower() == "doi"), None)} for b in _find(root, "listBibl", "biblStruct")]
    return {"title": title, "year": int(when[:4]) if when[:4].isdigit() else None, "authors": [a for a in authors if a], "abstract": _squash(" ".join(_text(a, "") for a in _find(root, "abstract"))) or None, "methods": "\n".join(paras), "references": refs}


PARSED = "title string, year int, authors array<string>, abstract string, methods string, references array<struct<ref_id:string,raw_citation:string,doi:string>>"
_REFS = pa.list_(pa.struct([("ref_id", pa.string()), ("raw_citation", pa.string()), ("doi", pa.string())]))


def xml_papers(df: DataFrame, id_col: str, xml_col: str, kind: str) -> DataFrame:
    """(id, fields...) of XML documents; ``kind``: 'jats' or 'tei'. Malformed ones give nulls."""
    parse = {"jats": parse_jats, "tei": parse_tei}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(parse(x) if x else None) or {} for x in b.column(1).to_pylist()]
            kinds = {"title": pa.string(), "year": pa.int32(), "authors": pa.list_(pa.string()), "abstract": pa.string(), "methods": pa.string(), "references": _REFS}
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()]], names=[id_col, *kinds])

    t = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, xml_col).mapInArrow(run, f"`{id_col}` {t}, {PARSED}")


_OPENALEX = "struct<title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,referenced_works:array<string>,best_oa_location:struct<pdf_url:string>,primary_location:struct<pdf_url:string,source:struct<display_name:string>>,open_access:struct<oa_url:string>,authorships:array<struct<author:struct<display_name:string,orcid:string>>>>"
_CROSSREF = "struct<title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,reference:array<struct<key:string,unstructured:string,DOI:string>>>"


def rebuild_abstract(inverted: Column) -> Column:
    """Text of an inverted index {word: positions}; of two words at a place the greater stays."""
    flat = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    s = F.array_sort(flat)
    return F.array_join(F.transform(F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.try_element_at(s, i + 2)["p"] != x["p"])), lambda x: x["w"]), " ")


def openalex(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, title, year, venue, authors, abstract, open_access_url, reference ids) of works as OpenAlex gives them."""
    w = F.from_json(json_col, _OPENALEX)
    return df.select(id_col, w.alias("w")).select(
        id_col, "w.title", F.col("w.publication_year").alias("year"), F.col("w.primary_location.source.display_name").alias("venue"), F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        rebuild_abstract(F.col("w.abstract_inverted_index")).alias("abstract"), F.coalesce("w.best_oa_location.pdf_url", "w.primary_location.pdf_url", "w.open_access.oa_url").alias("open_access_url"),
        F.transform("w.referenced_works", lambda r, i: F.struct(F.concat(F.lit("ref_"), (i + 1).cast("string")).alias("ref_id"), r.alias("work"))).alias("references"),
    )


def crossref(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, title, year, venue, authors) of works as Crossref gives them."""
    w = F.from_json(json_col, _CROSSREF)
    return df.select(id_col, w.alias("w")).select(
        id_col, F.try_element_at("w.title", F.lit(1)).alias("title"), F.try_element_at(F.try_element_at(F.col("w.issued")["date-parts"], F.lit(1)), F.lit(1)).alias("year"), F.try_element_at(F.col("w")["container-title"], F.lit(1)).alias("venue"),
        F.transform("w.author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"),
    )


def pdf_links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, pdf_url): the PDF a landing page names in its meta tags, else its best link.

    A link scores 2 for a preferred word and -3 for a supplementary one in its text or class; the first of the best wins.
    """
    h = F.col(html_col)
    metas = F.regexp_extract_all(h, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    content = lambda m: F.regexp_extract(m, r"""(?is)\bcontent\s*=\s*["']([^"']+)["']""", 1)
    named = lambda n: F.filter(F.transform(F.filter(metas, lambda m: m.rlike(rf"""(?is)\bname\s*=\s*["']{n}["']""")), content), lambda c: c != "")
    meta = F.coalesce(F.try_element_at(named(r"citation_pdf_url"), F.lit(1)), F.try_element_at(named(r"eprints\.document_url"), F.lit(1)))
    links = F.regexp_extract_all(h, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))

    def scored(a: Column, i: Column) -> Column:
        href = F.regexp_extract(a, r"""(?is)\bhref\s*=\s*["']([^"']+)["']""", 1)
        seen = F.lower(F.concat(F.regexp_replace(a, r"(?s)<[^>]*>", " "), F.lit(" "), F.regexp_extract(a, r"""(?is)\bclass\s*=\s*["']([^"']+)["']""", 1)))
        score = F.when(seen.rlike("|".join(PREFERRED)), 2).otherwise(0) - F.when(seen.rlike("|".join(SUPPLEMENT)), 3).otherwise(0)
        return F.struct((-score).alias("neg"), i.alias("i"), href.alias("href"))

    good = F.filter(F.transform(links, scored), lambda x: F.lower(F.regexp_replace(x["href"], r"[?#].*$", "")).endswith(".pdf") & (x["neg"] < 1))
    best = F.try_element_at(F.array_sort(good), F.lit(1))["href"]
    raw = F.coalesce(meta, best)
    root = F.regexp_extract(F.col(url_col), r"^([a-z]+://[^/]+)", 1)
    base = F.regexp_replace(F.regexp_replace(F.col(url_col), r"[?#].*$", ""), r"[^/]*$", "")
    full = F.when(raw.rlike("^[a-z]+://"), raw).when(raw.startswith("//"), F.concat(F.regexp_extract(F.col(url_col), r"^([a-z]+:)", 1), raw)).when(raw.startswith("/"), F.concat(root, raw)).otherwise(F.concat(base, raw))
    return pages.select(id_col, full.alias("pdf_url")).filter("pdf_url is not null")


def pdf_files(spark: SparkSession, folder: str, most_bytes: int = 50_000_000) -> DataFrame:
    """(path, length, content) of files that are PDFs by their first bytes and not too long."""
    b = spark.read.format("binaryFile").load(folder)
    return b.filter((F.col("length") <= most_bytes) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).select("path", "length", "content")
