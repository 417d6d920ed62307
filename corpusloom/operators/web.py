"""Text and links of HTML pages by patterns, URL rules, and link graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let, strip
from corpusloom.operators.ordering import cut

#: Elements whose content is no text of the page.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe")
VISIBLE_DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
#: References that pages of this kind use.
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
SKIPPED = ("/search", "/feedback", "/calendar", "/terms", "/privacy-policy", "javascript:")


def decode_references(c: Column) -> Column:
    for name, char in REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


#: HTML's white space, and what ends a tag's name. Patterns of tags are the same in RE2: its (?i) folds Unicode letters, its \s and \b are of ASCII.
GAP = r"[\t\n\f\r ]"
NAME_END = r"(?![0-9A-Za-z_])"


def without_elements(html: Column, tags: tuple[str, ...] = DROPPED) -> Column:
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in tags:
        html = F.regexp_replace(html, rf"(?ius)<{tag}{NAME_END}[^>]*>.*?</{tag}{GAP}*>", "")
    return html


def plain(html: Column) -> Column:
    return F.regexp_replace(decode_references(F.regexp_replace(html, r"<[^>]*>", "")), rf"^{GAP}+|{GAP}+\z", "")


def outer_boxes(html: Column) -> Column:
    """The content of each div, section or main that is in no other one, with all that is in it.

    Their tags are told apart as opening and closing only; a box that never closes goes on to the
    end, and a closing tag without a box is nothing.
    """
    marked = F.regexp_replace(html, "[\\x01-\\x03]", "")
    marked = F.regexp_replace(marked, r"(?i)<(?:div|section|main)\b[^>]*>", "\x01\x02")
    marked = F.regexp_replace(marked, r"(?i)</(?:div|section|main)\s*>", "\x01\x03")

    def find(parts: Column) -> Column:
        """Each part but the first begins with a mark of its tag."""
        places = F.sequence(F.lit(1), F.size(parts))
        at = lambda i: F.get(parts, i - 1)
        none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("boxes"))

        def step(now: Column, i: Column) -> Column:
            opens, closes = at(i).startswith("\x02"), at(i).startswith("\x03")
            done = closes & (now["depth"] == 1)
            return F.struct(
                F.when(opens, now["depth"] + 1).when(closes, F.greatest(now["depth"] - 1, F.lit(0))).otherwise(now["depth"]).alias("depth"),
                F.when(opens & (now["depth"] == 0), i).otherwise(now["start"]).alias("start"),
                F.when(done, F.array_append(now["boxes"], F.struct(now["start"].alias("start"), (i - 1).alias("end")))).otherwise(now["boxes"]).alias("boxes"),
            )

        def finish(now: Column) -> Column:
            last = F.struct(now["start"].alias("start"), F.size(parts).alias("end"))
            return F.when(now["depth"] > 0, F.array_append(now["boxes"], last)).otherwise(now["boxes"])

        spans = F.aggregate(places, none, step, finish)
        return F.transform(spans, lambda b: F.translate(F.array_join(F.slice(parts, b["start"], b["end"] - b["start"] + 1), ""), "\x02\x03", ""))

    return let(F.split(marked, "\x01"), find)


def _paragraphs(clean: Column, least: int) -> Column:
    """Paragraphs of over `least` characters in the article; one ends at its closing tag or where the next one begins."""
    article = F.regexp_extract(clean, rf"(?ius)<article{NAME_END}[^>]*>(.*?)</article{GAP}*>", 1)
    found = F.regexp_extract_all(article, F.lit(rf"(?ius)<p{NAME_END}[^>]*>(.*?)(?=<p{NAME_END}[^>]*>|</p{GAP}*>|\z)"), F.lit(1))
    return F.filter(F.transform(found, plain), lambda p: F.length(p) > least)


def article_text(html: Column, least: int = 20) -> Column:
    """Paragraphs of over `least` characters in the article, a line each; null if there are none."""
    return let(_paragraphs(without_elements(html), least), lambda p: F.when(F.size(p) > 0, F.array_join(p, "\n")))


def fallback_text(html: Column, least: int = 20, container: int = 100) -> Column:
    """As article_text(), or else the longest div or section of at least `container`; null if neither.

    A box within another is never longer than that one, so only outer boxes are looked at.
    """
    clean = without_elements(html)

    def pick(h: Column) -> Column:
        paragraphs = _paragraphs(h, least)
        boxes = F.filter(F.transform(outer_boxes(h), plain), lambda p: F.length(p) >= container)
        longest = F.element_at(F.sort_array(F.transform(boxes, lambda b: F.struct(F.length(b).alias("n"), b.alias("b")))), -1)["b"]
        return F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, "\n")).when(F.size(boxes) > 0, longest)

    return let(clean, pick)


def visible_text(html: Column) -> Column:
    """The text of all elements but scripts, styles and page furniture, a line a tag, blank lines left out."""
    text = decode_references(F.regexp_replace(without_elements(html, VISIBLE_DROPPED), r"<[^>]*>", "\n"))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != ""), "\n")


def first_long_enough(html: Column, extractors: list[Callable[[Column], Column]], least: int = 100) -> Column:
    """What the first extractor gives whose text has `least` characters; if none has, what the last one gives."""
    found = [extract(html) for extract in extractors]
    return F.coalesce(*[F.when(F.length(text) >= least, text) for text in found[:-1]], found[-1])


def absolute(href: Column, base: Column) -> Column:
    """A link as seen from the page's address: absolute, of the scheme, of the root, or beside the page."""
    scheme, host = F.regexp_extract(base, r"^(https?):", 1), F.regexp_extract(base, r"^https?://([^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), host, href))
        .otherwise(F.concat(folder, href))
    )


def canonical_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1)


def page_links(pages: DataFrame, url: str, html: str, same_host: bool = True, https_only: bool = False) -> DataFrame:
    """(src, dst): the distinct canonical links of each page, to its own host only if asked for."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    raw = pages.select(canonical_url(F.col(url)).alias("src"), F.col(url).alias("__base"), F.explode(F.array_distinct(hrefs)).alias("href"))
    links = raw.select("src", canonical_url(absolute(strip(F.col("href")), F.col("__base"))).alias("dst")).where(F.col("dst").rlike("^https?://"))
    if same_host:
        links = links.where(url_host(F.col("src")) == url_host(F.col("dst")))
    if https_only:
        links = links.where(F.col("dst").startswith("https://"))
    return links.distinct()


def is_article(url: Column, pattern: str, skipped: tuple[str, ...] = SKIPPED, min_length: int = 0) -> Column:
    test = url.rlike(pattern) & (F.length(url) > min_length)
    for part in skipped:
        test &= ~F.contains(url, F.lit(part))
    return test


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, accepted: DataFrame | None = None, steps: int = 1000) -> DataFrame:
    """(url, depth): pages by breadth first from the seeds, each at its least depth.

    It goes on until no page is new, or up to max_depth links from the seeds if asked for; a graph
    that isn't done after `steps` is an error. With accepted (url), links go on from those pages
    only. The frontier, not the graph, is what each step moves on; steps are written to the
    checkpoint folder.
    """
    found = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        if depth > steps:
            raise RuntimeError(f"pages were still found after {steps} steps")
        sources = frontier if accepted is None else frontier.join(accepted.select("url").distinct(), "url", "left_semi")
        step = edges.join(sources.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = cut(step.join(found, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.limit(1).count() == 0:
            break
        found = found.unionByName(frontier)
    return found


def capped_crawl(reached: DataFrame, cap: int) -> DataFrame:
    """The first `cap` pages in order of depth, then URL."""
    return reached.orderBy("depth", "url").limit(cap)


def sitemap_urls(files: DataFrame, roots: DataFrame, max_depth: int = 5, drop: str = r"(?i)\.(jpe?g|png|gif|webp)$") -> DataFrame:
    """Page addresses of sitemaps (url, xml) reached from the roots by index entries; images are left out."""
    entries = files.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("dst"))
    entries = entries.withColumn("is_map", F.col("dst").rlike(r"(?i)\.xml(\.gz)?$"))
    maps = reachable(entries.where("is_map").select("src", "dst"), roots, max_depth)
    pages = entries.where(~F.col("is_map") & ~F.col("dst").rlike(drop))
    return pages.join(maps.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()


def page_numbers(links: DataFrame, patience: int = 5, cap: int = 2000) -> DataFrame:
    """Of (list_page, url) rows, those up to where a paginated list ends: the first page after `patience` without a new URL."""
    first = links.groupBy("url").agg(F.min("list_page").alias("list_page"))
    new = links.select("list_page").distinct().join(first.groupBy("list_page").agg(F.count(F.lit(1)).alias("n_new")), "list_page", "left")
    stop = new.where((F.col("list_page") > patience) & F.col("n_new").isNull()).agg(F.min("list_page").alias("stop"))
    return first.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("list_page") < F.col("stop"))).orderBy("list_page", "url").limit(cap).select("list_page", "url")


def is_open_access(restricted: Column, collections: Column) -> Column:
    """Whether an item may be taken: not restricted, in no lending collection."""
    lending = F.array(*map(F.lit, ("inlibrary", "printdisabled", "lendinglibrary")))
    return ~F.coalesce(F.lower(restricted.cast("string")) == "true", F.lit(False)) & ~F.coalesce(F.arrays_overlap(collections, lending), F.lit(False))


def preferred_files(files: DataFrame, item: str, name: str, most: int = 1) -> DataFrame:
    """The best files of each item: OCR text, then text PDF, then any PDF; of equals by name."""
    rank = F.when(F.col(name).endswith("djvu.txt"), 1).when(F.col(name).endswith("_text.pdf"), 2).when(F.col(name).endswith(".pdf"), 3)
    ranked = files.select(item, name, rank.alias("priority")).where("priority IS NOT NULL")
    if most == 1:  # combined before the shuffle
        return ranked.groupBy(item).agg(F.min(F.struct("priority", name)).alias("b")).select(item, "b.*")
    place = F.row_number().over(Window.partitionBy(item).orderBy("priority", name))
    return ranked.withColumn("__place", place).where(F.col("__place") <= most).select(item, "priority", name)


def id_chunks(spark: SparkSession, low: int, high: int, chunk: int) -> DataFrame:
    """(chunk_no, first_id, last_id): ranges of ids from low to high, both of them, in chunks."""
    n = max(0, -(-(high - low + 1) // chunk))
    return spark.range(n).select(F.col("id").alias("chunk_no"), (F.lit(low) + F.col("id") * chunk).alias("first_id"), F.least(F.lit(low) + (F.col("id") + 1) * chunk - 1, F.lit(high)).alias("last_id"))


def id_scan(found: DataFrame, key: str, low: int, high: int, chunk: int) -> DataFrame:
    """(chunk_no, first_id, last_id, n_found) of a scan of an id range: how many ids of each chunk there are; nothing is written for chunks without any."""
    chunks = id_chunks(found.sparkSession, low, high, chunk)
    at = F.floor((F.col(key) - low) / chunk)
    hits = found.where((F.col(key) >= low) & (F.col(key) <= high)).select(key).distinct().groupBy(at.alias("chunk_no")).agg(F.count(F.lit(1)).alias("n_found"))
    return chunks.join(hits, "chunk_no", "left").select("chunk_no", "first_id", "last_id", F.coalesce("n_found", F.lit(0)).alias("n_found"))
