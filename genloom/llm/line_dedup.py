"""Line dedup by site-relative frequency.

A page's HTML becomes lines: scripts, styles and comments go, block tags break lines, other tags vanish. For each host the
pages that contain a line, divided by the host's pages, is the line's ratio; lines above RATIO (and on LEAST pages or more)
are boilerplate and are dropped from all pages of the host.

A page names each of its lines once, so counting is an aggregate with map-side combine and a hot host or line is a few rows
a task. A host has at most (lines a page / RATIO) lines above the ratio, so they make a short array that joins by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genloom.runtime import materialize, scratch, small_or_not, table

RATIO, LEAST = 0.3, 3
#: Tags that end a line; a fixed list.
BLOCK = "p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|body|html|head|main|aside|pre|blockquote"
_STEPS = [
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (rf"(?i)</?({BLOCK})[^>]*>", "\n"),
    (r"<[^>]+>", ""),
    (r"[\x20\t\r\f\x0B]+", " "),
    (r" ?\n[ \n]*", "\n"),
]


def html_lines(html: Column) -> Column:
    """The non-empty lines of an HTML column, white space collapsed."""
    for pattern, new in _STEPS:
        html = F.regexp_replace(html, pattern, new)
    return F.filter(F.transform(F.split(html, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def drop_boilerplate(pages: DataFrame, id_col: str, host: Column, lines: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(page_id, host, lines, kept_lines) for every row of pages; both are arrays in page order.

    A null array counts as no lines, a null host as the host ''. Repeated rows are pages of their own. Within a page a line
    may occur many times but counts once; it goes or stays in all places. An empty table gives no rows; other columns are
    not read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    with scratch(pages.sparkSession) as made:
        base = materialize(base.withColumn("hashes", F.transform("lines", lambda x: F.md5(x.cast("binary")))), "page-lines")
        on = base.select("host", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        total = small_or_not(materialize(base.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host-pages"))
        common = on.join(total, "host").filter(F.col("n") > F.col("pages") * F.lit(ratio)).groupBy("host").agg(F.collect_set("h").alias("common"))
        common = materialize(common, "boilerplate")
        made.keep(base, common)
    out = base.join(small_or_not(common), "host", "left")
    # the page's lines meet the host's set by hash, once; only those found are looked up line by line
    keep = F.expr("transform(array(array_intersect(hashes, common)), hot -> transform(filter(arrays_zip(lines, hashes), x -> NOT array_contains(hot, x.hashes)), x -> x.lines))[0]")
    return out.select("page_id", "host", "lines", F.when(F.col("common").isNull(), F.col("lines")).otherwise(keep).alias("kept_lines"))


def op9_line_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = drop_boilerplate(pages, "page_id", host_of(F.col("url")), html_lines(F.coalesce("html", F.lit(""))))
    text = F.array_join("kept_lines", "\n")
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def _sql() -> str:
    html = "coalesce(html, '')"
    for pattern, new in _STEPS:
        new = "chr(10)" if new == "\n" else f"'{new}'"
        html = f"regexp_replace({html}, '{pattern}', {new}, 'g')"
    return f"""
        WITH p AS (SELECT row_number() OVER () AS r, page_id,
                     lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, string_split({html}, chr(10)) AS a FROM pages),
        l AS (SELECT r, i, trim(a[i]) AS line, host FROM (SELECT r, host, a, unnest(range(1, len(a) + 1)) AS i FROM p) WHERE trim(a[i]) <> ''),
        c AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM l GROUP BY 1, 2)
              JOIN (SELECT host, count(*) AS pages FROM p GROUP BY 1) USING (host) WHERE n >= {LEAST} AND n > pages * {RATIO}),
        k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (c.line IS NOT NULL) AS n_dropped,
                string_agg(l.line, chr(10) ORDER BY i) FILTER (c.line IS NULL) AS t FROM l LEFT JOIN c USING (host, line) GROUP BY r)
        SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(t, '')) AS text_sha256
        FROM p LEFT JOIN k USING (r)
    """


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": _sql()}
