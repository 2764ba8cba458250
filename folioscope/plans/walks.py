"""Queries of names, walks over links, rules of access and amendment events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, frontier, names, robots, temporal
from ..session import table
from .register import query

# --- names ---------------------------------------------------------------------------------

#: Names are the names of parts and customers, and the first words of the benchmark's texts, which documents quote. Both engines read this text.
_NAMES = """SELECT DISTINCT name FROM (
  SELECT lower(p_name) AS name FROM part UNION ALL SELECT lower(c_name) FROM customer
  UNION ALL SELECT lower(split_part(text, ' ', 2)) FROM benchmark UNION ALL SELECT concat(lower(split_part(text, ' ', 3)), ' ', lower(split_part(text, ' ', 4))) FROM benchmark
  UNION ALL SELECT concat(lower(split_part(text, ' ', 1)), ' ', lower(split_part(text, ' ', 2)), ' ', lower(split_part(text, ' ', 3))) FROM benchmark
) n WHERE trim(name) <> ''"""


def _sql(spark: SparkSession, sf: str, text: str, *names_of_tables: str) -> DataFrame:
    """``text`` over the tables it names."""
    for name in names_of_tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: table(spark, sf, name) for name in names_of_tables})


@query("name_scan", f"""
WITH RECURSIVE n AS (SELECT name, regexp_extract(name, '^(?:[\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-])') AS word FROM ({_NAMES})),
t AS (SELECT 'd' || doc_id AS key, lower(text) AS text FROM documents UNION ALL SELECT 'p' || page_id, lower(html) FROM pages),
w AS (SELECT key, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-]')) AS word, unnest(range(0, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-]')))) AS i FROM t),
b AS (SELECT key, word, CAST(sum(length(word)) OVER (PARTITION BY key ORDER BY i) AS BIGINT) - length(word) AS start FROM w),
c AS (SELECT b.key, start, max(length(name)) + start AS end_, max_by(name, length(name)) AS name FROM b JOIN n USING (word) JOIN t USING (key)
  WHERE substr(text, start + 1, length(name)) = name AND NOT regexp_matches(substr(text, start + length(name) + 1, 1), '[\\p{{L}}\\p{{N}}_-]')
    AND (start = 0 OR NOT regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}_-]')) GROUP BY b.key, start),
r AS (SELECT key, min(start) AS start, arg_min(end_, start) AS end_, arg_min(name, start) AS name FROM c GROUP BY key
  UNION ALL SELECT c.key, min(c.start), arg_min(c.end_, c.start), arg_min(c.name, c.start) FROM r JOIN c ON c.key = r.key AND c.start >= r.end_ GROUP BY c.key)
SELECT key, start, end_ AS "end", name FROM r
""")
def name_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("html").alias("text"))
    return names.scan(docs.unionByName(pages), _sql(spark, sf, _NAMES, "part", "customer", "benchmark"))


@query("name_citations", """
WITH acts AS (SELECT 'act' || p_partkey AS slug, p_size >= 12 AS current, p_name || ' nr ' || (p_partkey % 60) AS title, 'b' || (p_partkey // 2) || 'loven' AS short FROM part),
k AS (SELECT slug AS key, slug, current FROM acts UNION SELECT title, slug, current FROM acts UNION SELECT short, slug, current FROM acts),
i AS (SELECT key, count(*) FILTER (current) AS n, min(slug) FILTER (current) AS slug, CASE WHEN min(slug) = max(slug) THEN min(slug) END AS gone FROM k GROUP BY key),
s AS (SELECT 'act' || l_partkey AS slug, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS section_id, count(*) AS n, min(l_returnflag) AS heading FROM lineitem GROUP BY 1, 2),
r AS (SELECT o_orderkey AS key, CAST(o_orderkey // 4 % 50 AS VARCHAR) AS section, CASE o_orderkey // 4 % 5 WHEN 0 THEN 'act' || o_custkey WHEN 1 THEN 'b' || (o_custkey // 2) || 'loven'
  WHEN 2 THEN 'small ring nr ' || (o_custkey % 60) WHEN 3 THEN 'nowhere' || o_custkey END AS name FROM orders),
m AS (SELECT r.key, r.section, r.name, i.n, i.slug, i.gone, s.n AS there, s.heading FROM r LEFT JOIN i ON i.key = r.name LEFT JOIN s ON s.slug = i.slug AND s.section_id = r.section AND i.n = 1),
v AS (SELECT *, CASE WHEN name IS NULL THEN 'missing-act' WHEN n IS NULL THEN 'unknown-act' WHEN n = 0 THEN 'repealed-act' WHEN n > 1 THEN 'ambiguous-act' WHEN there IS NULL THEN 'nonexistent-section'
  WHEN there > 1 THEN 'ambiguous-occurrence' ELSE 'valid' END AS status FROM m)
SELECT key, status, CASE WHEN status = 'repealed-act' THEN gone WHEN status IN ('valid', 'nonexistent-section', 'ambiguous-occurrence') THEN slug END AS slug,
  CASE WHEN status IN ('valid', 'nonexistent-section', 'ambiguous-occurrence') THEN section END AS section_id, CASE WHEN status = 'valid' THEN heading END AS heading FROM v
""")
def name_citations(spark: SparkSession, sf: str) -> DataFrame:
    part, orders, items = (table(spark, sf, t) for t in ("part", "orders", "lineitem"))
    slug = F.concat(F.lit("act"), "p_partkey")
    short = F.concat(F.lit("b"), F.floor(F.col("p_partkey") / 2), F.lit("loven"))
    title = F.concat("p_name", F.lit(" NR "), F.col("p_partkey") % 60)
    acts = part.select(slug.alias("slug"), F.when(F.col("p_size") >= 12, "current").otherwise("removed").alias("status"), title.alias("title"), short.alias("short"))
    # one row names an act by its title, one by what its title holds in brackets
    whole = acts.select("slug", "status", "title").unionByName(acts.select("slug", "status", F.concat(F.lit("x "), "slug", F.lit(" ("), "short", F.lit(")")).alias("title")))
    form = F.floor(F.col("o_orderkey") / 4)
    name = (
        F.when(form % 5 == 0, F.concat(F.lit("ACT"), "o_custkey")).when(form % 5 == 1, F.concat(F.lit(" B"), F.floor(F.col("o_custkey") / 2), F.lit("Loven ")))
        .when(form % 5 == 2, F.concat(F.lit("Small  ring nr "), F.col("o_custkey") % 60)).when(form % 5 == 3, F.concat(F.lit("nowhere"), "o_custkey"))
    )
    requests = orders.select(F.col("o_orderkey").alias("key"), name.alias("name"), (form % 50).alias("section"))
    held = items.select(F.concat(F.lit("act"), "l_partkey").alias("slug"), F.col("l_quantity").cast("long").cast("string").alias("section_id"), F.col("l_returnflag").alias("heading"))
    return names.resolved(requests, names.index(whole), acts.where("status = 'current'").select("slug"), held)


# --- walks over links ------------------------------------------------------------------------

#: A page is addressed by its host and its first link's path; a path means the page of the least id that has it first. Both engines read these texts.
_ADDRESS = "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1) AS hrefs FROM pages"
_SOURCES, _DEPTH, _DOCUMENTS = ("example.com", "example.net"), 3, 60


def _walk_sql() -> str:
    out = f"""
WITH a AS ({_ADDRESS}), o AS (SELECT hrefs[1] AS path, min(page_id) AS page_id FROM a WHERE len(hrefs) > 0 GROUP BY 1),
u AS (SELECT a.page_id, a.site || o.path AS url, o.path, hrefs, site FROM a JOIN o USING (page_id)),
l AS (SELECT u.url, k.i AS place, coalesce(t.url, 'ftp://nowhere' || u.hrefs[k.i]) AS target FROM u, (SELECT unnest(range(1, 20)) AS i) k LEFT JOIN u t ON t.path = u.hrefs[k.i] WHERE k.i <= len(u.hrefs)),
e AS (SELECT site || '/start' AS target, 2 * min(page_id) AS place FROM a GROUP BY 1 UNION ALL SELECT min_by(u.url, page_id), 2 * min(page_id) + 1 FROM u GROUP BY site),
x AS (SELECT target, CASE WHEN NOT regexp_matches(target, '^https?:') THEN 'unsupported_scheme' WHEN NOT regexp_matches(target, '^[a-z]+://([^/]*[.])?example[.](com|net)/') THEN 'off_source_host' END AS reason
  FROM (SELECT target FROM l UNION SELECT target FROM e)),
n0 AS (SELECT target, CAST(NULL AS VARCHAR) AS found_in, 0 AS turn, place, reason FROM e JOIN x USING (target))"""
    parts, seen, read, turns = [], [], "0", "0"
    for d in range(_DEPTH + 1):
        earlier = " UNION ALL ".join(f"SELECT url FROM q{k}" for k in range(d)) or "SELECT NULL AS url WHERE false"
        out += f""",
s{d} AS (SELECT *, reason IS NULL AND target NOT IN ({earlier}) AND row_number() OVER (PARTITION BY target, reason IS NULL ORDER BY turn, place) = 1 AS fresh FROM n{d}),
p{d} AS (SELECT target AS url, found_in, {turns} + row_number() OVER (ORDER BY turn, place) - 1 AS turn, s.target IN (SELECT url FROM u) AS can,
  {read} + coalesce(count(*) FILTER (s.target IN (SELECT url FROM u)) OVER (ORDER BY turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s{d} s WHERE fresh),
q{d} AS (SELECT url, found_in, {d} AS depth, turn, CASE WHEN before >= {_DOCUMENTS} THEN 'document_budget_exhausted' WHEN can THEN 'read' ELSE 'fetch_failed' END AS outcome FROM p{d}),
n{d + 1} AS (SELECT target, l.url AS found_in, turn, place, reason FROM l JOIN q{d} q ON q.url = l.url AND outcome = 'read' JOIN x USING (target))"""
        parts += [f"SELECT * FROM q{d}", f"SELECT target, found_in, {d}, NULL, coalesce(reason, 'already_read') FROM s{d} WHERE NOT fresh"]
        read += f" + (SELECT count(*) FROM q{d} WHERE outcome = 'read')"
        turns += f" + (SELECT count(*) FROM q{d})"
    parts.append(f"SELECT target, found_in, {_DEPTH + 1}, NULL, coalesce(reason, 'max_depth_exceeded') FROM n{_DEPTH + 1}")
    return out + " " + " UNION ALL ".join(parts)


@query("crawl_frontier", _walk_sql())
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    each = pages.select("page_id", site.alias("site"), F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1)).alias("hrefs"))
    owners = each.where(F.size("hrefs") > 0).groupBy(F.col("hrefs")[0].alias("path")).agg(F.min("page_id").alias("page_id"))
    held = each.join(owners, "page_id").withColumn("url", F.concat("site", "path"))
    by_path = held.select(F.col("path").alias("href"), F.col("url").alias("target"))
    links = held.select("url", F.posexplode("hrefs").alias("place", "href")).join(by_path, "href", "left")
    links = links.select("url", F.col("place").cast("long").alias("place"), F.coalesce("target", F.concat(F.lit("ftp://nowhere"), "href")).alias("target"))
    starts = each.groupBy(F.concat("site", F.lit("/start")).alias("target")).agg((2 * F.min("page_id")).alias("place"))
    entries = starts.unionByName(held.groupBy("site").agg(F.min_by("url", "page_id").alias("target"), (2 * F.min("page_id") + 1).alias("place")).select("target", "place"))
    sources = spark.createDataFrame([(d, d) for d in _SOURCES], "source string, domain string")
    entries = frontier.with_reasons(entries, sources).withColumnRenamed("target", "url")
    return frontier.walked(entries, frontier.with_reasons(links, sources), held.select("url"), _DEPTH, _DOCUMENTS)


# --- rules of access -----------------------------------------------------------------------------

#: Every host has these lines, some of them by the length of its name: line number, which lengths, line. Both engines read these rows.
_LINES = [
    (1, "n % 2 >= 0", "Disallow: /nobody"), (2, "n % 2 >= 0", "User-agent: *"), (3, "n % 3 = 0", "Disallow: /en/"), (4, "n % 3 <> 0", "Disallow: /EN/  # capitals"),
    (5, "n % 2 = 0", "Allow: /en/8"), (6, "n % 2 = 1", "disallow: /*?page="), (7, "n % 2 >= 0", "Crawl-delay: 7"), (8, "n % 5 = 0", "Disallow: /**.html$*"),
    (9, "n % 7 = 0", "User-Agent: FolioBot"), (10, "n % 7 = 0", "Allow: /en/*5$"), (11, "n % 7 = 0", "Disallow: /%65n/"), (12, "n % 7 = 0", "Crawl-delay: soon"),
    (13, "n % 7 = 0", "User-agent: other"), (14, "n % 7 = 0", "User-agent: foliobot"), (15, "n % 7 = 0", "Disallow: /fr"), (16, "n % 7 = 0", "Crawl-delay: 2.5"), (17, "n % 2 >= 0", "Disallow:"),
]


@query("robots_verdicts", """
WITH h AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages),
g AS (SELECT *, length(host) AS n, length(host) % 7 = 0 AS own FROM h),
r(own, m, k, allow, size, form) AS (VALUES (false, 3, 0, false, 4, '^/en/'), (false, 2, 0, true, 5, '^/en/8'), (false, 2, 1, false, 8, '^/.*[?]page='), (false, 5, 0, false, 7, '^/.*[.]html$'),
  (true, 7, 0, true, 6, '^/en/.*5$'), (true, 7, 0, false, 4, '^/en/'), (true, 7, 0, false, 3, '^/fr')),
m AS (SELECT url, max((size, allow)) AS best FROM g JOIN r ON r.own = g.own AND n % m = k AND regexp_matches(path, form) GROUP BY url)
SELECT DISTINCT g.url, host, path, coalesce(best[2], true) AS allowed, CAST(CASE WHEN own THEN 2.5 ELSE 7 END AS DOUBLE) AS delay FROM g LEFT JOIN m USING (url)
""")
def robots_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).distinct()
    every = F.array(*(F.when(F.expr(when), F.struct(F.lit(no).alias("line_no"), F.lit(line).alias("line"))) for no, when, line in _LINES))
    lines = urls.select("host", F.length("host").alias("n")).distinct().select("host", F.inline(F.array_compact(every)))
    requests = urls.withColumn("path", robots.request_path(F.col("url")))
    return robots.allowed(requests, robots.rules(lines), "FolioBot/1.0").select("url", "host", "path", "allowed", "delay")


@query("host_overlaps", """
WITH s AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM pages), d AS (SELECT domain AS source, domain FROM s UNION SELECT 'r:' || regexp_extract(domain, '[^.]+[.][^.]+[.][^.]+$'), regexp_extract(domain, '[^.]+[.][^.]+[.][^.]+$') FROM s)
SELECT a.source, b.source AS other, b.domain FROM d a JOIN d b ON a.source <> b.source AND (ends_with(a.domain, '.' || b.domain) OR a.domain = b.domain AND a.source < b.source)
""")
def host_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("domain")).distinct()
    inner = F.regexp_extract("domain", r"[^.]+[.][^.]+[.][^.]+$", 0)
    broader = hosts.select(F.concat(F.lit("r:"), inner).alias("source"), inner.alias("domain")).distinct()
    return robots.overlapping(hosts.select(F.col("domain").alias("source"), "domain").unionByName(broader))


# --- amendment events ------------------------------------------------------------------------------


@query("amendment_events", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS nth, l_partkey % 4 AS f, strftime(l_shipdate, '%-d') || '. ' || ['januar', 'feb', 'mars', 'apr', 'mai', 'jun', 'juli', 'aug', 'sept', 'okt', 'nov', 'des'][month(l_shipdate)] || ' ' || year(l_shipdate) AS said FROM lineitem),
e AS (
  SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 'amended' WHEN 1 THEN 'repealed' ELSE 'inserted' END AS kind, l_suppkey % 3 = 1 AS announced, 'lov/' || l_partkey AS ref, 'lov ' || l_partkey AS act,
    CASE f WHEN 0 THEN '(ikr. ' || said || ')' WHEN 1 THEN '(i kraft fra den tid Kongen bestemmer)' WHEN 2 THEN '(ikr. samtidig som [lov](lov/x' || l_suppkey || '))' END AS marker FROM l
  UNION ALL SELECT *, 'repealed', false, NULL, '3 mai 1990 nr. 7', '(se § 2, jf. (a) b)' FROM l WHERE l_quantity < 10)
SELECT l_orderkey AS key, 4 * nth - 1 AS source_line, '§ ' || l_linenumber AS provision, CASE WHEN l_suppkey % 3 = 0 THEN 'chapter' ELSE 'provision' END AS scope, kind, announced, act AS amending_act, ref AS amending_act_ref,
  CASE WHEN ref IS NULL THEN 'not_a_commencement_marker' WHEN f = 0 THEN 'explicit_date' WHEN f = 1 THEN 'pending_indeterminate' WHEN f = 2 THEN 'relative' ELSE 'absent' END AS marker_class,
  CASE WHEN ref IS NULL THEN NULL WHEN f = 2 THEN 'lov/x' || l_suppkey END AS commencement_instrument, CASE WHEN ref IS NOT NULL AND f = 0 THEN CAST(l_shipdate AS DATE) END AS valid_from, marker AS raw_marker,
  CASE WHEN ref IS NOT NULL AND f = 0 THEN CASE WHEN CAST(l_shipdate AS DATE) <= DATE '1996-06-30' THEN 'in_effect' ELSE 'not_in_effect' END WHEN ref IS NOT NULL AND f = 1 THEN 'not_in_effect' ELSE 'indeterminate' END AS status
FROM e
""")
def amendment_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a text: a provision for each of its items, with a note below whose words follow the item's numbers."""
    def picked(index: Column, *words: str) -> Column:
        return F.array(*map(F.lit, words))[index]

    def block(item: Column) -> Column:
        n, supplier, shipped = item["l_partkey"], item["l_suppkey"], item["l_shipdate"]
        month = picked(F.month(shipped) - 1, "januar", "feb", "mars", "apr", "mai", "jun", "juli", "aug", "sept", "okt", "nov", "des")
        said = F.concat(F.dayofmonth(shipped), F.lit(". "), month, F.lit(" "), F.year(shipped))
        verb = picked((supplier % 3).cast("int"), "**Kapitlet endra** med", "**Oppheves** ved", "Føyd  til ved")
        marker = F.when(n % 4 == 0, F.concat(F.lit(" (ikr. "), said, F.lit(")"))).when(n % 4 == 1, " (i kraft fra den tid Kongen bestemmer)").when(
            n % 4 == 2, F.concat(F.lit(" (ikr. samtidig som [lov](lov/x"), supplier, F.lit("))"))
        )
        more = F.when(item["l_quantity"] < 10, ", opphevet ved lov 3 mai 1990 nr. 7 (se § 2, jf. (a) b).").otherwise(".")
        # the second line of the note begins with the words that follow
        note = F.concat(F.lit("> "), verb, F.lit("\n> lov [lov "), n, F.lit("](lov/"), n, F.lit(")"), F.coalesce(marker, F.lit("")), more)
        return F.concat(F.lit("### § "), item["l_linenumber"], F.lit(". Om endret ved (noe)\n\n"), note)

    # rows are dealt out as they are, before any text is made of them, and to all tasks: few bytes here are much work
    items = table(spark, sf, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    whole = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")))
    texts = items.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.transform(whole, block), "\n").alias("text"))
    at = F.lit("1996-06-30").cast("date")
    found = events.events(texts).withColumn("status", temporal.evaluated(F.col("valid_from"), F.col("marker_class"), at, at)["status"])
    return found.drop("act_no", "span", "source_note", "commencement_kind", "provenance")
