"""Every query of the engine on the driver's tables, each with the SQL that must give the same rows.

A query is a thin binding: it names the tables' columns as an operator wants
them and applies the operator to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, content_hash, natural_key, slug
from ..operators import audit, changes, citations, evalmetrics, graph, observe, quality, sampling, scorecard, search, sections, temporal, usage, vectors, versions, workdays
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


# --- search -----------------------------------------------------------------


@query("body_search", """
SELECT doc_id, match_count,
  CASE WHEN b > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, b, at_ - b + 4 + 50), '[ \\t-\\r]+', ' ', 'g'))
  || CASE WHEN at_ + 4 + 50 - 1 < length(text) THEN '…' ELSE '' END AS snippet
FROM (SELECT *, greatest(at_ - 50, 1) AS b FROM (
  SELECT doc_id, text, CAST((length(text) - length(replace(lower(text), 'tion', ''))) // 4 AS BIGINT) AS match_count, instr(lower(text), 'tion') AS at_
  FROM documents WHERE contains(lower(text), 'tion') ORDER BY match_count DESC, doc_id LIMIT 20))
""")
def body_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.body_search(table(spark, sf, "documents"), "tion")


@query("title_search", """
SELECT p_partkey AS doc_id, p_name AS title, p_brand FROM part
WHERE contains(lower(p_name), 'bolt') AND p_size >= 10 ORDER BY doc_id LIMIT 20
""")
def title_search(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where("p_size >= 10")
    return search.title_search(parts.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), "p_brand"), "BOLT")


@query("recent_changes", """
SELECT o_orderkey AS doc_id, o_orderdate AS last_changed, o_orderpriority FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-06-01' ORDER BY last_changed DESC, doc_id LIMIT 100
""")
def recent_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("last_changed"), "o_orderpriority")
    return search.recent_changes(rows, "1996-06-01", 500)


@query("array_membership", """
SELECT doc_id, lang FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the')
""")
def array_membership(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("basis", F.split(F.lower("text"), " "))
    return search.members(docs, "basis", "the").select("doc_id", "lang")


@query("corpus_status", """
SELECT lang, source, count(*) AS n_docs, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS n_empty,
  CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source
""")
def corpus_status(spark: SparkSession, sf: str) -> DataFrame:
    return search.status(table(spark, sf, "documents"), ["lang", "source"])


@query("natural_sort", """
SELECT p_partkey, CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS section_id,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part
""")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.concat_ws("-", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", ids.alias("section_id"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(natural_key(F.col("section_id"))))
    return parts.select("p_partkey", "section_id", place.cast("long").alias("place"))


# --- changes and audits -------------------------------------------------------


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the same customers: their urgent orders as what is upstream now, their high ones as what was known."""
    orders = table(spark, sf, "orders")

    def state(priority: str) -> DataFrame:
        return orders.where(F.col("o_orderpriority") == priority).groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).cast("string").alias("hash"))

    status = F.when(F.col("c_acctbal") < 0, "removed").otherwise("current")
    held = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment", status.alias("status"))
    return state("1-URGENT"), state("2-HIGH").join(held, "doc_id")


_CHANGES = """
WITH u AS (SELECT o_custkey AS doc_id, count(*) AS h FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
m AS (SELECT o_custkey AS doc_id, c_mktsegment, count(*) AS h FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '2-HIGH' AND c_acctbal >= 0 GROUP BY ALL),
c AS (SELECT coalesce(u.doc_id, m.doc_id) AS doc_id, CASE WHEN m.h IS NULL THEN 'new' WHEN u.h IS NULL THEN 'removed' WHEN u.h <> m.h THEN 'changed' ELSE 'unchanged' END AS change
  FROM u FULL OUTER JOIN m ON u.doc_id = m.doc_id)
"""


@query("change_detection", _CHANGES + "SELECT doc_id, change FROM c")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    return changes.detected(*_manifest(spark, sf))


@query("mass_removal_ratio", _CHANGES + """
SELECT c_mktsegment, count(*) AS n_current, CAST(count(c.doc_id) AS BIGINT) AS n_removed, round(count(c.doc_id) / count(*), 6) AS ratio,
  count(*) >= 20 AND count(c.doc_id) / count(*) > 0.10 AS fires
FROM m LEFT JOIN (SELECT doc_id FROM c WHERE change = 'removed') c ON m.doc_id = c.doc_id GROUP BY c_mktsegment
""")
def mass_removal_ratio(spark: SparkSession, sf: str) -> DataFrame:
    upstream, manifest = _manifest(spark, sf)
    return changes.removal_ratios(changes.detected(upstream, manifest), manifest, "c_mktsegment")


@query("rename_detection", """
SELECT d.doc_id, f.from_id FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS from_id FROM documents GROUP BY 1 HAVING count(*) > 1) f
ON sha256(d.text) = f.h WHERE d.doc_id > f.from_id
""")
def rename_detection(spark: SparkSession, sf: str) -> DataFrame:
    return changes.renames(table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash")))


@query("slug_claims", """
SELECT doc_id, CASE WHEN claim = 1 THEN s ELSE s || '-' || claim END AS slug, claim FROM (
  SELECT p_partkey AS doc_id, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS claim
  FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part))
""")
def slug_claims(spark: SparkSession, sf: str) -> DataFrame:
    return changes.slug_claims(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), slug(F.col("p_type")).alias("slug")))


@query("duplicate_paths", """
SELECT p_type, count(*) AS n_owners, min(p_partkey) AS first_owner, max(p_partkey) AS last_owner FROM part GROUP BY p_type HAVING count(*) > 1
""")
def duplicate_paths(spark: SparkSession, sf: str) -> DataFrame:
    return changes.shared_paths(table(spark, sf, "part"), "p_type", "p_partkey")


@query("orphan_files", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def orphan_files(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.orphans(table(spark, sf, "customer").select("c_custkey", "c_name"), urgent, "c_custkey")


@query("section_multiset", """
WITH e AS (SELECT o_custkey, o_orderpriority, count(*) AS want FROM orders GROUP BY ALL),
h AS (SELECT o_custkey, o_orderpriority, count(*) AS have FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_custkey, o_orderpriority, want - coalesce(have, 0) AS lacking FROM e LEFT JOIN h USING (o_custkey, o_orderpriority) WHERE want > coalesce(have, 0)
""")
def section_multiset(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return changes.multiset_difference(orders, orders.where("o_orderstatus = 'F'"), "o_custkey", "o_orderpriority")


@query("content_hash", """
SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'))) AS content_hash FROM documents
""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("first_kept", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(lower(text), '[ \\t-\\r]+', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def first_kept(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    key = F.sha2(F.encode(collapsed(F.lower("text")), "UTF-8"), 256)
    kept = sampling.first_of(docs.select("doc_id", "lang", key.alias("k")), F.col("k"), ["doc_id"])
    return kept.select("doc_id", "lang")


# --- versions -------------------------------------------------------------------


@query("as_of_state", """
SELECT o_custkey, max(o_orderdate) AS o_orderdate, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders
WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey
""")
def as_of_state(spark: SparkSession, sf: str) -> DataFrame:
    return versions.as_of(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "1996-12-31", "o_orderkey")


@query("as_of_events", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), s AS (SELECT event_id AS sid, user_id, ts FROM events WHERE event_type = 'signup')
SELECT p.event_id, p.user_id, p.ts, max_by(s.sid, (s.ts, s.sid)) AS state_value, max(s.ts) AS state_at
FROM p LEFT JOIN s ON p.user_id = s.user_id AND s.ts <= p.ts GROUP BY ALL
""")
def as_of_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    probes = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    states = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("sid"))
    return versions.as_of_join(probes, states, "user_id", "ts", "at", "sid")


_ISLANDS = """
WITH i AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM i),
v AS (SELECT user_id, CAST(version AS BIGINT) AS version, event_type AS content, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_sightings FROM n GROUP BY ALL)
"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.islands(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type"), "ts")


@query("version_islands", _ISLANDS + "SELECT * FROM v")
def version_islands(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf)


@query("interval_locate", _ISLANDS + """
, f AS (SELECT user_id, max(version) FILTER (WHERE first_seen <= t AND last_seen >= t) AS inside, max(version) FILTER (WHERE last_seen < t) AS before, min(version) FILTER (WHERE first_seen > t) AS after
  FROM v, (SELECT (SELECT min(ts) FROM events) + INTERVAL 5 DAY AS t) GROUP BY user_id)
SELECT user_id, CASE WHEN inside IS NOT NULL THEN 'contained' WHEN before IS NULL THEN 'before_first_observation' WHEN after IS NULL THEN 'after_last_observation' ELSE 'between_observations' END AS outcome, inside, before, after FROM f
""")
def interval_locate(spark: SparkSession, sf: str) -> DataFrame:
    start = table(spark, sf, "events").agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).cast("string")).first()[0]
    return versions.located(_versions(spark, sf), "user_id", start)


@query("scd2_append", """
SELECT user_id, event_id, ts, substance, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM (
  SELECT *, lag(substance) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT user_id, event_id, ts, CAST(floor(value / 50) AS BIGINT) AS substance FROM events))
WHERE b IS NULL OR b <> substance
""")
def scd2_append(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return versions.revisions(events, "user_id", ["ts", "event_id"], F.floor(F.col("value") / 50)).drop("value")


@query("holder_spans", """
SELECT user_id, event_type, min(ts) AS first_held, max(ts) AS last_held, count(*) AS n_revs FROM events GROUP BY ALL
""")
def holder_spans(spark: SparkSession, sf: str) -> DataFrame:
    return versions.holder_spans(table(spark, sf, "events"), "user_id", "event_type", "ts")


@query("versions_per_day", """
SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1
""")
def versions_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return versions.one_per_day(table(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"]).select("user_id", "day", "event_id", "event_type")


@query("heading_carry", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events
""")
def heading_carry(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return versions.carried(table(spark, sf, "events"), "user_id", ["ts", "event_id"], heading, "heading").select("event_id", "heading")


@query("section_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
g AS (SELECT doc_id, line, line_no, sum(CASE WHEN regexp_matches(line, '^[A-E]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS group_no FROM l)
SELECT doc_id, CAST(group_no AS BIGINT) AS group_no, count(*) AS n_lines, min(line_no) AS first_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM g GROUP BY doc_id, group_no
""")
def section_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = sections.lines(table(spark, sf, "documents"))
    groups = sections.line_groups(rows, "doc_id", F.col("line").rlike("^[A-E]"))
    return groups.groupBy("doc_id", "group_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("line_no").cast("long").alias("first_line"), F.sum(F.length("line")).alias("n_chars")
    )


# --- quality ---------------------------------------------------------------------


_SETS = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([list_aggregate(w[i : i + 4], 'string_agg', ' ') for i in range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 5),
f AS (SELECT s, min(doc_id) AS doc_id FROM s GROUP BY s),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM f),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.g IN (SELECT g FROM g GROUP BY g HAVING count(*) BETWEEN 2 AND 1000000) GROUP BY ALL),
j AS (SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE c / (na + nb - c) >= 0.8)
"""


@query("near_dup_jaccard", _SETS + "SELECT a, b, jaccard FROM j")
def near_dup_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return quality.shingle_pairs(table(spark, sf, "documents"))


@query("dup_clusters", "WITH RECURSIVE " + _SETS.strip()[len("WITH "):] + """
, e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a)
SELECT node, min(label) AS label FROM r GROUP BY node
""")
def dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clusters(quality.shingle_pairs(table(spark, sf, "documents")).select("a", "b"))


@query("dup_members", "WITH RECURSIVE " + _SETS.strip()[len("WITH "):] + """
, e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a),
c AS (SELECT s, min(doc_id) AS class_id, count(*) AS n_copies FROM s GROUP BY s),
l AS (SELECT node, min(label) AS label FROM r GROUP BY node), k AS (SELECT a AS node, count(*) AS n FROM e GROUP BY a)
SELECT d.doc_id, c.class_id, c.n_copies, coalesce(l.label, c.class_id) AS cluster_id, CASE WHEN c.class_id IS NOT NULL THEN coalesce(k.n, 0) END AS n_links
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON s.s = c.s LEFT JOIN l ON c.class_id = l.node LEFT JOIN k ON c.class_id = k.node
""")
def dup_members(spark: SparkSession, sf: str) -> DataFrame:
    return quality.shingle_members(table(spark, sf, "documents"))


@query("privacy_hits", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id, line_no, kind FROM (
  SELECT doc_id, line_no, 'email' AS kind FROM l WHERE regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')
  UNION ALL SELECT doc_id, line_no, 'phone' FROM l WHERE regexp_matches(line, '\\+[0-9][0-9 ().-]{7,}[0-9]')
  UNION ALL SELECT doc_id, line_no, 'address' FROM l WHERE regexp_matches(line, '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b'))
""")
def privacy_hits(spark: SparkSession, sf: str) -> DataFrame:
    return quality.line_hits(sections.lines(table(spark, sf, "documents")), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


@query("garble_gate", """
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, text, coalesce(len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'de', 'la', 'der', 'die', 'und', 'el', 'que'))) / nullif(len(w), 0), 0) AS share FROM w)
SELECT doc_id, round(share, 6) AS share, CASE WHEN length(trim(text)) < 200 THEN 'empty' WHEN share < 0.05 THEN 'garbled' END AS hold FROM h
""")
def garble_gate(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*map(F.lit, ("the", "of", "and", "de", "la", "der", "die", "und", "el", "que")))
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.round(quality.function_share(text, words), 6).alias("share"), quality.holds(text, words).alias("hold")
    )


@query("quote_verify", """
WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \\t-\\r]+', ' ', 'g')) AS q FROM benchmark),
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t-\\r]+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON contains(t, q) WHERE q <> ''
""")
def quote_verify(spark: SparkSession, sf: str) -> DataFrame:
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return quality.quotes_found(quotes, table(spark, sf, "documents"))


# --- pages ------------------------------------------------------------------------


@query("page_links", """
SELECT page_id, href, min(pos) AS place FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS href, unnest(range(0, len(regexp_extract_all(html, 'href="([^"#]+)"', 1)))) AS pos FROM pages)
GROUP BY page_id, href
""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))
    return rows.groupBy("page_id", "href").agg(F.min("pos").cast("long").alias("place"))


@query("page_hosts", """
SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n_pages, count(DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1)) AS n_paths FROM pages GROUP BY 1
""")
def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.countDistinct(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1)).alias("n_paths")
    )


@query("page_measure")
def page_measure(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.html import measured

    return measured(table(spark, sf, "pages"))


# --- observation --------------------------------------------------------------------


@query("first_seen", """
SELECT user_id, event_type, min(ts) AS first_seen, CAST((min(ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Oslo' AS DATE) AS first_day FROM events GROUP BY user_id, event_type
""")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return observe.first_seen(table(spark, sf, "events"), ["user_id", "event_type"], "ts")


@query("last_seen", """
SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_ok, max(ts) AS last_any, bool_and(event_type = 'error') AS all_failed, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events GROUP BY user_id
""")
def last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return observe.last_seen(table(spark, sf, "events"), ["user_id"], "ts", F.col("event_type") == "error")


_FAILS = """
WITH g AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM events),
f AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, since ORDER BY ts, event_id) AS run_length FROM g WHERE event_type = 'error')
"""


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    return observe.failure_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("failure_runs", _FAILS + "SELECT event_id, user_id, run_length FROM f")
def failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _failures(spark, sf).select("event_id", "user_id", "run_length")


@query("backoff_due", _FAILS + """
, l AS (SELECT user_id, max(ts) AS last_failure, max_by(run_length, (ts, event_id)) AS run_length FROM f GROUP BY user_id)
SELECT user_id, last_failure, run_length, least(48.0, 24.0 * power(2, least(greatest(run_length - 1, 0), 8))) AS wait_hours,
  (epoch(TIMESTAMP '2024-02-01') - floor(epoch(last_failure))) / 3600.0 >= least(48.0, 24.0 * power(2, least(greatest(run_length - 1, 0), 8))) AS due FROM l
""")
def backoff_due(spark: SparkSession, sf: str) -> DataFrame:
    latest = _failures(spark, sf).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "run_length")).alias("l"))
    return observe.due(latest.select("user_id", F.col("l.ts").alias("last_failure"), F.col("l.run_length").alias("run_length")), "2024-02-01")


@query("composition", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_lost, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS loss_rate FROM events GROUP BY 1
""")
def composition(spark: SparkSession, sf: str) -> DataFrame:
    return observe.composition(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["day"], "event_type", "error")


@query("overlap_spans", """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS started, max(ts) AS ended FROM events GROUP BY ALL),
i AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS instant FROM events)
SELECT instant, min_by(user_id, (started, user_id)) AS user_id, count(*) AS n_spans FROM i JOIN s ON instant > started AND instant < ended GROUP BY instant
""")
def overlap_spans(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    spans = events.groupBy("user_id", "d").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    noon = events.select((F.col("d").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("instant")).distinct()
    return observe.dropped_triggers(spans, noon, "user_id")


@query("content_runs", """
WITH o AS (SELECT event_id, user_id, ts, event_type, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events),
l AS (SELECT *, coalesce(ts < top, false) AS late FROM o),
k AS (SELECT *, last_value(CASE WHEN NOT late THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM l),
r AS (SELECT *, sum(CASE WHEN late OR coalesce(kept <> event_type, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM k)
SELECT event_id, late, row_number() OVER w - CASE WHEN bool_or(late) OVER w THEN 1 ELSE 0 END AS run_length FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY event_id)
""")
def content_runs(spark: SparkSession, sf: str) -> DataFrame:
    return observe.content_runs(table(spark, sf, "events"), "user_id", ["event_id"], "ts", "event_type").select(
        "event_id", "late", F.col("run_length").cast("long").alias("run_length")
    )


@query("usage_hourly", """
SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(quantile_disc(CASE WHEN event_type <> 'error' THEN value END, 0.5), 1) AS p50, round(quantile_disc(CASE WHEN event_type <> 'error' THEN value END, 0.95), 1) AS p95,
  count(DISTINCT user_id) AS callers FROM events GROUP BY 1
""")
def usage_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return usage.hourly(table(spark, sf, "events"), "ts", "event_type", "value", "user_id", "error")


@query("usage_rollup", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(quantile_disc(CASE WHEN event_type <> 'error' THEN value END, 0.95), 1) AS p95, count(DISTINCT user_id) AS callers FROM events GROUP BY 1)
SELECT CAST(hour AS DATE) AS day, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, max(p95) AS worst_p95, max(callers) AS most_callers, count(*) AS hours FROM h GROUP BY 1
""")
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return usage.rolled_up(usage_hourly(spark, sf))


# --- vectors ------------------------------------------------------------------------


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first().embedding]


_COSINE = """round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
  / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"""


@query("vector_topk", f"""
SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10
""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 10, unique=True)


@query("vector_topk_filtered", f"""
SELECT vec_id, score FROM (SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.1
""")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(table(spark, sf, "embeddings").where("label IN (1, 2, 3)"), _query_vector(spark, sf), 20, floor=0.1, unique=True)


@query("vector_quantise", """
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_max([abs(x) for x in CAST(embedding AS DOUBLE[])]) / 127 AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, list_aggregate([CAST(greatest(-127, least(127, CAST(round_even(x / scale, 0) AS INTEGER))) AS VARCHAR) for x in v], 'string_agg', ',') AS entries FROM s
""")
def vector_quantise(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.quantised(table(spark, sf, "embeddings"))
    entries = F.array_join(F.transform("q", lambda x: x.cast("string")), ",")
    return out.select("vec_id", F.round("scale", 9).alias("scale"), entries.alias("entries"))


@query("recall_mrr", f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score, e.label = q.label AS hit FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10),
f AS (SELECT query_id, min(rank) FILTER (WHERE hit) AS first FROM r GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f
""")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    queries = embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.recall_mrr(vectors.neighbours(queries, embeddings, 10), 5)


# --- sampling and selection -----------------------------------------------------------


@query("hash_sample", """
SELECT doc_id, digest FROM (SELECT doc_id, sha256('s1' || chr(31) || doc_id) AS digest FROM documents) ORDER BY digest, doc_id LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM documents)
""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", "s1", 0.1)


@query("capped_selection", """
SELECT o_orderkey, o_orderpriority, o_custkey, place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2) WHERE place <= 40
""")
def capped_selection(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return sampling.capped(orders, "o_orderpriority", "o_custkey", "o_orderkey", 2, 40)


@query("seat_allocation", """
WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM c),
f AS (SELECT *, (n * 250) // total AS base, (n * 250) % total AS rest FROM t), p AS (SELECT *, 250 - sum(base) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, c_nationkey) AS place FROM f)
SELECT c_nationkey, n, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS seats FROM p
""")
def seat_allocation(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return sampling.seats(counts, "c_nationkey", "n", 250)


@query("trap_ids", """
WITH i AS (SELECT DISTINCT p_brand, p_size FROM part), r AS (SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM i GROUP BY p_brand),
w AS (SELECT p_brand, high, CAST(unnest(range(low, high + 2)) AS INTEGER) AS p_size FROM r)
SELECT p_brand, p_size, CASE WHEN p_size > high THEN 'overrun' ELSE 'gap' END AS kind FROM w ANTI JOIN i USING (p_brand, p_size)
""")
def trap_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.trap_ids(table(spark, sf, "part").select("p_brand", "p_size"), "p_brand", "p_size")


# --- metrics -----------------------------------------------------------------------------


@query("ratio_metrics", """
SELECT lang, round(avg(CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END), 6) AS control, round(avg(CASE WHEN toxic = 1 THEN CAST(quality AS DOUBLE) END), 6) AS treatment,
  round(avg(CASE WHEN toxic = 1 THEN CAST(quality AS DOUBLE) END) - avg(CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END), 6) AS delta
FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def ratio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return evalmetrics.paired_delta(rows, "lang", "toxic", "quality")


@query("wilson", """
WITH s AS (SELECT source, CAST(sum(quality) AS BIGINT) AS successes, count(*) AS trials FROM labels JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT *, successes / trials AS p, CAST(trials AS DOUBLE) AS n, 3.8414588206941227 AS z2 FROM s)
SELECT source, successes, trials, round(p, 6) AS rate,
  round(greatest((p + z2 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 0), 6) AS ci_low,
  round(least((p + z2 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 1), 6) AS ci_high FROM p
""")
def wilson(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return evalmetrics.ratios(rows.withColumn("one", F.lit(1)), ["source"], "quality", "one")


@query("bootstrap_ratio")
def bootstrap_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return evalmetrics.bootstrapped(rows.withColumn("one", F.lit(1)), "lang", "quality", "one")


@query("stability", """
SELECT conv_id, count(DISTINCT turn % 2) AS n_repeats, count(DISTINCT role) AS n_outcomes FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn % 2) <> 2 OR count(DISTINCT role) > 1
""")
def stability(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("repeat", F.col("turn") % 2)
    return evalmetrics.flipped(turns, "conv_id", "repeat", "role", 2)


@query("rate_spread", """
SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS sd FROM events GROUP BY event_type
""")
def rate_spread(spark: SparkSession, sf: str) -> DataFrame:
    return evalmetrics.spread(table(spark, sf, "events"), ["event_type"], "value")


# --- scores of two arms ----------------------------------------------------------------------

#: Every order is a case that both arms answered; its numbers stand for what a scorer found. Both engines read this text.
_ARMS = " UNION ALL ".join(
    f"""SELECT '{arm}' AS arm, o_orderkey AS case_id, concat('C', o_custkey % 8 + 1) AS category, o_orderkey * 3 + o_custkey + {5 * t} AS k, {3 + t} AS m FROM orders"""
    for t, arm in enumerate(("control", "treatment"))
)
_SCORES = f"""SELECT arm, case_id, category, outcome, CASE outcome WHEN 'PASS' THEN true WHEN 'FAIL' THEN false END AS passed,
  k % m = 0 AND k % 4 > 0 AS invented, k % 4 AS cited, least(k % 4, k % 3) AS valid, k % 6 AS quotes, least(k % 6, k % 5) AS checkable,
  least(k % 6, k % 5, k % 4) AS verified, CASE k % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' END AS claimed,
  CASE k % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' END AS premise, k % 2 = 0 AS retrieved, k % 7 AS claims, k % 2 AS loose
FROM (SELECT *, CASE WHEN k % 31 = 0 THEN 'MODEL_ERROR' WHEN k % 37 = 0 THEN 'SCORER_ERROR' WHEN k % 5 = 0 THEN 'UNRESOLVED_SEMANTIC'
  WHEN k % 5 < 3 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM ({_ARMS}) a) b"""
_SCORED = f"""WITH scores AS ({_SCORES}), lost AS (SELECT DISTINCT case_id FROM scores WHERE outcome IN ('MODEL_ERROR', 'SCORER_ERROR')),
scored AS (SELECT * FROM scores WHERE case_id NOT IN (SELECT case_id FROM lost)),
told AS (SELECT arm, category, unnest([
  {{'metric': 'unconditional_h1_rate', 'n': CAST(invented AS BIGINT), 'd': 1}},
  {{'metric': 'citation_coverage', 'n': CAST(cited > 0 AS BIGINT), 'd': 1}},
  {{'metric': 'citation_hallucination_rate', 'n': CAST(invented AND cited > 0 AS BIGINT), 'd': CAST(cited > 0 AS BIGINT)}},
  {{'metric': 'citation_accuracy', 'n': valid, 'd': cited}},
  {{'metric': 'valid_citations_per_answer', 'n': valid, 'd': 1}},
  {{'metric': 'invalid_citations_per_answer', 'n': cited - valid, 'd': 1}},
  {{'metric': 'misattribution_rate', 'n': CAST(category = 'C4' AND claimed IS NOT DISTINCT FROM 'fail' AS BIGINT), 'd': CAST(category = 'C4' AS BIGINT)}},
  {{'metric': 'correct_provision_identification', 'n': CAST(category IN ('C1', 'C2') AND passed IS NOT DISTINCT FROM true AS BIGINT), 'd': CAST(category IN ('C1', 'C2') AS BIGINT)}},
  {{'metric': 'quote_fidelity', 'n': verified, 'd': checkable}},
  {{'metric': 'false_premise_rejection_rate', 'n': CAST(category = 'C6' AND premise IS NOT DISTINCT FROM 'pass' AS BIGINT), 'd': CAST(category = 'C6' AND coalesce(premise, 'unresolved') <> 'unresolved' AS BIGINT)}},
  {{'metric': 'no_invention_rate_resolved_cases', 'n': CAST(category = 'C8' AND passed IS NOT DISTINCT FROM true AS BIGINT), 'd': CAST(category = 'C8' AND passed IS NOT NULL AS BIGINT)}},
  {{'metric': 'post_direct_retrieval_hallucination_rate', 'n': CAST(retrieved AND (invented OR claimed IS NOT DISTINCT FROM 'fail') AS BIGINT), 'd': CAST(retrieved AS BIGINT)}}
], recursive := true) FROM scored)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_SCORES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    found = F.when(F.col("invented"), F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    criteria = F.create_map(F.lit("claimed-attribution-not-asserted"), "claimed", F.lit("false-premise-not-endorsed"), "premise")
    return rows.select(
        "arm", "case_id", "category", "outcome", "passed", criteria.alias("criteria"), found.alias("asserted_h1"), F.col("cited").alias("asserted_citations"),
        F.col("cited").alias("asserted_resolved"), F.col("valid").alias("asserted_valid"), F.col("quotes").alias("quotes_detected"), F.col("checkable").alias("quotes_checkable"),
        F.col("verified").alias("quotes_verified"), F.col("claims").alias("unresolved_claims"), F.col("loose").alias("unattached_quotes"), "retrieved",
    )


@query("score_rates", _SCORED + """,
s AS (SELECT arm, metric, CAST(sum(n) AS BIGINT) AS numerator, CAST(sum(d) AS BIGINT) AS denominator FROM told GROUP BY 1, 2),
p AS (SELECT *, numerator / denominator AS p, CAST(denominator AS DOUBLE) AS t, 3.8414588206941227 AS z2, metric NOT LIKE '%per_answer' AND numerator <= denominator AS fits FROM s)
SELECT arm, metric, numerator, denominator, round(p, 6) AS rate,
  CASE WHEN fits THEN round(greatest((p + z2 / (2 * t) - 1.959963984540054 * sqrt(p * (1 - p) / t + z2 / (4 * t * t))) / (1 + z2 / t), 0), 6) END AS ci_low,
  CASE WHEN fits THEN round(least((p + z2 / (2 * t) + 1.959963984540054 * sqrt(p * (1 - p) / t + z2 / (4 * t * t))) / (1 + z2 / t), 1), 6) END AS ci_high FROM p
""")
def score_rates(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.rates(scorecard.samples(scorecard.scored(_scores(spark, sf))))


@query("score_differences", _SCORED + """,
r AS (SELECT metric, category, sum(n) FILTER (arm = 'control') / nullif(sum(d) FILTER (arm = 'control'), 0) AS c,
  sum(n) FILTER (arm = 'treatment') / nullif(sum(d) FILTER (arm = 'treatment'), 0) AS t FROM told GROUP BY 1, 2)
SELECT metric, category, CASE WHEN metric NOT LIKE 'post%' THEN round(c, 6) END AS control, round(t, 6) AS treatment,
  CASE WHEN metric NOT LIKE 'post%' THEN round(c - t, 6) END AS delta FROM r
""")
def score_differences(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.differences(scorecard.samples(scorecard.scored(_scores(spark, sf))), "category")


@query("score_eligibility", f"""
WITH f AS (SELECT case_id, bool_or(outcome = 'MODEL_ERROR') AS m, bool_or(outcome = 'SCORER_ERROR') AS s FROM ({_SCORES}) GROUP BY 1),
c AS (SELECT count(*) AS pairs_total, count(*) FILTER (NOT m AND NOT s) AS pairs_scored, count(*) FILTER (m) AS model_error_pairs, count(*) FILTER (s AND NOT m) AS scorer_error_pairs FROM f)
SELECT *, model_error_pairs <= 5 AS model_gate, scorer_error_pairs <= 2 AS scorer_gate, model_error_pairs <= 5 AND scorer_error_pairs <= 2 AS eligible FROM c
""")
def score_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.eligibility(_scores(spark, sf))


@query("score_outcomes", f"""
SELECT arm, category, count(*) FILTER (outcome = 'PASS') AS pass, count(*) FILTER (outcome = 'FAIL') AS fail, count(*) FILTER (outcome = 'UNRESOLVED_SEMANTIC') AS unresolved_semantic,
  count(*) FILTER (outcome = 'SCORER_ERROR') AS scorer_error, count(*) FILTER (outcome = 'MODEL_ERROR') AS model_error, count(*) AS total FROM ({_SCORES}) GROUP BY 1, 2
""")
def score_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.outcome_counts(_scores(spark, sf), "category")


@query("score_buckets", _SCORED + """
SELECT arm, CAST(sum(claims) AS BIGINT) AS unresolved_claims, CAST(sum(loose) AS BIGINT) AS unattached_quotes,
  CAST(sum(quotes - checkable) AS BIGINT) AS unverifiable_quotes, count(*) FILTER (passed IS NULL) AS cases_unresolved FROM scored GROUP BY arm
""")
def score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.buckets(scorecard.scored(_scores(spark, sf)))


@query("score_missingness", _SCORED + """,
o AS (SELECT sum(CASE arm WHEN 'control' THEN n ELSE -n END) AS observed FROM told WHERE metric = 'unconditional_h1_rate'),
c AS (SELECT count(DISTINCT case_id) AS total, (SELECT count(*) FROM lost) AS gone FROM scores),
e AS (SELECT count(DISTINCT case_id) FILTER (outcome = 'MODEL_ERROR') AS m,
  count(DISTINCT case_id) FILTER (outcome = 'SCORER_ERROR' AND case_id NOT IN (SELECT case_id FROM scores WHERE outcome = 'MODEL_ERROR')) AS s FROM scores)
SELECT gone AS dropped_pairs, round(observed / total, 6) AS delta_all_cases, round((observed - gone) / total, 6) AS worst_low, round((observed + gone) / total, 6) AS worst_high,
  CASE WHEN gone > 0 THEN CASE WHEN observed > 0 THEN observed > gone WHEN observed < 0 THEN observed + gone < 0 ELSE false END END AS survives, m <= 5 AND s <= 2 AS eligible FROM o, c, e
""")
def score_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.missingness(_scores(spark, sf))


@query("score_intervals")
def score_intervals(spark: SparkSession, sf: str) -> DataFrame:
    of = scorecard.samples(scorecard.scored(_scores(spark, sf)))
    return scorecard.difference_intervals(of).select(F.lit("both").alias("arm"), "metric", "ci_low", "ci_high").unionByName(scorecard.mean_intervals(of))


# --- chains --------------------------------------------------------------------------------


#: Every order but a customer's last is followed by the next one; every error of a user is put right by the next event.
_ORDER_EDGES = "SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders QUALIFY b IS NOT NULL"


@query("redirect_chain", f"""
WITH e AS ({_ORDER_EDGES}), o AS (SELECT *, count(*) OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT e.a, z.o_orderkey AS b, CAST(z.n - o.place AS BIGINT) AS steps FROM e JOIN o ON e.a = o.o_orderkey JOIN o z ON z.o_custkey = o.o_custkey AND z.place = z.n
""")
def redirect_chain(spark: SparkSession, sf: str) -> DataFrame:
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return graph.chased(table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), following.alias("b")).where("b IS NOT NULL"))


@query("correction_chain", """
WITH e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, min(CASE WHEN event_type <> 'error' OR place = n THEN place END) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ends FROM e)
SELECT g.event_id AS record_id, z.event_id AS in_force FROM g JOIN e z ON z.user_id = g.user_id AND z.place = g.ends WHERE g.event_type = 'error'
""")
def correction_chain(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    fixes = events.withColumn("replaced_by", following).where("event_type = 'error' AND replaced_by IS NOT NULL")
    records = events.where("event_type = 'error'").select(F.col("event_id").alias("record_id"))
    return observe.corrected(records, fixes.select(F.col("event_id").alias("retracts"), "replaced_by"))


# --- dates, audits and citations ------------------------------------------------------------


@query("event_evaluation", """
WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS f, l_returnflag = 'A' AS p,
  CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) - 25 AS a, DATE '1998-06-01' AS h FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN f <= a THEN 'in_force' WHEN f IS NOT NULL OR p THEN 'not_in_force' ELSE 'indeterminate' END AS in_force,
  CASE WHEN f <= a THEN 'in_effect' WHEN f IS NOT NULL THEN 'not_in_effect' WHEN a > h THEN 'indeterminate' WHEN p THEN 'not_in_effect' ELSE 'indeterminate' END AS status,
  CASE WHEN f IS NULL AND a > h THEN 'beyond_knowledge_horizon' END AS reason,
  CASE WHEN a > h THEN 'indeterminate' ELSE 'not_in_effect' END AS never
FROM e
""")
def event_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    valid_from = F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate"))
    marker = F.when(F.col("l_returnflag") == "A", temporal.PENDING).otherwise("absent")
    at, horizon = F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") - 25), F.lit("1998-06-01").cast("date")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        temporal.in_force(valid_from, marker, at).alias("in_force"),
        temporal.evaluated(valid_from, marker, at, horizon).alias("e"),
        temporal.never_in_force(at, horizon).getField("status").alias("never"),
    ).select("l_orderkey", "l_linenumber", "in_force", "e.status", "e.reason", "never")


@query("working_days", """
WITH days AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2005-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
sundays AS (SELECT DATE '1990-04-15' AS e UNION ALL SELECT unnest([DATE '1991-03-31', DATE '1992-04-19', DATE '1993-04-11', DATE '1994-04-03', DATE '1995-04-16', DATE '1996-04-07',
  DATE '1997-03-30', DATE '1998-04-12', DATE '1999-04-04', DATE '2000-04-23', DATE '2001-04-15', DATE '2002-03-31', DATE '2003-04-20', DATE '2004-04-11', DATE '2005-03-27'])),
moving AS (SELECT e + CAST(unnest([-3, -2, 0, 1, 39, 49, 50]) AS INTEGER) AS day FROM sundays),
works AS (SELECT day, isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('01-01', '05-01', '05-17', '12-25', '12-26') AND day NOT IN (SELECT day FROM moving) AS w FROM days),
nth AS (SELECT day, w, sum(CAST(w AS INTEGER)) OVER (ORDER BY day) AS n FROM works)
SELECT o_orderkey, d.day AS due FROM orders o JOIN nth s ON s.day = CAST(o_orderdate AS DATE) JOIN nth d ON d.w AND d.n = s.n + 15
""")
def working_days(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("sent"), F.lit(15).alias("n"))
    return workdays.with_working_day(orders, "sent", "n").select("o_orderkey", "due")


def _held_orders(spark: SparkSession, sf: str, path: Column) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "removed").otherwise("current")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), path.alias("path"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("renderer_version")
    )


@query("manifest_findings", """
WITH m AS (SELECT o_orderkey AS doc_id, o_custkey || '/' || o_orderpriority AS path, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'current' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS v FROM orders),
f AS (SELECT path FROM m WHERE o_totalprice >= 250000),
live AS (SELECT path FROM m WHERE status = 'current')
SELECT doc_id, path, 'tombstoned_but_present' AS kind FROM m WHERE status = 'removed' AND path IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM live)
UNION ALL SELECT doc_id, path, 'missing_document' FROM m WHERE status = 'current' AND path NOT IN (SELECT path FROM f)
UNION ALL SELECT doc_id, path, 'stale_render' FROM m WHERE status = 'current' AND path IN (SELECT path FROM f) AND v < 3
""")
def manifest_findings(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "o_custkey", "o_orderpriority")
    files = table(spark, sf, "orders").where("o_totalprice >= 250000").select(path.alias("path"))
    return audit.document_findings(_held_orders(spark, sf, path), files, 3)


@query("declared_findings", """
WITH m AS (SELECT o_orderkey AS doc_id, o_custkey AS path FROM orders WHERE o_orderstatus <> 'F'),
f AS (SELECT c_custkey AS path, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS declared, substr(lower(n_name), 1, n_regionkey + 1) AS language FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc_id, m.path, 'identity_mismatch' AS kind FROM m JOIN f USING (path) WHERE declared <> doc_id
UNION ALL SELECT doc_id, m.path, 'malformed_language' FROM m JOIN f USING (path) WHERE NOT regexp_full_match(language, '[a-z]{2,3}')
""")
def declared_findings(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("path"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("declared_id"),
        F.lower("n_name").substr(F.lit(1), (F.col("n_regionkey") + 1).cast("int")).alias("language"),
    )
    return audit.declared_findings(_held_orders(spark, sf, F.col("o_custkey")), files)


@query("snapshot_findings", """
WITH e AS (SELECT *, user_id || '-' || CAST(floor(value / 10) AS BIGINT) AS u FROM events),
o AS (SELECT u, max(ts) AS at_ FROM e WHERE event_type = 'view' GROUP BY 1),
t AS (SELECT u, max(ts) AS at_ FROM e WHERE event_type = 'error' GROUP BY 1),
b AS (SELECT u, max(value % 1) > 0.5 AS bad FROM e WHERE event_type = 'click' GROUP BY 1),
j AS (SELECT u, o.at_ AS seen, t.at_ AS retired, b.bad FROM o FULL JOIN t USING (u) FULL JOIN b USING (u))
SELECT sha256(u) AS sha, kind FROM (
  SELECT u, CASE WHEN retired IS NULL THEN 'missing' ELSE 'removed' END AS kind FROM j WHERE seen IS NOT NULL AND bad IS NULL
  UNION ALL SELECT u, 'mismatched' FROM j WHERE seen IS NOT NULL AND bad
  UNION ALL SELECT u, 'orphan' FROM j WHERE seen IS NULL AND bad IS NOT NULL
  UNION ALL SELECT u, 'unremoved' FROM j WHERE retired IS NOT NULL AND bad IS NOT NULL
  UNION ALL SELECT u, 'unknown_tombstone' FROM j WHERE retired IS NOT NULL AND seen IS NULL
  UNION ALL SELECT u, 'late' FROM j WHERE seen > retired)
""")
def snapshot_findings(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.sha2(F.concat_ws("-", "user_id", F.floor(F.col("value") / 10)), 256)
    events = table(spark, sf, "events").withColumn("sha", sha)
    log = {kind: events.where(F.col("event_type") == kind).select("sha", F.col("ts").alias("at")) for kind in ("view", "error")}
    blobs = events.where("event_type = 'click'").select("sha", F.when(F.col("value") % 1 > 0.5, "").otherwise(F.col("sha")).alias("actual"))
    return audit.snapshot_findings(log["view"], log["error"], blobs)


@query("append_only_problems", """
SELECT l_orderkey AS k, l_linenumber AS rev, CASE WHEN o_orderkey IS NULL THEN 'removed' ELSE 'rewritten' END AS kind
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = 1 WHERE o_orderkey IS NULL OR o_orderstatus <> l_linestatus
""")
def append_only_problems(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("rev"), F.col("l_linestatus").alias("status"))
    now = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("rev"), F.col("o_orderstatus").alias("status"))
    return audit.rewritten(now, before, ["k", "rev"], "status")


@query("cross_references", """
WITH acts AS (SELECT DISTINCT 'part-' || p_partkey AS slug, p_size < 25 AS complete FROM part WHERE p_retailprice >= 950),
sections AS (SELECT DISTINCT 'part-' || l_partkey AS slug, CAST(l_linenumber AS VARCHAR) AS section_id FROM lineitem WHERE l_returnflag = 'A'),
r AS (SELECT l_orderkey AS key, CASE WHEN slug IS NULL THEN 'order-' || l_orderkey ELSE slug END AS target, CAST(l_linenumber AS VARCHAR) AS section_id, slug, complete
  FROM lineitem LEFT JOIN acts ON slug = 'part-' || l_partkey),
g AS (SELECT key, target, section_id, any_value(slug) AS slug, bool_and(complete) AS complete, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT key, target, g.section_id, '§ ' || g.section_id AS wording, n,
  CASE WHEN g.slug IS NULL THEN false WHEN s.slug IS NOT NULL THEN true WHEN complete THEN false END AS valid
FROM g LEFT JOIN sections s ON s.slug = g.target AND s.section_id = g.section_id
""")
def cross_references(spark: SparkSession, sf: str) -> DataFrame:
    acts = table(spark, sf, "part").where("p_retailprice >= 950").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("slug"), (F.col("p_size") < 25).alias("complete"))
    items = table(spark, sf, "lineitem")
    number, act = F.col("l_linenumber").cast("string"), F.concat(F.lit("part-"), F.col("l_partkey"))
    # sentences are made where an order's items have met; rows are dealt out before they are brought together
    told = items.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("all"))
    sentences = F.transform("all", lambda x: F.concat(F.lit("Se PART-"), x["l_partkey"], F.lit(" § "), x["l_linenumber"], F.lit(".")))
    texts = told.select(F.col("l_orderkey").alias("key"), F.concat(F.lit("order-"), F.col("l_orderkey")).alias("slug"), F.array_join(sentences, " ").alias("text"))
    sections_there = items.where("l_returnflag = 'A'").select(act.alias("slug"), number.alias("section_id"))
    return citations.verdicts(citations.references(texts, acts), acts, sections_there)


@query("citation_verdicts", """
WITH acts AS (SELECT p_partkey AS p, p_partkey % 50 AS a FROM part), ends AS (SELECT a, count(*) AS n, min(p) AS p FROM acts GROUP BY 1),
sections AS (SELECT l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, count(*) AS n, min(l_returnflag) AS heading FROM lineitem GROUP BY 1, 2),
r AS (SELECT o_orderkey AS key, o_orderkey // 4 % 6 AS form, o_custkey AS c, o_orderkey % 60 AS q FROM orders),
m AS (SELECT key, form, CASE WHEN form IN (0, 1, 5) THEN acts.p WHEN form = 2 AND ends.n = 1 THEN ends.p END AS p, CASE WHEN form IN (0, 1, 2, 4) THEN q END AS q, ends.n AS same
  FROM r LEFT JOIN acts ON acts.p = c LEFT JOIN ends ON ends.a = c % 50),
v AS (SELECT m.*, s.n, s.heading, CASE WHEN form = 3 THEN 'range' WHEN form = 2 AND same > 1 THEN 'ambiguous_act' WHEN m.p IS NULL AND form = 5 THEN 'unparsed' WHEN m.p IS NULL THEN 'no_act'
  WHEN m.q IS NOT NULL AND s.n IS NULL THEN 'no_section' WHEN s.n > 1 THEN 'ambiguous_section' END AS reason FROM m LEFT JOIN sections s ON s.p = m.p AND s.q = m.q)
SELECT key, reason IS NULL AS valid, 'lov' || p || '-ab' || (p % 50) AS slug, CASE WHEN p IS NULL AND form = 1 THEN q || 'i' ELSE CAST(q AS VARCHAR) END AS section_id,
  CASE WHEN reason IS NULL THEN heading END AS heading, reason FROM v
""")
def citation_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    def act(number: str) -> Column:
        return F.concat(F.lit("lov"), number, F.lit("-ab"), F.col(number) % 50)

    acts = table(spark, sf, "part").select(act("p_partkey").alias("slug"))
    held = table(spark, sf, "lineitem").select(act("l_partkey").alias("slug"), F.col("l_quantity").cast("long").cast("string").alias("section_id"), F.col("l_returnflag").alias("heading"))
    c, q = F.col("o_custkey"), F.concat(F.lit("§ "), F.col("o_orderkey") % 60)
    short = F.concat(F.lit("Lov"), c)
    forms = [
        F.concat(q, F.lit(" "), act("o_custkey")), F.concat(short, F.lit(" "), q, F.lit(" i")), F.concat(F.lit("se AB"), c % 50, F.lit(". "), q),
        F.concat(F.lit("§§ 1-2 "), short), q, short,
    ]
    citation = F.array(*forms)[F.floor(F.col("o_orderkey") / 4) % 6]
    return citations.validated(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), citation.alias("citation")), acts, held)

from . import corpus, walks  # noqa: E402, F401  their queries are added to these
