"""Queries of sections, search over records and bodies, old addresses, stored vectors and slugs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import block_id, document_slug
from ..operators import graph, search, sections, vectors
from ..session import shared_dir, table
from ..sources import sidecar
from .register import query

# --- sections -------------------------------------------------------------------------------

#: Every order is a text of its items' sections, some with a block after them. Both engines read these expressions.
_ITEMS = """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS n,
  concat(CASE WHEN l_linenumber % 2 = 0 THEN concat(l_linenumber, ' B') ELSE concat(l_linenumber) END) AS label, l_quantity < 12 AS noted FROM lineitem"""
_SECTIONS = f"""WITH i AS ({_ITEMS}),
p AS (SELECT l_orderkey AS doc_id, CAST(n + count(*) FILTER (WHERE noted) OVER w - CAST(noted AS INTEGER) AS INTEGER) AS pos, replace(lower(label), ' ', '') AS section_id, 'Post ' || l_partkey AS heading, n, 'section' AS kind,
    'Antall ' || CAST(l_quantity AS BIGINT) || chr(10) || 'flagg ' || l_returnflag AS body FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)
  UNION ALL SELECT l_orderkey, CAST(n + count(*) FILTER (WHERE noted) OVER w AS INTEGER), '#takst-nr-' || l_suppkey, 'Takst nr. ' || l_suppkey, n, 'block', 'x' || l_partkey FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY n) QUALIFY noted),
s AS (SELECT doc_id, pos, section_id, heading, CASE WHEN n > 3 THEN 'Vedlegg 1' ELSE 'Kapittel I' END AS parent_chapter, CASE WHEN n > 3 THEN 'vedlegg' ELSE 'main' END AS layer, kind, body,
  CAST(row_number() OVER (PARTITION BY doc_id, section_id ORDER BY pos) AS INTEGER) AS occurrence FROM p)"""


def _texts(spark: SparkSession, sf: str, quantity: str = "CAST(l_quantity AS BIGINT)", keep: str = "true") -> DataFrame:
    items = spark.sql(_ITEMS.replace("FROM lineitem", "FROM {items}"), items=table(spark, sf, "lineitem")).where(keep)
    part = F.expr(f"""concat(CASE n WHEN 1 THEN '## Kapittel I\\n' WHEN 4 THEN '## Vedlegg 1\\n' ELSE '' END, '### §', label, '. Post ', l_partkey, '\\n\\nAntall ', {quantity}, '\\nflagg ', l_returnflag,
      CASE WHEN noted THEN concat('\\n#### Takst nr. ', l_suppkey, '\\nx', l_partkey) ELSE '' END)""")
    parts = F.array_sort(F.collect_list(F.struct("n", part.alias("part"))))
    return items.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text"))


def _trimmed(found: DataFrame) -> DataFrame:
    return found.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))


@query("section_list", _SECTIONS + " SELECT * FROM s")
def section_list(spark: SparkSession, sf: str) -> DataFrame:
    return _trimmed(sections.sections(_texts(spark, sf)))


@query("section_get", _SECTIONS + """,
r AS (SELECT o_orderkey AS doc_id, CASE WHEN (o_custkey % 7 + 1) % 2 = 0 THEN (o_custkey % 7 + 1) || 'b' ELSE CAST(o_custkey % 7 + 1 AS VARCHAR) END AS section_id, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 2 + 1 END AS asked FROM orders),
c AS (SELECT doc_id, section_id, count(*) AS n_same FROM s GROUP BY 1, 2)
SELECT r.doc_id, r.section_id, CAST(asked AS INTEGER) AS occurrence, CASE WHEN n_same > 1 AND asked IS NULL THEN 'ambiguous' WHEN s.body IS NULL THEN 'missing' ELSE 'found' END AS state, n_same, s.heading, s.body
FROM r LEFT JOIN c USING (doc_id, section_id) LEFT JOIN s ON s.doc_id = r.doc_id AND s.section_id = r.section_id AND s.occurrence = coalesce(asked, CASE WHEN n_same = 1 THEN 1 END)
""")
def section_get(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("o_custkey") % 7 + 1
    label = F.when(number % 2 == 0, F.concat(F.lit("§ "), number, F.lit(" B."))).otherwise(number.cast("string"))
    occurrence = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 2 + 1).cast("int")
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), label.alias("section_id"), occurrence.alias("occurrence"))
    return _trimmed(sections.requested(sections.sections(_texts(spark, sf)), asked))


#: The later version lacks items that were sent back and counts those that are done twice.
_LATER, _LATER_ITEMS = "CAST(CASE l_linestatus WHEN 'F' THEN l_quantity * 2 ELSE l_quantity END AS BIGINT)", "l_returnflag <> 'R' OR n = 1 OR n = 4"


@query("section_changes", f"""WITH i AS ({_ITEMS}),
e AS (SELECT l_orderkey AS doc_id, n, replace(lower(label), ' ', '') AS section_id, chr(10) || 'Antall ' || CAST(l_quantity AS BIGINT) || chr(10) || 'flagg ' || l_returnflag AS body,
    chr(10) || 'Antall ' || {_LATER} || chr(10) || 'flagg ' || l_returnflag AS later, {_LATER_ITEMS} AS kept, 0 AS part FROM i
  UNION ALL SELECT l_orderkey, n, '#takst-nr-' || l_suppkey, 'x' || l_partkey, 'x' || l_partkey, {_LATER_ITEMS}, 1 FROM i WHERE noted),
a AS (SELECT doc_id, section_id, n, part, body, row_number() OVER (PARTITION BY doc_id, section_id, body ORDER BY n, part) AS alike FROM e),
b AS (SELECT doc_id, section_id, n, part, later AS body, row_number() OVER (PARTITION BY doc_id, section_id, later ORDER BY n, part) AS alike FROM e WHERE kept),
l AS (SELECT doc_id, section_id, body, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY n, part) AS place FROM a ANTI JOIN b USING (doc_id, section_id, body, alike)),
r AS (SELECT doc_id, section_id, body, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY n, part) AS place FROM b ANTI JOIN a USING (doc_id, section_id, body, alike))
SELECT doc_id, section_id, CAST(place AS INTEGER) AS place, trim(l.body, chr(10)) AS body_before, trim(r.body, chr(10)) AS body_after, CASE WHEN l.body IS NULL THEN 'added' WHEN r.body IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM l FULL JOIN r USING (doc_id, section_id, place)
""")
def section_changes(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sections.sections(_texts(spark, sf)), sections.sections(_texts(spark, sf, _LATER, _LATER_ITEMS))
    out = sections.section_diff(before, after)
    return out.select("*", *(F.regexp_replace(c, r"^\s+|\s+$", "").alias(f"{c}_") for c in ("body_before", "body_after"))).drop("body_before", "body_after").withColumnsRenamed(
        {"body_before_": "body_before", "body_after_": "body_after"}
    )


# --- search ------------------------------------------------------------------------------------

#: Records of the documents; some slugs have two claimants. Every third text has footnote markers in it, every fifth is a table.
_RECORDS = """SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN concat('slug-', doc_id % 700) END AS slug, concat(lang, ' tekst ', source) AS title, CASE WHEN n_chars % 7 = 0 THEN 'removed' ELSE 'current' END AS status,
  source AS dataset FROM documents"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_RECORDS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))


@query("text_search", f"""
WITH m AS (SELECT * FROM ({_RECORDS}) WHERE status = 'current' AND slug IS NOT NULL QUALIFY count(*) OVER (PARTITION BY slug) = 1),
b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'on t', 'on[^1] t') WHEN doc_id % 5 = 0 THEN '| ' || replace(text, '. ', chr(10) || '| ') ELSE text END AS text FROM documents),
f AS (SELECT slug, m.doc_id, title, dataset, text, regexp_extract_all(lower(text), 'o(?:\\[\\^[^\\]\\s]+\\])?n(?:\\[\\^[^\\]\\s]+\\])? (?:\\[\\^[^\\]\\s]+\\])?t') AS hits FROM m JOIN b USING (doc_id) WHERE dataset IN (SELECT min(source) FROM documents)),
t AS (SELECT *, len(hits) AS match_count, instr(lower(text), hits[1]) AS at_, length(hits[1]) AS size FROM f WHERE len(hits) > 0 ORDER BY match_count DESC, slug LIMIT 100),
w AS (SELECT *, regexp_extract(substr(text, 1, at_ - 1), '[^\\n]*$') || regexp_extract(substr(text, at_), '^[^\\n]*') AS line, greatest(at_ - 50, 1) AS b FROM t)
SELECT slug, doc_id, title, dataset, match_count, CASE WHEN line LIKE '|%' THEN substr(trim(regexp_replace(line, '\\s+', ' ', 'g')), 1, 1200)
  ELSE CASE WHEN b > 1 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, b, at_ + size + 50 - b), '\\s+', ' ', 'g')) || CASE WHEN at_ + size + 49 < length(text) THEN '...' ELSE '' END END AS snippet FROM w
""")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    marked = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("on t"), F.lit("on[^1] t"))).when(
        F.col("doc_id") % 5 == 0, F.concat(F.lit("| "), F.replace("text", F.lit(". "), F.lit("\n| ")))
    )
    bodies = docs.select("doc_id", F.coalesce(marked, "text").alias("text"))
    return search.text_search(_records(spark, sf), bodies, "ON t", docs.agg(F.min("source")).first()[0], 500)


@query("record_search", f"""
SELECT * FROM ({_RECORDS}) WHERE status = 'current' AND contains(lower(coalesce(slug, '') || ' ' || title), '7 en tekst') ORDER BY doc_id LIMIT 20
""")
def record_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.record_search(_records(spark, sf), "7 EN Tekst")


# --- old addresses -------------------------------------------------------------------------------


@query("old_addresses", """
WITH o AS (SELECT o_orderkey AS a, o_custkey AS c, o_orderkey % 23 = 0 AS gone, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT *, bool_or(gone AND (n < last OR c % 10 = 0)) OVER (PARTITION BY c ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, bool_or(gone) OVER (PARTITION BY c) AS any_gone, max(CASE WHEN n = last THEN a END) OVER (PARTITION BY c) AS z FROM o)
SELECT a AS address, CASE WHEN c % 10 > 0 AND NOT ahead AND c % 3 > 0 THEN z END AS target,
  CASE WHEN c % 10 = 0 THEN CASE WHEN any_gone THEN 'gone' ELSE 'cyclic' END WHEN NOT ahead AND c % 3 > 0 THEN 'moved' ELSE 'gone' END AS outcome
FROM g WHERE n < last OR c % 10 = 0
""")
def old_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders are addresses of one document, each renamed to the next; some are removed, every tenth customer's last is renamed to the first."""
    orders = table(spark, sf, "orders")
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = orders.select(
        F.col("o_orderkey").alias("old"), "o_custkey", F.lead("o_orderkey").over(line).alias("following"), F.first("o_orderkey").over(every).alias("first"), F.last("o_orderkey").over(every).alias("last")
    )
    around = F.col("o_custkey") % 10 == 0
    renamed = placed.where(F.col("following").isNotNull() | around)
    new = F.when(F.col("old") % 23 != 0, F.coalesce("following", "first"))
    # an older rename of each address, which no longer counts
    retirements = renamed.select("old", new.alias("new"), F.lit(2).alias("at")).unionByName(renamed.select("old", F.col("first").alias("new"), F.lit(1).alias("at")))
    live = placed.where((F.col("old") == F.col("last")) & ~around & (F.col("o_custkey") % 3 != 0)).select(F.col("old").alias("address"))
    return graph.redirects(retirements, live)


# --- stored vectors ---------------------------------------------------------------------------------

_ENTRY = "CAST(greatest(-127, least(127, CAST(round_even(x / CAST(scale AS DOUBLE), 0) AS INTEGER))) AS VARCHAR)"
_LOUD = "list_max([abs(x) for x in CAST(embedding AS DOUBLE[])])"


def _listed(row: str) -> F.Column:
    return F.array_join(F.transform(F.col(row), lambda x: x.cast("string")), ",")


@query("embedding_reuse", f"""
WITH e AS (SELECT label AS document, vec_id AS text, CAST(embedding AS DOUBLE[]) AS v, {_LOUD} AS loud FROM embeddings),
p AS (SELECT document, CAST(max(loud) / 127 AS FLOAT) AS kept FROM e WHERE text % 5 > 0 GROUP BY 1),
l AS (SELECT document, count(*) FILTER (text % 7 = 0) AS lost FROM e JOIN p USING (document) WHERE text % 5 > 0 AND round_even(loud / CAST(kept AS DOUBLE), 0) >= 127 GROUP BY 1),
n AS (SELECT document, CAST(max(loud) / 127 AS FLOAT) AS scale, CAST(max(loud) FILTER (text % 5 = 0) / 127 AS FLOAT) AS fresh FROM e WHERE text % 7 > 0 GROUP BY 1),
k AS (SELECT document, n.scale, kept IS NOT NULL AND lost = 0 AND coalesce(fresh, 0) <= kept AS keeps, kept FROM n LEFT JOIN p USING (document) LEFT JOIN l USING (document))
SELECT document, text, CAST(scale AS DOUBLE) AS scale, list_aggregate([{_ENTRY} for x in v], 'string_agg', ',') AS entries,
  CASE WHEN keeps AND text % 5 > 0 THEN 'reused' WHEN keeps OR kept IS NULL THEN 'fresh' ELSE 'redone' END AS how FROM e JOIN k USING (document) WHERE text % 7 > 0
""")
def embedding_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are documents and vectors their texts: those not divisible by 5 were stored, those not divisible by 7 are wanted now."""
    every = table(spark, sf, "embeddings").select(F.col("label").alias("document"), F.col("vec_id").alias("text"), F.col("embedding").alias("vector"))
    prior = vectors.quantised_together(every.where("text % 5 > 0"), "document").select("document", "text", "row", "scale")
    out = vectors.incremental(every.where("text % 7 > 0"), prior)
    return out.select("document", "text", F.col("scale").cast("double").alias("scale"), _listed("row").alias("entries"), "how")


@query("sidecar_roundtrip", f"""
WITH s AS (SELECT label, CAST(max({_LOUD}) / 127 AS FLOAT) AS scale, count(*) AS n FROM embeddings GROUP BY label)
SELECT 'label-' || label AS slug, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS place, 'v' || vec_id AS section_id, CAST(scale AS DOUBLE) AS scale,
  CASE WHEN label % 2 = 0 THEN md5(CAST(label AS VARCHAR)) END AS space_id, list_aggregate([{_ENTRY} for x in CAST(embedding AS DOUBLE[])], 'string_agg', ',') AS entries FROM embeddings JOIN s USING (label)
""")
def sidecar_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as one file a label and read again."""
    rows = vectors.quantised_together(table(spark, sf, "embeddings"), "label", "embedding")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    space = F.when(F.col("label") % 2 == 0, F.md5(F.col("label").cast("string").cast("binary")))
    held = rows.select(F.concat(F.lit("label-"), "label").alias("slug"), place.alias("place"), F.concat(F.lit("v"), "vec_id").alias("section_id"), F.col("row").alias("vector"), "scale", space.alias("space_id"))
    path = f"{shared_dir(spark)}/sidecars-{uuid.uuid4().hex}"
    sidecar.write(held, path)
    back = sidecar.read(spark, path)
    return back.select("slug", "place", "section_id", F.col("scale").cast("double").alias("scale"), "space_id", _listed("vector").alias("entries"))


# --- slugs ---------------------------------------------------------------------------------------------

_TITLES = "SELECT p_partkey AS doc_id, concat(CASE p_partkey % 4 WHEN 0 THEN 'Ærlig ' WHEN 1 THEN 'tjïelte/' WHEN 2 THEN '(x) --' ELSE '' END, CASE WHEN p_partkey % 9 > 0 THEN concat(p_name, ' [', p_type, '] Nr. ', p_size) ELSE '' END) AS title FROM part"


@query("slug_forms", f"""
WITH t AS ({_TITLES}), s AS (SELECT doc_id, title, trim(regexp_replace(lower(regexp_replace(title, '[\\[(].*?[\\])]', '', 'g')), '[^a-z0-9æøåäöüïáčđŋšŧž]+', '-', 'g'), '-') AS s,
  trim(substr(trim(regexp_replace(lower(title), '[^a-z0-9æøåäöü]+', '-', 'g'), '-'), 1, 60), '-') AS b FROM t)
SELECT doc_id, CASE WHEN s = '' THEN CAST(doc_id AS VARCHAR) ELSE s END AS slug, CASE WHEN b = '' THEN '' ELSE '#' || b END AS block FROM s
""")
def slug_forms(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.sql(_TITLES.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    slug = document_slug(F.lit(None).cast("string"), F.col("title"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", slug.alias("slug"), block_id(F.col("title")).alias("block"))
