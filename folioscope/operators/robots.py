"""Rules of access: which paths a host lets a crawler read, and which hosts a source covers."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published standard: characters that mean the same encoded or not, those that do not, and the file's own path.
UNRESERVED, RESERVED, OWN_PATH = string.ascii_letters + string.digits + "-._~", ":/?#[]@!$&'()*+,;=%", "/robots.txt"


def encoded(path: Column) -> Column:
    """Percent-encoding in one form: unreserved characters plain, all others that are not reserved encoded once, in capitals."""
    plain, kept = F.lit(UNRESERVED), F.lit(UNRESERVED + RESERVED)

    def one(piece: Column) -> Column:
        octet = F.chr(F.conv(F.substring(piece, 2, 2), 16, 10).cast("long"))
        escape = F.when(F.contains(plain, octet) & (octet != ""), octet).otherwise(F.upper(piece))
        other = F.when(piece == " ", "%20").otherwise(F.url_encode(piece))
        return F.when(F.length(piece) == 3, escape).when(F.contains(kept, piece), piece).when(piece == "~", piece).otherwise(other)

    pieces = F.regexp_extract_all(path, F.lit("(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1))
    usual = path.rlike(r"^[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]*$")  # nothing to encode or decode
    return F.when(usual, path).otherwise(F.array_join(F.transform(pieces, one), ""))


def request_path(url: Column) -> Column:
    """Path and query of a URL as rules are compared with them."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_extract(bare, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(rest, r"(?s)^([^?]*)", 1), F.regexp_extract(rest, r"(?s)\?(.+)$", 1)
    return F.concat(encoded(F.when(path == "", "/").otherwise(path)), F.when(query != "", F.concat(F.lit("?"), encoded(query))).otherwise(""))


def rules(lines: DataFrame) -> DataFrame:
    """host, agent, allow, pattern, anchored of every rule in files of lines (host, line_no, line), and crawl delays as rows without a pattern.

    User-agent lines in a row open a group, rules and delays fill it, and the
    first user-agent line after a rule opens the next one. A rule before any
    user-agent line belongs to nobody. Runs of ``*`` are one; a ``$`` at the end anchors.
    """
    bare = F.regexp_replace("line", r"(?s)#.*$", "")
    field = F.lower(F.trim(F.regexp_extract(bare, r"(?s)^([^:]*):", 1)))
    value = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
    told = lines.select("host", "line_no", field.alias("field"), value.alias("value")).where("field IN ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    line = Window.partitionBy("host").orderBy("line_no")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    is_rule, is_agent = F.col("field").isin("allow", "disallow"), F.col("field") == "user-agent"
    last_rule = F.max(F.when(is_rule & (F.col("agents") > 0), F.col("line_no"))).over(before)
    last_agent = F.max(F.when(is_agent, F.col("line_no"))).over(before)
    opens = is_agent & (last_agent.isNull() | (F.coalesce(last_rule, F.lit(-1)) > last_agent))
    placed = told.withColumn("agents", F.count_if(is_agent).over(line)).withColumn("opens", opens.cast("int"))
    grouped = placed.withColumn("group", F.sum("opens").over(line)).where("agents > 0")
    agents = grouped.where(is_agent).select("host", "group", F.lower("value").alias("agent")).distinct()
    held = F.regexp_replace(F.regexp_replace("value", r"\*{2,}", "*"), r"\$[$*]+", r"\$")
    anchored = held.endswith("$")
    seconds = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    each = grouped.where(~is_agent).select(
        "host", "group", F.when(is_rule, F.col("field") == "allow").alias("allow"), F.when(is_rule, encoded(F.regexp_replace(held, r"\$+$", ""))).alias("pattern"),
        F.when(is_rule, anchored).alias("anchored"), F.when((seconds >= 0) & (seconds < float("inf")), seconds).alias("delay"),
    )
    return agents.join(each, ["host", "group"]).drop("group")


def allowed(requests: DataFrame, of: DataFrame, agent: str) -> DataFrame:
    """``requests`` (host, path, as by ``request_path``) with ``allowed``, ``pattern`` and ``delay``: the longest rule that fits decides, allowing ones before others.

    ``agent`` is the crawler's product name: where groups name it they are its
    rules, all of them, else those of ``*``. A host without rules allows everything.

    Paths meet rules by equality: a path is unfolded to its prefixes of the
    lengths that rules begin with, and a rule is filed under what comes before
    its first ``*``. So no path meets the rules that it does not begin with, and the number of
    rows depends on the number of different lengths, at most the path's own.
    """
    token = agent.split("/")[0].strip().lower()
    mine = of.where(F.col("agent").isin(token, "*")).withColumn("named", F.col("agent") == token)
    has_own = mine.groupBy("host").agg(F.bool_or("named").alias("own"))
    mine = mine.join(has_own, "host").where("named = own")
    delays = mine.groupBy("host").agg(F.max("delay").alias("delay"))
    # an empty rule that is not anchored applies to nothing
    told = mine.where("pattern IS NOT NULL AND (pattern != '' OR anchored)").select("host", "allow", "pattern", "anchored").distinct()
    told = told.withColumn("start", F.substring_index("pattern", "*", 1))
    literal = F.regexp_replace("pattern", r"([^*]+)", r"\\Q$1\\E")
    form = F.concat(F.lit("(?s)^"), F.regexp_replace(literal, r"\*", ".*"), F.when(F.col("anchored"), r"\z").otherwise(""))
    told = told.withColumn("form", F.when(F.contains("pattern", F.lit("*")) | F.col("anchored"), form))
    lengths = told.groupBy("host").agg(F.collect_set(F.length("start")).alias("sizes"))
    paths = requests.select("host", "path").distinct()
    starts = paths.join(lengths, "host").select("host", "path", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("path"))
    met = starts.withColumn("start", F.substring("path", F.lit(1), F.col("size"))).join(told, ["host", "start"])
    fits = met.where(F.col("form").isNull() | F.expr("rlike(path, form)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("size"), "allow", "pattern")).alias("best"))
    out = requests.join(best, ["host", "path"], "left").join(delays, "host", "left")
    return out.withColumn("allowed", (F.col("path") == OWN_PATH) | F.coalesce("best.allow", F.lit(True))).withColumn("pattern", F.col("best.pattern")).drop("best")


def host_suffixes(host: Column) -> Column:
    """A host and the domains it lies in, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def covered(hosts: DataFrame, sources: DataFrame) -> DataFrame:
    """host, source for every source (source, domain) whose domain is the host or one it lies in: by equality with the host's domains."""
    each = hosts.select("host").distinct().select("host", F.explode(host_suffixes(F.lower("host"))).alias("domain"))
    return each.join(sources.select("source", F.lower("domain").alias("domain")).distinct(), "domain").select("host", "source", "domain")


def overlapping(sources: DataFrame) -> DataFrame:
    """source, other, domain: sources (source, domain) that lie in another's domain, or have the same one; each pair once, the broader domain named."""
    held = sources.select("source", F.lower("domain").alias("domain")).distinct()
    inner = held.select("source", F.col("domain").alias("own"), F.explode(host_suffixes(F.col("domain"))).alias("domain"))
    met = inner.join(held.withColumnRenamed("source", "other"), "domain").where("source != other AND (own != domain OR source < other)")
    return met.select("source", "other", "domain").distinct()
