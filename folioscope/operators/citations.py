"""References from section to section: found in the text, given their act, held against the sections there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import section_id
from ..session import written
from .ordering import heavy

#: Fixed forms: a section reference, the letters of slugs, and how far from a reference its act may be named.
REFERENCE, SLUG_LETTERS, REACH = r"§\s*(\d+(?:-[\da-z]+)?)", "A-Za-z0-9ÆØÅÄÖÜæøåäöü-", 80
#: The word that nothing but blanks divides from what follows, and these; it is looked for from the end.
LAST_WORD, BLANKS = rf"(?s)^(?:.*[^{SLUG_LETTERS}])?([{SLUG_LETTERS}]++\s*+)\z", " \t\n\x0b\f\r"
#: Words in over 1/``COMMON`` of all places are looked up before the others.
COMMON = 200


def mentions(texts: DataFrame, key: str) -> DataFrame:
    """key, slug, ``wordings``, ``gaps`` and ``words`` of texts with a reference: the references, what stands between them, and the words in it.

    Of a gap, before, between and after the references, there are its beginning and, if it is longer,
    its end, in lower case and within reach, and ``owner``: the word directly before the next reference
    where it begins within reach of the one before; it is then the last word of the beginning. A text is read within its row.
    """
    cut = texts.select(key, "slug", F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)).alias("wordings"), F.split("text", REFERENCE).alias("parts"))

    def owner(gap: Column) -> Column:
        last = F.regexp_extract(gap, LAST_WORD, 1)
        return F.transform(F.array(last), lambda w: F.when((w != "") & (F.length(gap) - F.length(w) < REACH), F.lower(F.rtrim(w, F.lit(BLANKS)))))[0]

    def near(gap: Column, at: Column) -> Column:
        end = F.when(F.length(gap) > REACH, F.lower(F.right(gap, F.lit(REACH))))
        return F.struct(F.lower(F.left(gap, F.lit(REACH))).alias("begin"), end.alias("end"), F.when((at > 0) & (at < F.size("wordings")), owner(gap)).alias("owner"))

    read = cut.where(F.size("wordings") > 0).select(key, "slug", "wordings", F.transform("parts", near).alias("gaps"))
    every = F.concat_ws(" ", "gaps.begin", "gaps.end", "gaps.owner")
    return read.withColumn("words", F.array_distinct(_words(every)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[{SLUG_LETTERS}]+"), F.lit(0))


def references(texts: DataFrame, acts: DataFrame, key: str = "key") -> DataFrame:
    """One row per text, act and section referred to, of texts (key, slug, text) and known acts (slug): the first wording.

    A reference means the longest other act named within reach of it, else its
    own. Neighbouring references do not share words: its reach ends at theirs,
    and at an act named directly before the next one. A word that reach cuts
    counts as what is left of it. Texts without a reference, empty and null ones give no row;
    the key tells texts apart. What is read of a text is written, as it is asked for three times. The words
    of a text meet the acts once, and those that are acts come back to it.
    """
    known = acts.select(F.col("slug").alias("word")).distinct()
    found = written(mentions(texts, key), "mentions")
    words = found.select(key, F.explode("words").alias("word"))
    common = heavy(words, "word", COMMON)
    common_acts = [r["word"] for r in known.where(F.col("word").isin(common)).collect()]
    met = words.where(~F.col("word").isin(common)).join(known, "word", "left_semi").groupBy(key).agg(F.collect_list("word").alias("named"))
    here = F.concat(F.coalesce("named", F.array().cast("array<string>")), F.array(*map(F.lit, common_acts)).cast("array<string>"))
    refs = F.transform("wordings", lambda w, i: F.struct(w.alias("wording"), F.col("gaps")[i].alias("before"), F.col("gaps")[i + 1].alias("after")))
    each = found.drop("words").join(met, key, "left").select(key, "slug", here.alias("named"), F.posexplode(refs).alias("ref", "r"))
    # words are cut anew, as a gap's beginning and end are shuffled for less than its words
    after, owned = _words(F.col("r.after.begin")), F.coalesce(F.array_contains("named", F.col("r.after.owner")), F.lit(False))
    cut = each.select(key, "slug", "named", "ref", "r.wording", owned.alias("owned"), _words(F.coalesce("r.before.end", "r.before.begin")).alias("before"), after.alias("after"))
    free = F.when(F.col("owned"), F.slice("after", F.lit(1), F.greatest(F.size("after") - 1, F.lit(0)))).otherwise(F.col("after"))
    near = cut.select(key, "slug", "ref", "wording", F.array_intersect(F.concat("before", free), "named").alias("near"))
    longest = F.aggregate(F.filter("near", lambda w: w != F.col("slug")), F.lit(None).cast("string"), lambda held, w: F.when(F.length(w) > F.coalesce(F.length(held), F.lit(0)), w).otherwise(held))
    told = near.select(key, F.coalesce(F.when(F.size("near") > 0, longest), "slug").alias("target"), F.regexp_extract("wording", REFERENCE, 1).alias("section_id"), "wording", "ref")
    return told.groupBy(key, "target", "section_id").agg(F.min_by("wording", "ref").alias("wording"), F.count(F.lit(1)).alias("n"))


def verdicts(refs: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Add ``valid`` to rows with (target, section_id), by known acts (slug, complete) and sections (slug, section_id).

    True where the act has the section, false where the act is unknown or its
    sections are all known, null where some of its headings could not be read.
    """
    whole = acts.groupBy(F.col("slug").alias("target")).agg(F.min("complete").alias("__complete"))
    there = sections.select(F.col("slug").alias("target"), "section_id", F.lit(True).alias("__there")).distinct()
    met = refs.join(whole, "target", "left").join(there, ["target", "section_id"], "left")
    valid = F.when(F.col("__complete").isNull(), False).when(F.col("__there"), True).when(F.col("__complete"), False)
    return met.withColumn("valid", valid).drop("__complete", "__there")


#: Fixed forms: a section as a citation writes it, and the letters a short name or an abbreviation must have.
CITED, SHORT_NAME, ABBREVIATION = r"§\s*([0-9]+(?:\s*[a-zA-Z](?![\p{L}\d]))?(?:-[0-9]+(?:\s*[a-zA-Z](?![\p{L}\d]))?)*)", 4, 3


def names(acts: DataFrame) -> DataFrame:
    """One row per name: the act with that slug, and the first and last act with it as short name or as abbreviation.

    ``acts`` has a slug per current document. A slug that several documents
    claim is no act, but its names still count as names. The short name is the
    slug up to its last hyphen, the abbreviation what follows.
    """
    claims = acts.where("slug IS NOT NULL").groupBy("slug").agg((F.count(F.lit(1)) > 1).alias("claimed"))
    before, after = F.regexp_extract("slug", "^(.*)-[^-]*$", 1), F.regexp_extract("slug", "-([^-]*)$", 1)
    forms = F.array(*(F.struct(name.alias("name"), F.lit(kind).alias("kind")) for name, kind in ((F.col("slug"), "slug"), (before, "short"), (after, "abbreviation"))))
    each = claims.select("*", F.inline(forms)).where("name != ''")
    act, short = F.struct("slug", "claimed"), F.col("kind") != "abbreviation"
    return each.groupBy("name").agg(
        F.max(F.when((F.col("kind") == "slug") & ~F.col("claimed"), F.col("slug"))).alias("exact"),
        F.min(F.when(short, act)).alias("low"), F.max(F.when(short, act)).alias("high"),
        F.min(F.when(~short, act)).alias("low_abbreviated"), F.max(F.when(~short, act)).alias("high_abbreviated"),
    )


def _named(requests: DataFrame, acts: DataFrame) -> DataFrame:
    """key, exact, low, high: the longest slug in each citation, and the ends of what its short names name.

    Words that many citations have meet the names by a broadcast, so that they fill no single task.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("citation"), F.lit(rf"[{SLUG_LETTERS}]+\.?"), F.lit(0))))
    dotted = F.col("word").endswith(".")
    words = requests.select("key", word.alias("word")).select("key", dotted.alias("dotted"), F.rtrim("word", F.lit(".")).alias("name"))
    held = names(acts)
    common = heavy(words, "name", COMMON)
    is_common = F.col("name").isin(common)
    met = words.where(~is_common).join(held.where(~is_common), "name")
    if common:
        met = met.unionByName(words.where(is_common).join(F.broadcast(held.where(is_common)), "name"))
    counts = F.length("name") >= F.when(F.col("dotted"), ABBREVIATION).otherwise(SHORT_NAME)

    def end(side: str):
        return F.when(counts, F.coalesce(F.col(side), F.when(F.col("dotted"), F.col(f"{side}_abbreviated"))))

    # rows that tell nothing go before they are sorted
    told = met.select("key", "exact", end("low").alias("low"), end("high").alias("high")).where("exact IS NOT NULL OR low IS NOT NULL")
    return told.groupBy("key").agg(F.max_by("exact", F.when(F.col("exact").isNotNull(), F.struct(F.length("exact"), "exact"))).alias("exact"), F.min("low").alias("low"), F.max("high").alias("high"))


def validated(requests: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Whether what each citation cites exists: key, valid, slug, section_id, heading, reason.

    ``requests`` has a citation per key; ``acts`` a slug per current document;
    ``sections`` slug, section_id and heading of each section. The longest slug
    that stands in the citation as a word is the act, else the one act that its
    short names and dotted abbreviations name. A section id may end in a letter
    after a space; where there is no such section, a last "i" is read as a word.
    A citation of an act alone is valid if there is the act. Reasons: range (§§),
    unparsed (neither act nor section), no_act, ambiguous_act, claimed_act,
    ambiguous_section, no_section. A null citation is an empty one.
    """
    asked = requests.select("key", F.coalesce("citation", F.lit("")).alias("citation"))
    written = F.regexp_extract("citation", CITED, 1)
    bare = F.regexp_replace(written, r"\s+i$", "")
    met = asked.join(_named(asked, acts), "key", "left").select(
        "key", "exact", "low", "high", F.contains("citation", F.lit("§§")).alias("range"),
        F.when(written != "", section_id(written)).alias("full"), F.when((written != "") & (bare != written), section_id(bare)).alias("bare"),
    )
    one = F.when(F.col("low.slug") == F.col("high.slug"), F.col("low"))
    slug = F.when(~F.col("range"), F.coalesce("exact", F.when(~one["claimed"], one["slug"])))
    found = sections.groupBy(F.col("slug").alias("act"), F.col("section_id").alias("found")).agg(F.count(F.lit(1)).alias("n"), F.min("heading").alias("heading"))
    unnamed = (
        F.when(F.col("range"), "range")
        .when(F.col("slug").isNull() & F.col("low").isNotNull() & one.isNull(), "ambiguous_act")
        .when(F.col("slug").isNull() & F.col("low").isNotNull(), "claimed_act")
        .when(F.col("slug").isNull() & F.col("full").isNull(), "unparsed")
        .when(F.col("slug").isNull(), "no_act")
    )
    # what was named is not carried on
    told = met.withColumn("slug", slug).select("key", "range", "full", "bare", "slug", unnamed.alias("unnamed"))
    # both readings of an id are looked up at once; the one as written comes first
    tries = F.array_compact(F.array("full", "bare"))
    looked = told.where("slug IS NOT NULL").select("key", F.col("slug").alias("act"), F.posexplode(tries).alias("turn", "found")).join(found, ["act", "found"])
    # a key has two rows at most: they are sorted where they meet, not where they are looked up
    best = looked.select("key", F.struct("turn", "n", "heading").alias("hit")).repartition("key").groupBy("key").agg(F.min("hit").alias("best"))
    out = told.join(best, "key", "left")
    reason = F.coalesce(
        "unnamed", F.when(F.col("full").isNotNull() & F.col("best").isNull(), "no_section").when(F.col("best.n") > 1, "ambiguous_section")
    )
    cited = F.coalesce(F.get(tries, F.col("best.turn")), F.when(F.col("slug").isNotNull(), F.col("bare")), "full")
    return out.select(
        "key", reason.isNull().alias("valid"), "slug", F.when(~F.col("range"), cited).alias("section_id"),
        F.when(reason.isNull(), F.col("best.heading")).alias("heading"), reason.alias("reason"),
    )
