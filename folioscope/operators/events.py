"""Amendment events of documents: what the notes below their provisions say was changed, by which act, and from when.

A note is a block of lines that are quoted with ``> ``. Marks are set in it at links,
verbs, acts, brackets and what lies between, and everything is told from their
order within the note: the verb that governs an act is the nearest one before it, the
brackets that follow an act up to the next one are its markers. What stands in
brackets is neither verb nor act. A text and its notes are read within their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import PENDING

# --- fixed values: the words of notes, as their sources write them -----------------------------------

KINDS = {
    "endret": "amended", "endra": "amended", "endres": "amended", "tilføyd": "inserted", "tilføydd": "inserted", "tilføyet": "inserted", "tilføyes": "inserted",
    "føyd til": "inserted", "opphevet": "repealed", "oppheva": "repealed", "oppheves": "repealed",
}
ANNOUNCED = ("endres", "tilføyes", "oppheves")
SCOPES = {
    "kapitlet": "chapter", "kapittelet": "chapter", "kapittel": "chapter", "overskriften": "heading", "overskrift": "heading", "overskrifta": "heading",
    "kapitteloverskrift": "chapter_heading", "kapitteloverskriften": "chapter_heading", "deloverskrift": "part_heading", "kapittelnummeret": "chapter_number",
    "kapitelnummeret": "chapter_number", "avsnitt": "paragraph", "avsnittet": "paragraph", "paragrafen": "provision", "delen": "part",
}
MONTHS = {
    "januar": 1, "jan": 1, "februar": 2, "feb": 2, "mars": 3, "mar": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "desember": 12, "des": 12,
}
FUTURE = r"Vert|Blir|Vil\s+bli"
PENDING_FORM = r"(?-i:(?=[dDkK\u212A]))(?:\bden\s+ti(d|den|l)\b.{0,20}\b(Kongen|departementet)\b|Kongen\s+fastset)"
RELATIVE_FORM = r"(?-i:(?=[sS\u017FfF]))(?:\bsamtidig\s+(som|med)\b|\bsame\s+tid\s+som\b|\bfrå\s+same\s+tid\b)"
COMMENCEMENT_FORM = r"(?:^|[,;]\s*)(ikr\.|i\s?kraft|iverksatt)"
NEVER_FORM = r"\b(?:ikke\s+satt|ikkje\s+sett)\s+i\s+kraft\b"
PROVISION_FORM, CHAPTER_FORM = r"^#{2,4}\s+(§{1,2}\s*[^.]+?)\s*(?:\.|$)", r"^##\s+(Kapittel|Kap\.|Del)\s+([^\s.]+)"
ACT_FORM = r"\b\d{1,2}\s+[a-zæøå]+\.?\s+(?:19|20)\d{2}\s+nr\.\s*\d+"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
ACT_LINK, NO_HEADING = "lov/", "(document)"

# --- forms made of them -------------------------------------------------------------------------------


def _any(words) -> str:
    """Alternatives, longest first; a letter that several begin with is looked at once."""
    by = {}
    for word in sorted(words, key=len, reverse=True):
        by.setdefault(word[0], []).append(word[1:].replace(" ", r"\s+"))
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())


#: Case does not matter, and letters of all scripts are letters.
FLAGS = "(?iU)"
LINK = r"\[[^\]]*\]\([^)]*\)"
VERB = rf"\*{{0,2}}(?:(?:{FUTURE})\s+)?(?:{_any(KINDS)})\*{{0,2}}(?:\s+i\s+sin\s+helhet)?\s+(?:ved|med)\b"
HEAD = rf"{FLAGS}^\*{{0,2}}(?:({_any(SCOPES)})\s+)?\*{{0,2}}(?:({FUTURE})\s+)?({_any(KINDS)})\*{{0,2}}(?:\s+i\s+sin\s+helhet)?\s+(?:ved|med)\b"
SCOPE = rf"{FLAGS}^\*{{0,2}}({_any(SCOPES)})\s+"
#: Verbs, acts, and what else is not plain text. Letters that none begins with are passed over at once: the first two of each word.
FIRST, SECOND = ("".join(sorted({w[k].lower() for w in [*KINDS, *FUTURE.split("|")]})) for k in (0, 1))
ACT = rf"\[[^\]]*\]\((?-i:{ACT_LINK})[^)]*\)|{ACT_FORM}"
TOKEN = rf"{FLAGS}(?=(?-i:[\[\d()*{FIRST}{FIRST.upper()}]))(?=[\[\d()*]|.[{SECOND}])(?:({VERB})|({ACT})|({LINK}|[()]))"
DATE = rf"{FLAGS}(?=\d)\b(\d{{1,2}})\.?\s+({_any(MONTHS)})\.?\s+(\d{{4}})\b"


def _looked_up(word: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.regexp_replace(F.lower(word), r"\s+", " ")]


def _flat(text: Column, form: str) -> Column:
    return text.rlike(FLAGS + form)


def _heading(line: Column) -> Column:
    """The provision or chapter that a line is the heading of; null for other lines."""
    return F.when(_flat(line, PROVISION_FORM), F.trim(F.regexp_extract(line, FLAGS + PROVISION_FORM, 1))).when(_flat(line, CHAPTER_FORM), F.trim(F.regexp_replace(line, "^## ", "")))


def lines_with_provision(docs: DataFrame, key: str) -> DataFrame:
    """key, line_no (from 1), line and the provision it stands under: the last heading of a section or chapter at or before it."""
    rows = docs.select(key, F.posexplode(F.split(F.col("text"), LINE_ENDS)).alias("at", "line"))
    heading = _heading(F.col("line"))
    here = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    provision = F.coalesce(F.last(heading, ignorenulls=True).over(here), F.lit(NO_HEADING))
    return rows.select(key, (F.col("at") + 1).alias("line_no"), "line", provision.alias("provision"))


def notes(docs: DataFrame, key: str = "key") -> DataFrame:
    """key, source_line, provision and note of every quoted block of texts (key, text); the key tells texts apart.

    A text is read within its row, so that no line is sorted or shuffled: every
    line becomes a mark, with separators that no line can hold (it would end there), and the
    marks are cut first at headings, then at lines that are not quoted.
    """
    # the other ends of lines; a form of one letter is cut at without being made anew for each text
    lines = F.split(F.regexp_replace("text", r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029](?:(?<=\r)\n)?+", "\n"), "\n")
    marks = F.concat(F.lit(f"{NO_HEADING}\x1c"), F.array_join(F.transform(lines, _mark), ""))
    # a note begins with its first line of words, and has one number and a blank between lines
    begun = F.regexp_replace(marks, r"\x1c(?:\x1e\d++\|)++", "\x1c")
    blocks = F.regexp_replace(begun, r"\x1e(?<!\x1c\x1e)\d++(?:> |\|)", " ")
    under = docs.select(key, F.explode(F.split(blocks, "\x1d")).alias("under"))
    each = under.select(key, F.substring_index("under", "\x1c", 1).alias("provision"), F.explode(F.regexp_extract_all("under", F.lit(r"\x1e([^\x1c]++)"), F.lit(1))).alias("block"))
    number = F.substring_index("block", ">", 1)
    return each.select(key, number.cast("int").alias("source_line"), "provision", F.substring("block", F.length(number) + 3, F.length("block")).alias("note"))


def _mark(line: Column, at: Column) -> Column:
    number = (at + 1).cast("string")
    return (
        F.when(line.startswith("> "), F.concat(F.lit("\x1e"), number, line))
        .when(line == ">", F.concat(F.lit("\x1e"), number, F.lit("|")))
        .when(line.startswith("#"), F.coalesce(F.concat(F.lit("\x1d"), _heading(line), F.lit("\x1c")), F.lit("\x1c")))
        .otherwise("\x1c")
    )


def _read(found: DataFrame) -> DataFrame:
    """Notes with ``read``: the note, where verbs stand between \x1c and \x1d, acts between \x0b and \x1e, and brackets between \n and \r.

    No note holds these, as a line would end there. What stands in a bracket is not
    marked, and the last bracket, if it is left open, is none. Only brackets are gone
    through in order; all else is told by expressions over the whole note.
    """
    marked = F.regexp_replace("note", TOKEN, "\x1c$1\x1d$2\x1e$3")
    for form, mark in (("\x1c\x1d\x1e[", "["), ("\x1c\x1d\x1e(", "\x0c\n"), ("\x1c\x1d\x1e)", "\x0c\r"), ("\x1c\x1d", "\x0b"), ("\x1d\x1e", "\x1d")):
        marked = F.replace(marked, F.lit(form), F.lit(mark))

    def bare(part: Column) -> Column:
        return F.when(part.rlike("[\n\r\x1c\x0b]"), F.translate(part, "\n\r\x1c\x1d\x0b\x1e", "()")).otherwise(part)

    def state(depth: Column, done: Column, held: Column) -> Column:
        return F.struct(depth.alias("depth"), done.alias("done"), held.alias("held"))

    def step(now: Column, part: Column) -> Column:
        depth, done, held = now["depth"], now["done"], now["held"]
        return (
            F.when(part.startswith("\n"), state(depth + 1, done, F.concat(held, part)))
            .when(~part.startswith("\r"), state(depth, part, held))
            .when(depth == 1, state(F.lit(0), F.concat(done, F.lit("\n("), bare(_cut(held, 1)), F.lit(")"), part), F.lit("")))
            .when(depth > 1, state(depth - 1, done, F.concat(held, part)))
            # a closing bracket that closes nothing does not count
            .otherwise(state(depth, F.concat(done, F.lit(")"), _cut(part, 1)), held))
        )

    # the marked note is bound, so that its marks are set once
    parts, end = F.split("marked", "\x0c"), lambda now: F.when(now["depth"] > 0, F.concat(now["done"], F.translate(now["held"], "\n\r", "()"))).otherwise(now["done"])
    nested = F.aggregate(parts, state(F.lit(0), F.lit(""), F.lit("")), step, end)
    return found.withColumn("marked", marked).withColumn("read", F.when(F.contains("marked", F.lit("\x0c")), nested).otherwise(F.col("marked"))).drop("marked")


def _cut(text: Column, n: int) -> Column:
    """``text`` without its first ``n`` letters."""
    return F.substring(text, F.lit(n + 1), F.length(text))


def marker_class(marker: Column) -> Column:
    """What a bracket says of commencement, by its form, never by there being a year in it; the first that fits of pending, relative and dated."""
    return _class(marker, _marker_body(marker), lambda body: F.when(_date(_written(body)).isNotNull(), "explicit_date").otherwise("unrecognised"))


def _class(marker: Column, body: Column, otherwise) -> Column:
    return (
        F.when(marker.isNull(), "absent")
        .when(~_flat(body, COMMENCEMENT_FORM), "not_a_commencement_marker")
        .when(_flat(body, PENDING_FORM), PENDING)
        .when(_flat(body, RELATIVE_FORM), "relative")
        .otherwise(otherwise(body))
    )


def _marker_body(marker: Column) -> Column:
    return F.btrim(F.regexp_replace(marker, r"\[([^\]]*)\]\([^)]*\)", "$1"), F.lit("() "))


def marker_date(marker: Column) -> Column:
    """The first written date of a bracket; null where there is no such day."""
    return _date(_written(_marker_body(marker)))


def _written(body: Column) -> Column:
    return F.regexp_extract(body, DATE, 0)


def _date(written: Column) -> Column:
    day, month, year = (F.regexp_extract(written, DATE, k) for k in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year, _looked_up(month, MONTHS).cast("string"), day), "yyyy-M-d")


def _word(verb: Column) -> Column:
    return F.regexp_extract(verb, rf"{FLAGS}({_any(KINDS)})", 1)


def events(docs: DataFrame, key: str = "key") -> DataFrame:
    """One row per amending act and marker of the notes of texts (key, text): provision, scope, kind, announced, act, marker and what the marker says.

    A note that does not begin as amendment notes do gives none. An act with
    several markers gives a row for each, one without gives a row with marker class
    ``absent``. A written date that no calendar has makes its marker ``unrecognised``.
    """
    note = [key, "source_line", "provision", "scope", "source_note"]
    scope = F.coalesce(_looked_up(F.regexp_extract("note", SCOPE, 1), SCOPES), F.lit("provision"))
    read = _read(notes(docs, key).where(F.col("note").rlike(HEAD))).select(key, "source_line", "provision", scope.alias("scope"), F.col("note").alias("source_note"), "read")
    acts = read.select(*note, "read", F.posexplode(F.split("read", "\x0b")).alias("act_no", "part")).where("act_no > 0")
    acts = acts.withColumn("before", F.call_function("substring_index", F.col("read"), F.lit("\x0b"), F.col("act_no")))
    verb = F.when(F.contains("before", F.lit("\x1c")), F.substring_index(F.substring_index("before", "\x1c", -1), "\x1d", 1))
    opened = F.length("before") - F.length(F.replace("before", F.lit("\n"), F.lit("")))
    act = F.substring_index("part", "\x1e", 1)
    told = acts.select(*note, "act_no", "part", act.alias("act"), verb.alias("verb"), _word(verb).alias("word"), opened.alias("opened"))
    each = told.select(*note, "act_no", "act", "verb", "word", "opened", F.posexplode_outer(F.regexp_extract_all("part", F.lit("\n([^\r]*+)\r"), F.lit(1))).alias("nth", "raw_marker"))
    # what is read by forms is bound, so that it is read once
    kind, announced = _looked_up(F.col("word"), KINDS), _flat(F.col("verb"), rf"^\*{{0,2}}(?:{FUTURE})\s") | F.lower("word").isin(*ANNOUNCED)
    is_link, name = F.col("act").startswith("["), F.substring(F.substring_index("act", "]", 1), F.lit(2), F.length("act"))
    met = each.select(
        *note, kind.alias("kind"), announced.alias("announced"), F.when(is_link, name).otherwise(F.col("act")).alias("amending_act"),
        F.when(is_link, F.substring("act", F.length(name) + 4, F.length("act") - F.length(name) - 4)).alias("amending_act_ref"), "act_no", (F.col("opened") + F.col("nth") + 1).alias("span"),
        "raw_marker", _marker_body(F.col("raw_marker")).alias("body"),
    )
    dated = met.withColumn("form", _class(F.col("raw_marker"), F.col("body"), lambda body: F.lit("dated")))
    dated = dated.withColumn("valid_from", F.when(F.col("form") == "dated", _date(_written(F.col("body")))))
    known = F.when(F.col("form") != "dated", F.col("form")).when(F.col("valid_from").isNotNull(), "explicit_date").otherwise("unrecognised")
    told = dated.withColumn("marker_class", known)
    known = F.col("marker_class")
    commencement = F.when(known == "explicit_date", "dated").when(known == PENDING, PENDING).when(known.isin("relative", "unrecognised"), "ambiguous").otherwise("unknown")
    return told.select(
        key, "source_line", "provision", "scope", "kind", "announced", "amending_act", "amending_act_ref", "act_no", "span", "marker_class",
        commencement.alias("commencement_kind"),
        F.when(F.contains("raw_marker", F.lit("](")), F.nullif(F.regexp_extract("raw_marker", r"(?s)\[[^\]]*\]\(([^)]*)\)", 1), F.lit(""))).alias("commencement_instrument"),
        F.when(commencement == "unknown", "deterministically_derived").otherwise("source_explicit").alias("provenance"),
        "valid_from", "raw_marker", "source_note",
    )


def never_in_force(docs: DataFrame, key: str = "key") -> DataFrame:
    """Lines outside notes that say a provision was never brought into force: key, source_line, provision, text."""
    rows = lines_with_provision(docs, key).where(~F.col("line").startswith(">") & _flat(F.col("line"), NEVER_FORM))
    return rows.select(key, F.col("line_no").alias("source_line"), "provision", F.trim("line").alias("text"))


def problems(docs: DataFrame, key: str = "key") -> DataFrame:
    """What the notes leave open: key, source_line, provision, kind, raw_value.

    unrecognised_note, mixed_kind_note, marker_before_act, no_amending_act of a
    note; unrecognised_marker, non_commencement_marker, unlinked_act_reference,
    duplicate_event of an event (each after the first with one provision, act, date and kind).
    """
    found = notes(docs, key)
    note, out = [key, "source_line"], [key, "source_line", "provision", "kind", "raw_value"]
    is_head = F.col("note").rlike(HEAD)
    of_head = F.when(is_head, _looked_up(F.regexp_extract("note", HEAD, 3), KINDS))
    met = _read(found)
    verbs = F.regexp_extract_all("read", F.lit("\x1c([^\x1d]*+)\x1d"), F.lit(1))
    kinds = F.array_distinct(F.array_compact(F.concat(F.transform(verbs, lambda v: _looked_up(_word(v), KINDS)), F.array(of_head))))
    begin = F.substring_index("read", "\x0b", 1)
    names = [(~is_head, "unrecognised_note"), (F.size(kinds) > 1, "mixed_kind_note"), (F.contains(begin, F.lit("\n")), "marker_before_act"), (begin == F.col("read"), "no_amending_act")]
    kind = F.explode(F.array_compact(F.array(*(F.when(holds, name) for holds, name in names)))).alias("kind")
    of_notes = met.select(*note, "provision", kind, F.col("note").alias("raw_value"))
    made = events(docs, key)
    same = Window.partitionBy(key, "provision", F.coalesce("amending_act_ref", "amending_act"), "valid_from", "kind").orderBy("source_line", "act_no", "span")
    each = made.withColumn("again", F.row_number().over(same) > 1)
    act = F.coalesce("amending_act_ref", "amending_act")
    told = [
        (F.col("marker_class") == "unrecognised", "unrecognised_marker", F.col("raw_marker")), (F.col("marker_class") == "not_a_commencement_marker", "non_commencement_marker", F.col("raw_marker")),
        (F.col("amending_act_ref").isNull(), "unlinked_act_reference", F.col("amending_act")), (F.col("again"), "duplicate_event", act),
    ]
    rows = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(name).alias("kind"), value.alias("raw_value"))) for holds, name, value in told)))
    return of_notes.unionByName(each.select(*note, "provision", F.inline(rows)).select(*out))
