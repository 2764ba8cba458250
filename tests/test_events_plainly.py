"""Amendment events of random notes, held against a plain reading of each; what the plan reads and how often."""

import random
import re

from folioscope.operators import events

LINK = r"\[[^\]]*\]\([^)]*\)"
WORDS = {"endret": "amended", "Oppheves": "repealed", "føyd  til": "inserted", "tilføyd": "inserted"}
VERB = rf"(?i)\*{{0,2}}(?:(?:Vert|Blir|Vil\s+bli)\s+)?(?:{'|'.join(w.replace('  ', r'\s+') for w in WORDS)})\*{{0,2}}(?:\s+i\s+sin\s+helhet)?\s+(?:ved|med)\b"
ACT = r"(?i)\b\d{1,2}\s+[a-zæøå]+\.?\s+(?:19|20)\d{2}\s+nr\.\s*\d+"


def plainly(note):
    """(act, kind, markers) of a note, letter by letter."""
    at, found, opened, unclosed = 0, [], [], None
    while at < len(note):
        for kind, form in (("link", LINK), ("verb", VERB), ("act", ACT), ("open", r"\("), ("close", r"\)")):
            if hit := re.compile(form).match(note, at):
                break
        end = hit.end() if hit else at + 1
        found.append((kind if hit else "text", note[at:end]))
        at = end
    depth, spans = 0, {}
    for k, (kind, _) in enumerate(found):
        if kind == "open":
            opened, depth = ([k] if not depth else opened), depth + 1
        elif kind == "close" and depth:
            depth -= 1
            if not depth:
                spans[opened[0]] = k
    out, verb, k = [], None, 0
    while k < len(found):
        kind, piece = found[k]
        if k in spans:
            if out:
                out[-1][2].append("".join(p for _, p in found[k : spans[k] + 1]))
            k = spans[k]
        elif kind == "verb":
            verb = next(v for w, v in WORDS.items() if re.search(w.replace("  ", r"\s+"), piece, re.I))
        elif kind == "act" or (kind == "link" and piece[piece.index("](") + 2 :].startswith("lov/")):
            out.append((piece, verb, []))
        k += 1
    return out


def test_events_equal_a_plain_reading(spark):
    """every piece of a note was gone through one by one, in rows of nine fields, by each act again."""
    draw = random.Random(5)
    bits = [
        "(", "(", ")", ")", "endret ved ", "**Oppheves** i sin helhet ved", "Vil bli føyd  til med", "tilføyd vedtatt", "uendret med", "[a (b](lov/1)", "[endret ved)](LOV/2)", "[c](forskrift/3) ", "3 mai 1990 nr. 7",
        "13 mai 1990 nr.", "[", "](lov/", "*", "ikr. 1 juni 1991", ", ", " ", "lov", "\x1f", "0", "[x](lov/4)", " og (se (§ 2) 4 juni 1992 nr. 8) ",
    ]
    notes = {k: "Endret ved " + "".join(draw.choice(bits) for _ in range(draw.randrange(30))) for k in range(400)} | {900: "Endret ved (", 901: "Endret ved lov " + "[x](lov/4) (a) (b), " * 300}
    # a note's second line begins with what follows a blank
    docs = spark.createDataFrame([(k, f"## Kapittel 1. A  \r\n>\n> {n.replace(' og ', chr(10) + '> og ')}") for k, n in notes.items()], "key long, text string")
    told = events.events(docs)
    got = {}
    for r in told.collect():
        got.setdefault(r.key, []).append((r.act_no, r.span or 0, r.amending_act, r.amending_act_ref, r.kind, r.raw_marker))
        assert (r.source_line, r.provision, r.source_note) == (3, "Kapittel 1. A", notes[r.key].replace(" og ", " og "))
    for k, note in notes.items():
        want = []
        for n, (act, kind, markers) in enumerate(plainly(note)):
            said, ref = re.fullmatch(r"(?s)\[([^\]]*)\]\(([^)]*)\)", act).groups() if act[0] == "[" else (act, None)
            want += [(n + 1, said, ref, kind, m) for m in markers or [None]]
        assert [(a, *rest) for a, _, *rest in sorted(got.get(k, []), key=lambda row: row[:2])] == want, note
    # a form is read for a note, an act or a marker, not for each piece
    assert told._jdf.queryExecution().executedPlan().toString().count("helhet") <= 2


def test_orders_are_dealt_to_all_tasks(spark, smoke_dir):
    """F1: the texts of 60 times sf0.1 fell to 16 tasks, by their bytes, for some 2800 CPU seconds of work."""
    from folioscope.plans import register

    assert "REPARTITION_BY_NUM" in register.QUERIES["amendment_events"](spark, smoke_dir)._jdf.queryExecution().executedPlan().toString()
