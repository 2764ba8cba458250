"""Amendment events of literal notes."""

import datetime

import pytest

from folioscope.operators import events

TEXT = """# Lov om ting
> Endra ved lov [1 jan 2001 nr. 2](lov/2001-01-01-2).

## Kapittel 1. Innledning

> **Kapitlet endret** ved lover [3 mai 1990 nr. 7](lov/1990-05-03-7) (ikr. 1 juni 1991 iflg. [res](forskrift/1991-1)), 4 juni 1992 nr. 8,
> [5 juli 1993 nr. 9](lov/1993-07-05-9) (i kraft 1. sept. 1993, unntatt § 3) (ikr. 31 februar 1994).

### § 1. Noe

Tekst endres ved behov. Ikke satt i kraft.
>
> Vert endra ved lov [6 aug 2020 nr. 1](lov/2020-08-06-1) (i kraft frå den tid Kongen fastset), tilføyd med lov [a](lov/b) (samtidig som x, ikr. samtidig med [y](lov/z) 2 mai 2000).
>
> fortsatt (se [v](lov/w))
### § 2
> Opphevet ved lov [c](lov/d) (uklart (1 mai 2001)) og [e](forskrift/f).
> uendret ved lov
plain
> Se også lov 3 mai 1990 nr. 7 (ikr. straks).
### §§ 3 - 4
> Oppheves i sin helhet ved lov [g](lov/h) (ikr. straks)) og lov [g](lov/h) (
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "> "), (5, ">x\n> Endret\n> ved lov 1 mai 1999 nr. 1")], "key long, text string")


def test_notes_are_blocks_under_their_provision(docs):
    got = {(r.key, r.source_line): (r.provision, r.note) for r in events.notes(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        (1, 2): "(document)", (1, 6): "Kapittel 1. Innledning", (1, 13): "§ 1", (1, 17): "§ 2", (1, 20): "§ 2", (1, 22): "§§ 3 - 4", (4, 1): "(document)", (5, 2): "(document)",
    }
    assert got[1, 13][1].endswith("2 mai 2000).  fortsatt (se [v](lov/w))") and got[4, 1][1] == "" and got[5, 2][1] == "Endret ved lov 1 mai 1999 nr. 1"


def test_events_pair_acts_with_verbs_and_markers(docs):
    rows = events.events(docs).collect()
    got = sorted((r.key, r.source_line, r.act_no, r.span or 0, r.scope, r.kind, r.announced, r.amending_act, r.amending_act_ref, r.marker_class, r.valid_from) for r in rows)
    day = datetime.date
    assert got == [
        (1, 2, 1, 0, "provision", "amended", False, "1 jan 2001 nr. 2", "lov/2001-01-01-2", "absent", None),
        (1, 6, 1, 1, "chapter", "amended", False, "3 mai 1990 nr. 7", "lov/1990-05-03-7", "explicit_date", day(1991, 6, 1)),
        (1, 6, 2, 0, "chapter", "amended", False, "4 juni 1992 nr. 8", None, "absent", None),
        (1, 6, 3, 2, "chapter", "amended", False, "5 juli 1993 nr. 9", "lov/1993-07-05-9", "explicit_date", day(1993, 9, 1)),
        (1, 6, 3, 3, "chapter", "amended", False, "5 juli 1993 nr. 9", "lov/1993-07-05-9", "unrecognised", None),
        (1, 13, 1, 1, "provision", "amended", True, "6 aug 2020 nr. 1", "lov/2020-08-06-1", "pending_indeterminate", None),
        (1, 13, 2, 2, "provision", "inserted", False, "a", "lov/b", "relative", None),
        (1, 13, 2, 3, "provision", "inserted", False, "a", "lov/b", "not_a_commencement_marker", None),
        (1, 17, 1, 1, "provision", "repealed", False, "c", "lov/d", "not_a_commencement_marker", None),
        (1, 22, 1, 1, "provision", "repealed", True, "g", "lov/h", "unrecognised", None),
        (1, 22, 2, 0, "provision", "repealed", True, "g", "lov/h", "absent", None),
        (5, 2, 1, 0, "provision", "amended", False, "1 mai 1999 nr. 1", None, "absent", None),
    ]
    by = {(r.source_line, r.act_no, r.span): r for r in rows if r.key == 1}
    assert by[6, 1, 1].raw_marker == "(ikr. 1 juni 1991 iflg. [res](forskrift/1991-1))" and by[6, 1, 1].commencement_instrument == "forskrift/1991-1"
    assert [by[k].commencement_kind for k in ((6, 1, 1), (6, 3, 3), (13, 1, 1), (13, 2, 3))] == ["dated", "ambiguous", "pending_indeterminate", "unknown"]
    assert {r.provenance for r in rows if r.marker_class == "absent"} == {"deterministically_derived"}


def test_never_in_force_and_problems(docs):
    assert [tuple(r) for r in events.never_in_force(docs).collect()] == [(1, 11, "§ 1", "Tekst endres ved behov. Ikke satt i kraft.")]
    got = sorted((r.key, r.source_line, r.kind) for r in events.problems(docs).collect())
    assert got == sorted([
        (1, 6, "unlinked_act_reference"), (1, 6, "unrecognised_marker"), (1, 13, "duplicate_event"), (1, 13, "mixed_kind_note"), (1, 13, "non_commencement_marker"), (1, 17, "mixed_kind_note"), (1, 17, "non_commencement_marker"),
        (1, 20, "unrecognised_note"), (1, 22, "unrecognised_marker"), (1, 22, "duplicate_event"), (4, 1, "unrecognised_note"), (4, 1, "no_amending_act"), (5, 2, "unlinked_act_reference"),
    ])
