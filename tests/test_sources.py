"""The sidecar format and the cursor over an appended log."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from folioscope.sources import sidecar
from folioscope.streaming import log_source

# --- sidecars ---------------------------------------------------------------------------------


def held_rows(rng, slugs=20):
    out = []
    for k in range(slugs):
        dim, space = rng.choice([3, 8]), rng.choice([None, "0123456789abcdef" * 2])
        scale = struct.unpack("<f", struct.pack("<f", rng.random()))[0]
        out += [(f"doc-{k}", n, f"§ {n}" if n else "é" * 60, [rng.randrange(-127, 128) for _ in range(dim)], scale, space) for n in range(rng.randrange(1, 6))]
    return out


OF = "slug string, place int, section_id string, vector array<tinyint>, scale float, space_id string"


def test_what_is_written_is_read(spark, tmp_path):
    rows = held_rows(random.Random(1))
    df = spark.createDataFrame(rows, OF).repartition(5)
    sidecar.write(df, str(tmp_path / "a"))
    got = sidecar.read(spark, str(tmp_path / "a"), taskBytes="200")
    assert got.rdd.getNumPartitions() > 3
    assert sorted((r.slug, r.place, r.section_id, r.vector, r.scale, r.space_id) for r in got.collect()) == sorted(rows)
    assert {(r.version, r.problem) for r in got.where("space_id IS NULL").collect()} == {(1, None)} and got.where("space_id IS NOT NULL AND version = 2").count() > 0
    first = {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir()}
    sidecar.write(df.repartition(2), f"file://{tmp_path}/b")
    assert first == {p.name: p.read_bytes() for p in (tmp_path / "b").iterdir()} and len(first) == 20
    sidecar.write(df.where("slug = 'doc-3'"), str(tmp_path / "a"), "overwrite")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["doc-3.bin"]
    assert sidecar.read(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_a_row(spark, tmp_path):
    good = sidecar.encoded([("a", b"\x01\x02"), ("b", b"\x03\xff")], 0.5, 2, "ab" * 16)
    files = {
        "good": good, "short": good[:9], "magic": b"XXXX" + good[4:], "later": good[:4] + b"\x03" + good[5:], "head": good[:20], "body": good[:36], "id": good[:-4] + b"\xf0" + good[-3:],
        "vector": good[:-1], "more": good + b"\x00", "utf8": good.replace(b"\x01a", b"\x01\xff"), "none": sidecar.encoded([], 0.5, 2),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    (tmp_path / "other.txt").write_text("no sidecar")
    rows = sidecar.read(spark, str(tmp_path)).collect()
    assert {r.slug: r.problem for r in rows if r.problem} == {
        "short": "too_short", "magic": "bad_magic", "later": "unsupported_version", "head": "truncated_header", "body": "truncated_body", "id": "truncated_id", "vector": "truncated_vector",
        "more": "trailing_bytes", "utf8": "invalid_id",
    }
    assert [(r.slug, r.section_id, r.vector, r.scale) for r in rows if not r.problem] == [("good", "a", [1, 2], 0.5), ("good", "b", [3, -1], 0.5)]


@pytest.mark.parametrize("row", [("x", 0, "", [1], 0.5, None), ("x", 0, "a" * 256, [1], 0.5, None), ("x", 0, "a", [1], 0.5, "abc"), ("doc-0", 9, "a", [1], 9.5, None)])
def test_a_failed_write_leaves_nothing(spark, tmp_path, row):
    df = spark.createDataFrame([*held_rows(random.Random(2)), row], OF)
    with pytest.raises(Exception):
        sidecar.write(df, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


# --- the log ----------------------------------------------------------------------------------------


def folded(spark, log, tmp_path):
    """Lines by key, earliest value; returns what the newest version holds."""
    def fold(lines):
        told = lines.select(F.from_json("line", "k string, v long, corrects string").alias("x")).select("x.*")
        gone = told.where("corrects IS NOT NULL").select(F.col("corrects").alias("k")).distinct()
        return told.where("corrects IS NULL").join(gone, "k", "left_anti").groupBy("k").agg(F.min("v").alias("v"))

    def merge(before, new):
        return before.unionByName(new).groupBy("k").agg(F.min("v").alias("v"))

    stream = log_source.followed(spark, str(log), corrections='"corrects"', taskBytes="64")
    log_source.write_folded(stream, fold, merge, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination(120)
    return {r.k: r.v for r in log_source.read_folded(spark, str(tmp_path / "out")).collect()}


def test_cursor_follows_appends_and_rebuilds_after_changes(spark, tmp_path):
    log = tmp_path / "log"

    def add(*rows, text=""):
        with log.open("a") as file:
            file.write("".join(json.dumps(r) + "\n" for r in rows) + text)

    add(*({"k": f"k{n % 7}", "v": 100 + n} for n in range(40)))
    assert folded(spark, log, tmp_path) == {f"k{n}": 100 + n for n in range(7)}
    add({"k": "k1", "v": 5}, {"k": "new", "v": 6}, text='{"k": "half')  # a line that is still being written
    want = {f"k{n}": 100 + n for n in range(7)} | {"k1": 5, "new": 6}
    assert folded(spark, log, tmp_path) == want
    add(text='", "v": 7}\n')
    assert folded(spark, log, tmp_path) == want | {"half": 7}
    add({"corrects": "k2"})  # takes back lines that were read before
    want = {k: v for k, v in (want | {"half": 7}).items() if k != "k2"}
    assert folded(spark, log, tmp_path) == want
    n = len(list((tmp_path / "out").glob("version=*")))
    assert folded(spark, log, tmp_path) == want and len(list((tmp_path / "out").glob("version=*"))) == n  # nothing new
    log.write_text(log.read_text().replace('"v": 5', '"v": 1'))  # the same length, other bytes
    add({"k": "last", "v": 2})
    assert folded(spark, log, tmp_path) == want | {"k1": 1, "last": 2}
    log.write_text('{"k": "only", "v": 3}\n')
    assert folded(spark, log, tmp_path) == {"only": 3}


def test_stretches_hold_every_line_once(tmp_path):
    rng = random.Random(3)
    for case in range(30):
        lines = ["x" * rng.randrange(12) for _ in range(rng.randrange(15))]
        log = tmp_path / f"log{case}"
        log.write_text("".join(line + "\n" for line in lines) + "open" * rng.randrange(2))
        reader = log_source.LogReader(str(log), None, rng.randrange(1, 20))
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
        assert [r[1] for r in rows] == lines and end["position"] == sum(map(len, lines)) + len(lines)
        assert [r[0] for r in rows] == [sum(map(len, lines[:n])) + n for n in range(len(lines))]
