"""A Merkle manifest of a dataset: built bottom-up, with proofs pushed top-down.

Every row is a leaf. The leaves of a source, in order of their ids, are joined
in runs of ``FANOUT``, the runs' hashes again, and so on up to the source's
subroot; the subroots in order of their sources likewise give the root. Each
level is a table in the shared folder with one row per run: its children and
the text that their hashes make, so a level has a sixteenth of the rows of the
one below.

Proofs go down the same tables. A run meets what its node inherited from above
(the siblings on the way up to the root), and each child gets its own siblings
put before that. What is inherited is joined once per run, so next to the leaves
little more than the leaves themselves is shuffled.

Places in a source come from one range sort of small rows: within a task the
sorted place, plus the rows of the same source in the tasks before, summed from
one row per task and source. No source meets in one task.

Defined results: a null field is a dash in the leaf; an empty text is a text of
0 bytes; a null source is a source of its own, first in order; a null doc_id
comes first in its source and is not tampered with; rows that repeat are leaves
of their own, and as they hash alike their order does not matter; ids may be of any
ordered type that casts to text; further columns are not looked at, whatever
their names; a very long text is hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, written

FANOUT, HEX = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a row's number within its task (Spark's own), and every how many ids are tampered with.
TASK_BITS, TAMPERED = 33, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf_of(**instead: Column) -> Column:
    """The leaf of a row, with some fields replaced: every field with its length, so no two rows read alike."""

    def told(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(F.concat(*map(told, FIELDS)))


def source_key() -> Column:
    """Orders as sources do, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (a written table with sk) with ``pos`` by ``order`` in their sk and ``n``, the rows of that sk; and the largest n."""
    sorted_rows = rows.repartitionByRange("sk", *order).sortWithinPartitions("sk", *order)
    held = written(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted").withColumn("task", F.shiftright("at", TASK_BITS))
    each = held.groupBy("sk", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("sk").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    shifts = written(each.select("sk", "task", shift.alias("shift"), F.sum("rows").over(Window.partitionBy("sk")).alias("n")), "merkle-shifts")
    most = shifts.agg(F.max("n")).first()[0] or 0
    return held.join(shifts, ["sk", "task"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "task", "shift"), most


def runs_of(nodes: DataFrame) -> DataFrame:
    """One row per run of (sk, n, pos, hash, further columns): its nodes in order, and their hashes as one text."""
    kid = F.struct("pos", *(c for c in nodes.columns if c not in ("sk", "n", "pos")))
    run = F.shiftright("pos", FANOUT.bit_length() - 1).alias("run")
    met = nodes.groupBy("sk", "n", run).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    return met.withColumn("held", F.array_join(F.transform("kids", lambda k: k["hash"]), ""))


@dataclass
class Tree:
    """Written levels from the lowest up, and ``tops``: sk, level and hash of the one node that each sk ends in."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def built(leaves: DataFrame, most: int, path: str) -> Tree:
    """``leaves`` have sk, n, pos and hash; ``most`` is the largest n. Levels are written below ``path``."""
    spark = leaves.sparkSession
    nodes, levels, tops = leaves, [], []
    while True:
        tops.append(nodes.where("n = 1").select("sk", F.lit(len(levels)).alias("level"), "hash"))
        if most <= 1:
            break
        to = f"{path}/level-{len(levels)}"
        level = runs_of(nodes.where("n > 1"))
        level.write.parquet(to)
        levels.append(spark.read.schema(level.schema).parquet(to))
        up = F.floor((F.col("n") + (FANOUT - 1)) / FANOUT).cast("long")
        nodes = levels[-1].select("sk", up.alias("n"), F.col("run").alias("pos"), hashed(F.col("held")).alias("hash"))
        most = -(-most // FANOUT)
    all_tops = tops[0]
    for more in tops[1:]:
        all_tops = all_tops.unionByName(more)
    return Tree(leaves, levels, written(all_tops, "merkle-tops"))


def pushed(level: DataFrame, above: DataFrame) -> DataFrame:
    """The children of ``level`` with their proofs: their own siblings before what their parent in ``above`` inherited."""
    # proofs repeat and are far smaller as files than in memory, so a size told from files must not choose a broadcast
    met = level.join(above.withColumnRenamed("pos", "run").hint("merge"), ["sk", "run"])
    carried = [c for c in above.columns if c not in ("sk", "pos", "proof")]
    each = met.select("sk", "held", "proof", *carried, F.posexplode("kids").alias("nth", "kid"))
    own = F.struct(
        F.substring("held", F.lit(1), F.col("nth") * HEX).alias("before"), F.substring("held", (F.col("nth") + 1) * HEX + 1, F.lit(FANOUT * HEX)).alias("after")
    )
    return each.select("sk", "kid.*", F.concat(F.array(own), F.col("proof")).alias("proof"), *carried)


def proven(tree: Tree, tops: DataFrame) -> DataFrame:
    """Every leaf of the tree with its proof. ``tops`` has, per sk, the level of its top, the proof from there, and columns to carry down."""
    carried = [c for c in tops.columns if c not in ("sk", "level")]

    def ending_at(k: int) -> DataFrame:
        return tops.where(F.col("level") == k).select("sk", F.lit(0).cast("long").alias("pos"), *carried)

    above = ending_at(len(tree.levels))
    for k in reversed(range(len(tree.levels))):
        below = pushed(tree.levels[k], above)
        if k:
            above = written(below.select("sk", "pos", *carried).unionByName(ending_at(k)), "merkle-proofs")
        else:
            alone = tree.leaves.where("n = 1").drop("n").join(ending_at(0).drop("pos"), "sk")
            return below.unionByName(alone)
    return tree.leaves.drop("n").join(above.drop("pos"), "sk")


NO_PROOF = "CAST(array() AS array<struct<before: string, after: string>>)"


@dataclass
class Manifest:
    """The trees of the sources and the tree of their subroots, in written levels."""

    by_source: Tree
    over_sources: Tree

    def root(self) -> str | None:
        """The root's hash; none for an empty table."""
        held = self.over_sources.tops.first()
        return held and held["hash"]

    def proofs(self) -> DataFrame:
        """Every leaf row with subroot, root and proof: per level up to the root, the hashes before and after its own in the run."""
        root = self.over_sources.tops.select("sk", "level", F.expr(NO_PROOF).alias("proof"), F.col("hash").alias("root"))
        subroots = proven(self.over_sources, root).select(F.col("source_sk").alias("sk"), "level", "proof", F.col("hash").alias("subroot"), "root")
        return proven(self.by_source, written(subroots, "merkle-subroots"))


def manifest(leaves: DataFrame, path: str | None = None) -> Manifest:
    """Of leaf rows with doc_id, sk and hash, and any columns that proofs are to carry.

    The levels are kept below ``path``, a new folder of the shared one if none is given.
    """
    path = path or f"{shared_dir(leaves.sparkSession)}/merkle-{uuid.uuid4().hex}"
    rows = written(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")  # rows that repeat part at "row"
    by_id, most = placed(rows, ["doc_id", "hash", "row"])
    by_source = built(by_id.drop("row"), most, f"{path}/sources")
    subroots = by_source.tops.select(F.lit("").alias("sk"), F.col("sk").alias("source_sk"), "level", "hash")
    sources, most = placed(subroots, ["source_sk"])
    return Manifest(by_source, built(sources, most, f"{path}/root"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: hashed(F.concat(s["before"], h, s["after"])))


def proof_digest(proof: Column) -> Column:
    return hashed(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def tampered(docs: DataFrame) -> DataFrame:
    """Leaf rows, with ``told``: the leaf again, from a lower-cased text where the id says so."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPERED == 0
    told = F.when(chosen, leaf_of(text=F.translate(F.col("text").cast("string"), UPPER, LOWER)))
    return docs.select("doc_id", source_key().alias("sk"), leaf_of().alias("hash"), told.alias("told"))


def verified(docs: DataFrame) -> DataFrame:
    """Every document with its place in the manifest, and whether what it is now still leads to the root."""
    rows = manifest(tampered(docs)).proofs().withColumn("folded_root", folded(F.coalesce("told", "hash"), F.col("proof")))
    return rows.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(documents(spark, sf_dir))


#: Levels that the SQL unrolls: enough for 16 ** 7 documents of a source, and as many sources.
SQL_LEVELS = 7


def _sql() -> str:
    def field(value: str) -> str:
        return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(f"CAST({c} AS VARCHAR)") for c in FIELDS[:-1]) + f" || {field(text)})"

    def tree(name: str, leaves: str) -> str:
        """``{name}k`` are the nodes of level k, ``{name}r`` the runs' texts of all levels."""
        out = f", {name}0 AS ({leaves})"
        for k in range(SQL_LEVELS):
            out += f""", {name}r{k} AS (SELECT sk, pos // 16 AS run, any_value(n) AS n, string_agg(hash, '' ORDER BY pos) AS held FROM {name}{k} WHERE n > 1 GROUP BY sk, pos // 16)
            , {name}{k + 1} AS (SELECT sk, run AS pos, (n + 15) // 16 AS n, sha256(held) AS hash FROM {name}r{k})"""
        tops = " UNION ALL ".join(f"SELECT sk, hash FROM {name}{k} WHERE n = 1" for k in range(SQL_LEVELS + 1))
        return out + f", {name}top AS ({tops})"

    def climb(frm: str, name: str, key: str, pos: str) -> str:
        """Row by row up the levels of a tree: the siblings so far and the folded hash."""
        out = ""
        for k in range(SQL_LEVELS):
            at = f"64 * (p // {16**k} % 16)"
            before, after = f"coalesce(substr(held, 1, {at}), '')", f"coalesce(substr(held, {at} + 65), '')"
            out += f""", {frm}{name}{k} AS (SELECT u.* EXCLUDE (proof, folded), proof || {before} || {after} AS proof,
              CASE WHEN held IS NULL THEN folded ELSE sha256({before} || folded || {after}) END AS folded
              FROM {f'(SELECT *, {pos} AS p, {key} AS k_ FROM {frm})' if k == 0 else f'{frm}{name}{k - 1}'} u LEFT JOIN {name}r{k} r ON r.sk = u.k_ AND r.run = p // {16 ** (k + 1)})"""
        return out

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = """xor(list_reduce(list_prepend(4294967295, flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""
    return (
        f"""WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS sk, {leaf('text')} AS hash,
          CASE WHEN doc_id IS NOT NULL AND CAST({crc} AS BIGINT) % {TAMPERED} = 0 THEN {leaf(lowered)} END AS told FROM documents)"""
        + tree("s", "SELECT *, row_number() OVER (PARTITION BY sk ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY sk) AS n FROM d")
        + tree("t", "SELECT '' AS sk, sk AS source_sk, hash, row_number() OVER (ORDER BY sk) - 1 AS pos, count(*) OVER () AS n FROM stop")
        + ", a AS (SELECT s0.doc_id, s0.sk, s0.hash, pos, coalesce(told, hash) AS folded, '' AS proof FROM s0)"
        + climb("a", "s", "sk", "pos")
        + f", b AS (SELECT x.doc_id, x.hash, x.proof, x.folded, t0.pos AS at_, t0.hash AS subroot FROM as{SQL_LEVELS - 1} x JOIN t0 ON t0.source_sk = x.sk)"
        + climb("b", "t", "''", "at_")
        + f""" SELECT doc_id, x.hash AS leaf, subroot, ttop.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = ttop.hash AS verified
          FROM bt{SQL_LEVELS - 1} x, ttop"""
    )


OP11_SQL = _sql()
