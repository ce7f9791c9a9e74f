"""Merkle manifest: trees over concatenated levels, with a proof for every row.

Rows become leaves (hashes of their columns), ordered by key within their group; every three consecutive nodes make a
parent until one is left. A block of 3 ** LEVELS consecutive leaves keeps each of its levels as one hex string. Parents
are hashes of fixed-width substrings of the level below, and a leaf's siblings are the substrings that flank it, so a
block's hashing is one expression over one row. Block roots are the leaves of the next round, of which there are
log_729(rows); the groups' roots, ordered by group, are the leaves of one more tree. On the way down each block gets
the siblings of its root by a join on (group, block), which is unique on both sides, so that no group is hot.

Places within a group come from one range partitioning of (group, key, leaf): a row's place is its index in its
partition, plus what the partitions before hold of the group. No window or task sees a whole group. Nothing goes through
the driver but the number of rows and the largest group's size.

Defined results: null values are hashed as ``-``, and a null group is a group of its own, the first; null keys come
first; rows with equal keys are ordered by their leaves; repeated rows are leaves of their own; an empty or very long text
is hashed whole like any other; an empty table gives an empty result; columns that aren't named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

LEVELS = 6  # of a block: 729 leaves, 70 KB of hashes
ROWS_EACH = 200_000  # of a range when rows are put in order
_HEX = 64


def field(value: str | Column) -> Column:
    """How a value goes into a leaf: ``-`` if null, else its UTF-8 byte count, a colon, and itself."""
    value = (F.col(f"`{value}`") if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*values: str | Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its siblings."""
    return F.aggregate(path, leaf.cast("binary"), lambda node, p: F.sha2(F.concat(p.left, node, p.right), 256).cast("binary")).cast("string")


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p.left, p.right).cast("string")), "").cast("binary"), 256)


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / (3 * _HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * 3 * _HEX + 1, F.lit(3 * _HEX)), 256)), "").cast("binary")


def _levels(leaves: Column, whole: Column, levels: int) -> Column:
    """All levels of a block: up to its one root if it is a whole tree, else exactly so many."""

    def higher(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(whole & (F.octet_length(last) == _HEX), done).otherwise(F.concat(done, F.array(_parents(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(leaves), higher)


def _siblings(levels: Column, index: Column) -> Column:
    """For the leaf at index, what flanks it and its ancestors in their runs of three, level by level."""

    def flanks(level: Column, j: Column) -> Column:
        at = F.floor(index / F.pow(F.lit(3.0), j)).cast("int")
        return F.struct(
            F.substring(level, (at - at % 3) * _HEX + 1, at % 3 * _HEX).alias("left"),
            F.substring(level, (at + 1) * _HEX + 1, (2 - at % 3) * _HEX).alias("right"),
        )

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), flanks)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with a group g) and each one's place in its group, from 0, and the group's size: pos, total."""
    ranges = max(1, -(-rows.count() // ROWS_EACH))
    dealt = rows.repartitionByRange(ranges, "g", *order).sortWithinPartitions("g", *order)
    ordered = written(dealt.withColumn("m", F.monotonically_increasing_id()), "manifest-order")
    ordered = ordered.withColumn("p", F.shiftright("m", 33))  # the partition; the rest of m is the index there
    parts = ordered.groupBy("g", "p").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("g", "p", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    return ordered.join(starts, ["g", "p"]).withColumn("pos", F.col("m") + F.col("shift")).drop("m", "p", "shift")


def _blocks(rows: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """One row a block of consecutive leaves: g, block, total, what is carried of each leaf, all levels."""
    width = 3**levels
    packed = F.sort_array(F.collect_list(F.struct("pos", "leaf", *carried)))
    grouped = rows.groupBy("g", F.floor(F.col("pos") / width).alias("block")).agg(packed.alias("rows"), F.first("total").alias("total"))
    leaves = F.array_join(F.transform("rows", lambda r: r.leaf), "").cast("binary")
    held = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ["pos", *carried])))
    return written(grouped.select("g", "block", "total", held.alias("rows"), _levels(leaves, F.col("total") <= width, levels).alias("levels")), "manifest-blocks")


def _tree(rows: DataFrame, carried: list[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tree of every group: blocks by rounds, from the leaves up, and each group's root as (g, leaf)."""
    width, rounds = 3**levels, [_blocks(rows, carried, levels)]
    largest = rounds[0].agg(F.max("total")).first()[0] or 0
    while True:
        tops = rounds[-1].select("g", F.col("block").alias("pos"), F.element_at("levels", -1).cast("string").alias("leaf"), F.ceil(F.col("total") / width).alias("total"))
        if largest <= width:
            return rounds, tops.select("g", "leaf")
        largest = -(-largest // width)
        rounds.append(_blocks(tops, [], levels))


def _down(rounds: list[DataFrame], tops: DataFrame, kept: list[str]) -> DataFrame:
    """Every leaf with its path to the root: g, leaf, path, what its row carries, and the columns kept of tops (g, path)."""
    above = tops.select("g", F.lit(0).cast("long").alias("block"), F.col("path").alias("up"), *kept)
    for blocks in reversed(rounds):
        joined = blocks.join(above, ["g", "block"])
        each = F.transform(
            "rows",
            lambda r, i: F.struct(
                F.substring(F.element_at("levels", 1), i * _HEX + 1, F.lit(_HEX)).cast("string").alias("leaf"),
                _siblings(F.col("levels"), i).alias("inner"),
                r.alias("row"),
            ),
        )
        rows = joined.select("g", "up", *kept, each.alias("each")).select("g", "up", *kept, F.inline("each"))
        found = rows.select("g", "leaf", F.concat("inner", "up").alias("path"), *kept, "row.*")
        above = found.withColumnsRenamed({"pos": "block", "path": "up"})
    return found.drop("pos")


def manifest(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """For each row: key, group, leaf, path (siblings as array of left and right, from the leaf up), subroot, root, and the columns to carry."""
    carry = carry or {}
    g = F.when(F.col(f"`{group}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")))  # null first
    names = [f"c{i}" for i in range(len(carry))]
    leaves = docs.select(g.alias("g"), F.col(f"`{key}`").alias("k"), leaf_hash(*fields).alias("leaf"), *(c.alias(n) for n, c in zip(names, carry.values(), strict=True)))
    rows = _placed(written(leaves.withColumn("tie", F.monotonically_increasing_id()), "manifest-leaves"), "k", "leaf", "tie")
    rounds, subroots = _tree(rows, ["k", *names], levels)
    top_rounds, root = _tree(_placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("s"), "leaf"), "s"), ["s"], levels)
    none = F.slice(F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))), 1, 0)
    tops = _down(top_rounds, root.select("g", none.alias("path"), F.col("leaf").alias("root")), ["root"])
    found = _down(rounds, tops.select(F.col("s").alias("g"), "path", F.col("leaf").alias("subroot"), "root"), ["subroot", "root"])
    own = F.when(F.substring("g", 1, 1) == "1", F.substring(F.col("g"), F.lit(2), F.length("g"))).alias(group)
    return found.select(F.col("k").alias(key), own, "leaf", "path", "subroot", "root", *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)))


def verified(docs: DataFrame, fields: list[str], altered: list[str | Column], changed: Column, group: str = "source", key: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """The manifest of docs, and whether each row still leads to the root where its values, if changed holds, are those of altered.

    Columns: key, group, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    other = F.when(changed, leaf_hash(*altered))
    found = manifest(docs, fields, group, key, {"now": other}, levels)
    after = found.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return after.select(key, group, "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _sql_leaf(*values: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, values)) + ")"


def _sql_tree(tree: str, rows: str, start: str) -> str:
    """CTEs: the tree over rows (s, pos, h, n), nodes with what flanks them, and what start (id, s, pos, acc) folds to."""
    flank = "partition by s, lvl, pos // 3 order by pos"
    return f"""
    {tree}(s, lvl, pos, h, n) AS (
        SELECT s, 0, pos, h, n FROM {rows}
        UNION ALL
        SELECT s, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
        FROM {tree} WHERE n > 1 GROUP BY s, lvl, pos // 3
    ),
    {tree}_flanked AS (
        SELECT s, lvl, pos, n,
            coalesce(lag(h, 2) OVER ({flank}), '') || coalesce(lag(h) OVER ({flank}), '') AS l,
            coalesce(lead(h) OVER ({flank}), '') || coalesce(lead(h, 2) OVER ({flank}), '') AS r
        FROM {tree}
    ),
    {tree}_up(id, s, lvl, pos, acc, sibs) AS (
        SELECT id, s, 0, pos, acc, '' FROM {start}
        UNION ALL
        SELECT u.id, u.s, u.lvl + 1, u.pos // 3, sha256(f.l || u.acc || f.r), u.sibs || f.l || f.r
        FROM {tree}_up u JOIN {tree}_flanked f ON u.s = f.s AND u.lvl = f.lvl AND u.pos = f.pos WHERE f.n > 1
    ),
    {tree}_end AS (
        SELECT u.id, u.s, u.acc, u.sibs FROM {tree}_up u
        JOIN {tree}_flanked f ON u.s = f.s AND u.lvl = f.lvl AND u.pos = f.pos WHERE f.n = 1
    )"""


#: crc32 of the decimal id, bit by bit.
_SQL_CRC = """xor(list_reduce(
        list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))
    ), 4294967295::UBIGINT)"""

ORACLE = f"""
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS s,
        {_sql_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
        CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_leaf("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS other
    FROM documents
),
leaves AS (
    SELECT *, leaf AS h, coalesce(other, leaf) AS acc, count(*) OVER (PARTITION BY s) AS n,
        row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM hashed
),
{_sql_tree("low", "leaves", "leaves")},
subroots AS (
    SELECT '' AS s, t.s AS id, row_number() OVER (ORDER BY t.s) - 1 AS pos, h, h AS acc, count(*) OVER () AS n FROM low t WHERE n = 1
),
folds AS (
    SELECT e.id, '' AS s, r.pos, e.acc, e.sibs FROM low_end e JOIN subroots r ON e.s = r.id
),
{_sql_tree("high", "subroots", "folds")}
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(f.sibs || e.sibs) AS proof_sha256, e.acc AS folded_root, e.acc = t.h AS verified
FROM leaves l JOIN folds f ON l.id = f.id JOIN high_end e ON l.id = e.id JOIN subroots r ON l.s = r.id, high t
WHERE t.n = 1
"""
