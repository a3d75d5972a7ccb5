"""Shards by a weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from .order import running
from .registry import query, table

# Repeats of one row that one task writes out at a time.
REPEATS = 65_536


@dataclass(frozen=True)
class Tree:
    """Leaves as (region, rack, shard, weight); a rack weighs what its shards weigh, a region what its racks do."""
    leaves: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def of(*regions: tuple[int, ...]) -> Tree:
        """Shards of weight 1, numbered on: each region is given by the sizes of its racks."""
        leaves, rack, shard = [], 0, 0
        for region, racks in enumerate(regions):
            for size in racks:
                leaves += [(region, rack, shard + k, 1.0) for k in range(size)]
                rack, shard = rack + 1, shard + size
        return Tree(tuple(leaves))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a rack and region of its own.

        No other subtree changes its weight, so the only draws that change are those of the new
        region, and it has no other shard: rows go into the new shard or stay.
        """
        region, rack, shard = (max(leaf[k] for leaf in self.leaves) + 1 for k in range(3))
        return Tree((*self.leaves, (region, rack, shard, weight)))

    def levels(self) -> list[dict[int, list[tuple[int, float]]]]:
        """For each level the children of every node of the level above, with their weights."""
        out: list[dict[int, dict[int, float]]] = [{}, {}, {}]
        for region, rack, shard, weight in self.leaves:
            for level, (above, node) in enumerate(((-1, region), (region, rack), (rack, shard))):
                of = out[level].setdefault(above, {})
                of[node] = of.get(node, 0.0) + weight
        return [{above: sorted(of.items()) for above, of in level.items()} for level in out]


def _drawn(key: Column, level: int, above: Column | None, children: dict[int, list[tuple[int, float]]]) -> Column:
    """The child with the highest draw: the logarithm of a hashed number between 0 and 1, over the child's weight.

    A child's draw depends on the key, itself and its own weight only, so a changed weight moves rows to
    or from that child alone, in proportion to the change.
    """
    choices = {a: F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in of]) for a, of in children.items()}
    here = choices[-1] if above is None else F.create_map(*[x for a, of in choices.items() for x in (F.lit(a), of)])[above]

    def draw(child: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(level)), child["node"].cast("string"))), 1, 13), 16, 10).cast("double")
        return F.struct((F.log((number + 0.5) / float(1 << 52)) / child["weight"]).alias("draw"), child["node"].alias("node"))
    return F.array_max(F.transform(here, draw))["node"]


def descend(rows: DataFrame, key: Column, tree: Tree, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """``rows`` with the region, rack and shard to which ``key`` (a string; null is ``-``) goes down the tree.

    Each level is one expression over its node's children, so a row costs the sum of the fan-outs
    and the plan has no join or shuffle.
    """
    key, above = F.coalesce(key.cast("string"), F.lit("-")), None
    for level, (name, children) in enumerate(zip(names, tree.levels())):
        rows = rows.withColumn(name, _drawn(key, level, above, children))
        above = F.col(name)
    return rows


def place(docs: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of each row of (doc_id, text).

    The shard follows from ``doc_id`` and the tree; ``grown_shard`` is the one in the tree with
    one more shard.  Slots number a shard's rows from 0 in order of doc_id (null last), crc and
    size.  They come from one range sort of all rows by shard and id, so a shard of any size is
    spread over tasks, and only (doc_id, size, crc) is shuffled, never a text.

    A null text has no bytes (size 1, crc 0), as an empty one.  Null ids are one key.  Rows
    that are the same in doc_id and text are counted before the shuffle and get slots one after
    another.  An empty table gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = bare.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    again = F.col("_n") > REPEATS
    lots = F.when(again, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / REPEATS))).otherwise(F.array(F.lit(0).cast("bigint")))
    key = F.col("doc_id")
    placed = descend(counted.withColumn("_lot", F.explode(lots)), key, tree, ("_region", "_rack", "shard"))
    placed = descend(placed, key, tree.grown(), ("_region", "_rack", "grown_shard")).withColumn("_n", F.least(F.lit(REPEATS), F.col("_n") - F.col("_lot") * REPEATS))
    placed = cut(placed.drop("_region", "_rack"))
    through = running(placed, [F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size"), F.col("_lot")], {"_through": "_n"})
    # One row a shard of the tree, so the window and the broadcast are bounded.
    starts = placed.groupBy("shard").agg(F.sum("_n").alias("_rows")).select(
        "shard", F.coalesce(F.sum("_rows").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    first = F.col("_through") - F.col("_n") - F.col("_start")
    return through.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"), "grown_shard")


# 16 shards in three regions of 7, 6 and 3.
TREE = Tree.of((4, 3), (4, 2), (3,))

_LEAVES = ", ".join(f"({g}, {r}, {s}, {w})" for g, r, s, w in TREE.grown().leaves)
# The draws as SQL; the polynomial is that of CRC-32.
SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT b::BIGINT AS byte, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
bytes AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
sized AS MATERIALIZED (
  SELECT row_number() OVER () AS rw, doc_id, coalesce(doc_id::VARCHAR, '-') AS key, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
                                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM documents, bytes),
grown(region, rack, shard, weight) AS (VALUES {_LEAVES}),
trees AS (SELECT 'grown_shard' AS tree, * FROM grown UNION ALL SELECT 'shard', * FROM grown WHERE shard < 16),
nodes AS (
  SELECT tree, 0 AS level, -1 AS above, region AS node, sum(weight) AS weight FROM trees GROUP BY tree, region
  UNION ALL SELECT tree, 1, region, rack, sum(weight) FROM trees GROUP BY tree, region, rack
  UNION ALL SELECT tree, 2, rack, shard, weight FROM trees),
draws AS (
  SELECT rw, tree, level, above, node,
         ln((('0x' || substr(md5(key || ':' || level || ':' || node), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS draw
  FROM sized, nodes),
best AS (SELECT rw, tree, level, above, arg_max(node, draw) AS node FROM draws GROUP BY rw, tree, level, above),
leaf AS (
  SELECT s.rw, s.tree, s.node FROM best s JOIN best r ON r.rw = s.rw AND r.tree = s.tree AND r.level = 1 AND r.node = s.above
  JOIN best g ON g.rw = s.rw AND g.tree = s.tree AND g.level = 0 AND g.node = r.above WHERE s.level = 2)
SELECT doc_id, size, text_crc32, 'key' AS law, a.node AS shard,
       row_number() OVER (PARTITION BY a.node ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, b.node AS grown_shard
FROM sized JOIN leaf a ON a.rw = sized.rw AND a.tree = 'shard' JOIN leaf b ON b.rw = sized.rw AND b.tree = 'grown_shard'
"""


@query("op11_weighted_hash_tree", SQL)
def op11(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), TREE).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
