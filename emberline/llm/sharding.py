"""Shards by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, their racks, and the racks' shards; a node weighs as much as the shards below it. A key descends from the
root: every child draws -ln(u) / weight, with u in (0, 1] from the hash of the key and the child's path, and the least draw wins
(weights are shares in expectation). A draw depends on nothing but key, path and weight, so a changed weight changes only
choices at the nodes above it: a shard that gains weight gains rows through its rack and region, a subtree whose weights stay
receives no row from another subtree that stays, and rows within it keep their places.

`grown` puts one more shard into a region of its own: the only draw that is new is this region's at the root, so rows move into
the new shard or stay. (A shard added to a rack that exists would also send rows that newly reach that rack's region to its older shards.)

Slots: a shard's rows are numbered in the order of a hash of the key, in buckets of that hash that are as many as the table's size
asks for; bucket totals are added up, and rows are numbered within their bucket. Equal (doc_id, size, checksum) are combined
before the shuffle and counted out again in steps, so an id that repeats very often fills no task. Only numbers are shuffled, no text.

Defined results: the key is doc_id as text, of a null id the empty text, so all null ids share a shard; null text has size 1 and
checksum 0; rows that repeat get different slots of one shard; equal texts have no common shard unless their ids have; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import table, written

#: Bits of a draw's hash: the first 15 hex digits of an MD5.
DIGITS, BITS = 15, 60
#: Rows of a slot bucket, and rows of one repeated id that are counted out at once.
BUCKET_ROWS = 65_536
PARTING = "/"


@dataclass(frozen=True)
class Tree:
    """Weights of shards by (region, rack, shard number). A weight of 0 draws no rows."""

    weights: tuple[tuple[str, str, int, float], ...]

    def __post_init__(self) -> None:
        if not any(w > 0 for *_, w in self.weights) or any(w < 0 for *_, w in self.weights):
            raise ValueError("weights must not be negative, and one must be positive")
        if len({s for _, _, s, _ in self.weights}) < len(self.weights):
            raise ValueError("a shard has one place")

    def children(self) -> dict[str, dict[str, float]]:
        """Weight of each child's path by the path of its parent; the root's path is empty."""
        found: dict[str, dict[str, float]] = {}
        for region, rack, shard, weight in self.weights:
            if weight > 0:
                parent = ""
                for name in (region, rack, str(shard)):
                    path = f"{parent}{PARTING}{name}"
                    below = found.setdefault(parent, {})
                    below[path] = below.get(path, 0.0) + weight
                    parent = path
        return found

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        shard = max(s for _, _, s, _ in self.weights) + 1
        return Tree((*self.weights, (f"region{shard}+", "rack0", shard, weight)))


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """`shards` shards of weight 1 in each of `racks` racks of each of `regions` regions."""
    return Tree(tuple((f"region{r}", f"rack{k}", (r * racks + k) * shards + s, 1.0) for r in range(regions) for k in range(racks) for s in range(shards)))


def hash_bits(text: Column) -> Column:
    """The first `BITS` bits of the text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _drawn(key: Column, children: dict[str, float]) -> Column:
    """Path of the child with the least draw; the path settles ties."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = []
    for path, weight in sorted(children.items()):
        u = (hash_bits(F.concat(F.lit(path + PARTING), key)) + 1).cast("double") / float(1 << BITS)
        draws.append(F.struct((-F.ln(u) / F.lit(weight)).alias("draw"), F.lit(path).alias("path")))
    return F.array_min(F.array(*draws)).getField("path")


def shard_of(key: Column, tree: Tree) -> Column:
    """Number of the key's shard: descends level by level, drawing only among the children of the node it has reached."""
    children = tree.children()

    def below(node: str, depth: int) -> Column:
        if depth == 0:
            return F.lit(int(node.rsplit(PARTING, 1)[1]))
        return F.transform(F.array(_drawn(key, children[node])), lambda path: _chosen(path, node, depth)).getItem(0)

    def _chosen(path: Column, node: str, depth: int) -> Column:
        first, *others = sorted(children[node])
        found = below(first, depth - 1)
        for child in others:
            found = F.when(path == child, below(child, depth - 1)).otherwise(found)
        return found

    return below("", 3)


def place(docs: DataFrame, tree: Tree, more: Tree) -> DataFrame:
    """doc_id, size, text_crc32, shard in `tree`, slot in the shard, grown_shard in `more`, for every row; works at once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    numbers = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    same = numbers.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("copies"))
    drawn = same.select("*", shard_of(F.col("key"), tree).alias("shard"), shard_of(F.col("key"), more).alias("grown_shard"), hash_bits(F.concat(F.lit("slot" + PARTING), "key")).alias("h"))
    drawn = written(drawn.drop("key"), "shards")

    rows = drawn.agg(F.sum("copies")).first()[0] or 0
    shift = BITS - min(30, max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())
    bucketed = drawn.withColumn("bucket", F.shiftright("h", shift))
    totals = bucketed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = bucketed.withColumn("sooner", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    first = numbered.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "copies", (F.col("start") + F.col("sooner")).alias("slot"))
    step = F.lit(BUCKET_ROWS)
    one = first.filter("copies = 1")
    many = first.filter("copies > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step.cast("long"))))
    many = many.repartition("doc_id", "size", "text_crc32", "at").withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + step, F.col("copies")) - 1)))
    many = many.withColumn("slot", F.col("slot") + F.col("k"))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    return one.select(*columns).unionByName(many.select(*columns))


#: Eight shards: two regions of two racks of two shards.
TREE = even_tree(2, 2, 2)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"), TREE, TREE.grown())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _bits_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, {DIGITS}))::BIGINT"


def _tree_sql(name: str, tree: Tree) -> str:
    """Tables `name`1 to `name`3: for every key the node it has reached, level by level; the last one's is the shard's number."""
    rows = ", ".join(f"('{node}', '{path}', {weight})" for node, below in tree.children().items() for path, weight in below.items())
    u = f"({_bits_sql(f"c.path || '{PARTING}' || k.key")} + 1)::DOUBLE / {float(1 << BITS)}"
    levels = []
    for depth, (source, parent) in enumerate([("keys", "''"), (f"{name}1", "k.node"), (f"{name}2", "k.node")], start=1):
        node = f"min_by(c.path, (-ln({u}) / c.weight, c.path))"
        node = f"string_split({node}, '{PARTING}')[-1]::INTEGER" if depth == 3 else node
        levels.append(f"{name}{depth} AS (SELECT k.key, {node} AS node FROM {source} k JOIN (VALUES {rows}) c(parent, path, weight) ON c.parent = {parent} GROUP BY k.key)")
    return ", ".join(levels)


#: CRC-32 by its rule: a table of 256 steps, folded over the bytes.
_STEP = "(CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END)"
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
keys AS (SELECT DISTINCT key FROM docs),
{_tree_sql('now', TREE)},
{_tree_sql('more', TREE.grown())},
steps AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: {_STEP.format(x='c')}) ORDER BY n) AS byte FROM range(256) r(n)),
sums AS (
  SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(t) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, byte[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM (SELECT t, hex(encode(t)) AS h FROM (SELECT DISTINCT t FROM docs)), steps)
SELECT doc_id, strlen(t) + 1 AS size, crc AS text_crc32, 'key' AS law, now3.node AS shard,
       row_number() OVER (PARTITION BY now3.node ORDER BY {_bits_sql(f"'slot{PARTING}' || key")}, doc_id, strlen(t), crc) - 1 AS slot, more3.node AS grown_shard
FROM docs JOIN sums USING (t) JOIN now3 USING (key) JOIN more3 USING (key)
"""
