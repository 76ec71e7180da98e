"""Hierarchical weighted hash tree: documents descend region, rack and shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import free

#: Shards of a rack, racks of a region, in the standard layout.
RACK, REGION = 2, 2


@dataclass(frozen=True)
class Node:
    """A part of the tree. name: what its draws are keyed with. A leaf has a shard and a weight; others weigh as much as their children."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def layout(shards: int, weights: Sequence[float] | None = None) -> Node:
    """Shards 0, 1, ... in racks of two, two racks to a region. A region or rack is keyed by its place,
    so the tree for more shards is the same tree with more parts. Weights must be positive."""
    if shards < 1:
        raise ValueError("at least one shard")
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard")
    leaves = [Node(f"shard{i}", shard=i, own=float(w)) for i, w in enumerate(weights)]
    racks = [Node(f"rack{i // RACK}", tuple(leaves[i : i + RACK])) for i in range(0, shards, RACK)]
    regions = [Node(f"region{i // REGION}", tuple(racks[i : i + REGION])) for i in range(0, len(racks), REGION)]
    return Node("root", tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """The node's draw for a key: an exponential clock whose rate is the node's weight.
    The clock that rings first wins; raising one weight moves keys only towards that node."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + node.name)).cast("binary")), 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    return -F.log(u) / F.lit(node.weight)


def shard_of(key: Column, node: Node) -> Column:
    """The shard that a key (string) reaches from a node: one weighted draw for each child, level by level."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return shard_of(key, node.children[0])
    clocks = F.array(*[F.struct(draw(key, c).alias("at"), F.lit(i).alias("i")) for i, c in enumerate(node.children)])
    won = F.array_min(clocks)["i"]
    return reduce(lambda rest, c: F.when(won == c[0], shard_of(key, c[1])).otherwise(rest), list(enumerate(node.children))[1:], shard_of(key, node.children[0]))


def assign(df: DataFrame, tree: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Adds the shard of each row, in place of a column of that name; other columns stay, whatever their names. Rows of
    one key share it; a null key counts as the text 'null', an empty one as any other."""
    return df.withColumn(out, shard_of(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), tree))


def slots(df: DataFrame, order: Sequence[Column], shard: str = "shard", out: str = "slot", parts: int = 1024) -> DataFrame:
    """Numbers the rows of each shard 0, 1, 2, ... without gaps, by hash part and then by `order`.

    No task holds a shard: each is cut into `parts` by a hash of all order columns, parts are counted (a
    row for each), the counts added up, and rows numbered within their part. Rows that agree in all
    order columns fall into one part; equal rows take their numbers in any order. Nulls come first. Columns of any
    name stay, but one named `out` is replaced."""
    part, k, base, n, at = (free(df, c) for c in ("_part", "_k", "_base", "_n", "_l"))
    text = F.concat_ws("|", *[c.cast("string") for c in order])
    cut = df.drop(out).withColumn(part, (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % parts).cast("int"))
    counts = cut.groupBy(shard, part).agg(F.count("*").alias(n))
    sums = counts.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct(part, n))).alias(at))
    sums = sums.select(shard, F.explode(F.expr(f"transform({at}, (x, i) -> struct(x.{part} as {part}, aggregate(slice({at}, 1, i), 0L, (s, y) -> s + y.{n}) as {base}))")).alias(at)).select(shard, f"{at}.*")
    w = Window.partitionBy(shard, part).orderBy(*order)
    return cut.withColumn(k, F.row_number().over(w)).join(sums, [shard, part]).withColumn(out, (F.col(base) + F.col(k) - 1).cast("long")).drop(part, k, base)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law 'key': doc_id and shard count decide. The next shard opens a region of its own when `shards`
    fills its regions, as 8 does, so only that subtree's weight changes and rows move only into it; in
    a region that is partly full, movement stays within the region and its share of the others.
    A null text has size 1 and the checksum of the empty text; a null doc_id is a key like any other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, layout(shards)), layout(shards + 1), out="grown_shard")
    out = slots(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_shard(node: Node) -> str:
    """The SQL of `shard_of` over a column k."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_shard(node.children[0])
    clock = lambda c: f"-ln((('0x' || substr(md5(k || '/{c.name}'), 1, 12))::bigint + 1.0::double) / {1 << 48}.0::double) / {c.weight}::double"
    won = f"list_position(l{node.name}, list_min(l{node.name}))"
    cases = " ".join(f"when {i + 1} then {_sql_shard(c)}" for i, c in enumerate(node.children))
    return f"(select case {won} {cases} end from (select [{', '.join(map(clock, node.children))}] as l{node.name}))"


def _crc(half: int) -> int:
    """The checksum's step for half a byte."""
    for _ in range(4):
        half = half >> 1 ^ 0xEDB88320 * (half & 1)
    return half


SQL = f"""with d as (select doc_id, coalesce(text, '') as t, coalesce(doc_id::varchar, 'null') as k from documents),
h as (select *, list_transform(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: (instr('0123456789ABCDEF', x) - 1)::bigint) as nibbles from d),
c as (select doc_id, k, (octet_length(encode(t)) + 1)::bigint as size, case when t = '' then 0 else xor(list_reduce(list_prepend(4294967295::bigint, nibbles), lambda a, b: xor(a >> 4, [{', '.join(str(_crc(i)) for i in range(16))}][(xor(a, b) & 15) + 1])), 4294967295) end::bigint as text_crc32 from h),
s as (select doc_id, size, text_crc32, 'key' as law, {_sql_shard(layout(8))}::int as shard, {_sql_shard(layout(9))}::int as grown_shard from c)
select doc_id, size, text_crc32, law, shard, row_number() over (partition by shard order by ('0x' || substr(md5(concat_ws('|', doc_id, text_crc32, size)), 1, 8))::bigint % 1024, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard from s"""
