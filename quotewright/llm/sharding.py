"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` places on a ring of hashes. A key belongs to the first node
clockwise from its own hash; when the shard of that node is full, it goes on clockwise to
the next shard that has room. Keys enter in the order of the ring, and those of one
segment (the arc that ends at a node) in the order of a second hash. So all keys of a
segment share one way round the ring, and how many there are in each segment decides
everything: a plan of at most nodes + shards pieces says which ranks of a segment go to
which shard, and from which slot on. Rows are ranked in parallel and look up their piece.

Only one count per segment reaches the driver, and only tables of the ring's size are
broadcast. Rows that are equal in id, size and text are counted per input task, and a
segment is ranked in blocks of a hash range, so neither a hot key nor a hot segment
becomes one task. All of it is built-in expressions.

Inputs: a missing text is empty (size 16); missing ids hash like an empty string. Repeated
ids and repeated rows are rows of their own and take places of their own; among equal
rows it does not matter which takes which. No rows give no rows. Texts of any length are
read once and never shuffled by ``assign``. Other columns are ignored, or kept by ``shard``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotewright.llm.common import stored, whole

#: The ring has 2^60 places: fifteen hexadecimal digits of an MD5.
DIGITS = 15
RING = 16**DIGITS
NODES = 100
#: Arcs of equal size by which keys find their node; a fixed number.
ARCS = 4096
#: Rows of a segment that one task ranks.
RANK_BLOCK = 50_000
OVERHEAD = 16
PIECE = "array<struct<start:long,stop:long,shard:int,slot:long>>"


def place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def place_of(text: Column) -> Column:
    """The same for a column."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


@dataclass(frozen=True)
class Ring:
    """Places of the virtual nodes, ascending, and the shard of each."""

    places: list[int]
    owners: list[int]
    shards: int

    @classmethod
    def of(cls, shards: int, nodes: int = NODES) -> Ring:
        found = sorted((place(f"shard {s} node {r}"), s) for s in range(shards) for r in range(nodes))
        return cls([p for p, _ in found], [s for _, s in found], shards)

    def arcs(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """For each arc the nodes in it and the one after it, as (place, segment).

        The last arc ends with a place behind all keys, which stands for the first node.
        """
        width, n = RING // ARCS, len(self.places)
        out, i = [], 0
        for arc in range(ARCS):
            held, end = [], (arc + 1) * width
            while i < n and self.places[i] < end:
                held.append((self.places[i], i))
                i += 1
            held.append((self.places[i], i) if i < n else (RING, 0))
            out.append((arc, held))
        return out


def capacities(n: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: shares at most one apart, or ``slack`` above the mean, rounded up."""
    if slack == 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [-int(-n * (1 + slack) // shards)] * shards


def plan(ring: Ring, counts: dict[int, int], room: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """(first rank, rank behind the last, shard, slot of the first) by segment.

    ``following`` jumps over nodes of full shards, with path halving.
    """
    n, left, used = len(ring.places), list(room), [0] * ring.shards
    following = list(range(n))

    def open_node(i: int) -> int:
        while following[i] != i or not left[ring.owners[i]]:
            if following[i] == i:
                following[i] = (i + 1) % n
            following[i] = following[following[i]]
            i = following[i]
        return i

    pieces: dict[int, list[tuple[int, int, int, int]]] = {}
    for segment in sorted(counts):
        at, start, count = segment, 0, counts[segment]
        while start < count:
            at = open_node(at)
            shard = ring.owners[at]
            take = min(count - start, left[shard])
            pieces.setdefault(segment, []).append((start, start + take, shard, used[shard]))
            left[shard] -= take
            used[shard] += take
            start += take
    return pieces


def segments(spark: SparkSession, ring: Ring) -> DataFrame:
    """A row per arc with its nodes; as many as ARCS and nodes of the ring."""
    return spark.createDataFrame(ring.arcs(), "arc int, nodes array<struct<place:long,segment:int>>")


def compact(docs: DataFrame, ring: Ring, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, mix (a second hash), task and segment of every row; no text."""
    text = whole()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *carried)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = rows.select(
        "*", place_of(key).alias("place"), place_of(F.concat_ws("|", key, "size", "text_crc32")).alias("mix"),
        F.spark_partition_id().alias("task"))
    arc = F.expr(f"CAST(place div {RING // ARCS} AS int)")
    node = F.filter("nodes", lambda x: x["place"] >= F.col("place"))[0]
    found = placed.withColumn("arc", arc).join(F.broadcast(segments(docs.sparkSession, ring)), "arc")
    return found.select(*rows.columns, "mix", "task", node["segment"].alias("segment"))


def assign(docs: DataFrame, shards: int = 40, nodes: int = NODES, slack: float = 0.0, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, ``carried`` columns, shard and slot of every row of ``docs`` (doc_id, text).

    size is UTF-8 bytes plus 16, slots of a shard run from 0 without gaps. Without slack
    the numbers of rows of any two shards differ by at most one; with it no shard has more
    than 1 + slack times the mean, and fewer rows move when the number of shards changes.
    """
    ring = Ring.of(shards, nodes)
    rows = stored(compact(docs, ring, carried), "ring")
    counts = {r["segment"]: r["count"] for r in rows.groupBy("segment").count().collect()}  # one per node at most
    pieces = plan(ring, counts, capacities(sum(counts.values()), shards, slack))
    steps = [(s, -(-RING // -(-counts[s] // RANK_BLOCK)), pieces[s]) for s in counts]
    known = F.broadcast(docs.sparkSession.createDataFrame(steps, f"segment int, step long, pieces {PIECE}"))

    block = F.expr("CAST(mix div step AS int)").alias("block")
    dealt = rows.join(known.select("segment", "step"), "segment").select(*rows.columns, block)
    blocks = (
        dealt.groupBy("segment", "block").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("segment").orderBy("block")) - F.col("count")).drop("count"))
    same = ["segment", "block", "mix", "doc_id", "size", "text_crc32", "task", *carried]
    upto = Window.partitionBy("segment", "block").orderBy(*same[2:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = dealt.groupBy(same).agg(F.count("*").alias("rows")).withColumn("upto", F.sum("rows").over(upto))
    first = F.col("before") + F.col("upto") - F.col("rows")
    ranked = groups.join(blocks, ["segment", "block"]).select(
        *same, F.explode(F.sequence(first, F.col("before") + F.col("upto") - 1)).alias("rank"))
    piece = F.filter("pieces", lambda p: (p["start"] <= F.col("rank")) & (p["stop"] > F.col("rank")))[0].alias("piece")
    found = ranked.join(known.select("segment", "pieces"), "segment").select("*", piece)
    slot = F.col("piece.slot") + F.col("rank") - F.col("piece.start")
    return found.select("doc_id", "size", "text_crc32", *carried, F.col("piece.shard").alias("shard"), slot.alias("slot"))


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``assign`` without slack, with the law that it keeps."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = 40, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """``docs`` with all columns and ``shard`` and ``slot`` added; columns of these names are replaced.

    The documents are written once with a number for each row, which brings the places back to them.
    """
    mark = "_ring_row"
    rows = stored(docs.drop("shard", "slot").withColumn(mark, F.monotonically_increasing_id()), "to-shard")
    places = assign(rows, shards, nodes, slack, (mark,)).select(mark, "shard", "slot")
    return rows.join(places, mark).drop(mark)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """A folder per shard, its rows by slot in files of at most ``rows_per_file`` rows; a repeated job replaces them."""
    part = F.expr(f"slot div {int(rows_per_file)}")
    dealt = sharded.withColumn("_part", part).repartition("shard", "_part").sortWithinPartitions("shard", "slot")
    dealt.drop("_part").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


SQL = f"""
WITH RECURSIVE bits AS (
  SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
sized AS MATERIALIZED (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT) AS place,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || text_crc32), 1, {DIGITS}) AS BIGINT) AS mix
  FROM sized),
ring AS MATERIALIZED (
  SELECT place, shard, row_number() OVER (ORDER BY place, shard) - 1 AS node
  FROM (SELECT s AS shard, CAST('0x' || substr(md5('shard ' || s || ' node ' || r), 1, {DIGITS}) AS BIGINT) AS place
        FROM range(40) a(s), range({NODES}) b(r)) nodes),
ranked AS MATERIALIZED (
  SELECT h.doc_id, h.size, h.text_crc32, coalesce(r.node, 0) AS node,
    row_number() OVER (PARTITION BY coalesce(r.node, 0) ORDER BY h.mix, h.doc_id, h.size, h.text_crc32) - 1 AS rank
  FROM hashed h ASOF LEFT JOIN ring r ON h.place <= r.place),
counts AS MATERIALIZED (
  SELECT node, count(*) AS n, row_number() OVER (ORDER BY node) AS turn FROM ranked GROUP BY node),
ways AS MATERIALIZED (  -- the shards in the order in which a key of the segment meets them
  SELECT node, list(shard ORDER BY far) AS way
  FROM (SELECT c.node, r.shard, min((r.node - c.node + 40 * {NODES}) % (40 * {NODES})) AS far FROM counts c, ring r GROUP BY c.node, r.shard) met
  GROUP BY node),
plan AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST(NULL AS BIGINT) AS shard,
    CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS remaining, list_transform(range(40), lambda s: CAST(0 AS BIGINT)) AS used,
    (SELECT list_transform(range(40), lambda s: count(*) // 40 + CASE WHEN s < count(*) % 40 THEN 1 ELSE 0 END) FROM ranked) AS cap
  UNION ALL
  SELECT turn, node, start, start + take, target, used[target + 1], remaining - take,
    list_transform(used, lambda u, i: CASE WHEN i = target + 1 THEN u + take ELSE u END), cap
  FROM (
    SELECT *, least(remaining, cap[target + 1] - used[target + 1]) AS take
    FROM (
      SELECT c.turn, c.node, CASE WHEN p.remaining > 0 THEN p.stop ELSE 0 END AS start, CASE WHEN p.remaining > 0 THEN p.remaining ELSE c.n END AS remaining,
        p.used, p.cap, list_filter(w.way, lambda s: p.used[s + 1] < p.cap[s + 1])[1] AS target
      FROM plan p JOIN counts c ON c.turn = p.turn + CASE WHEN p.remaining > 0 THEN 0 ELSE 1 END JOIN ways w ON w.node = c.node) step) done)
SELECT r.doc_id, r.size, r.text_crc32, 'rows' AS law, CAST(p.shard AS INT) AS shard, CAST(p.slot + r.rank - p.start AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard
FROM ranked r JOIN plan p ON r.node = p.node AND p.turn > 0 AND r.rank >= p.start AND r.rank < p.stop
"""
