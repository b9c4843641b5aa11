"""The prefix trie of all conversations, merged family first.

A family is the conversations of one hundred ids; their shared prefix is the
first turns of the conversation that the family's base id names. Each family is
rebuilt in one sorted stream, which needs only the base's first turns in memory,
and makes a small trie of its own. Only the combined nodes of families are
shuffled to be merged; a node is named by the hash of its whole path.

Sums over subtrees need no step per level. A node belongs to its smallest
member, so a conversation owns the nodes of its path from some depth to its end.
Then a member adds to each node of its path the code points from there to its
end, and, for the distinct nodes of the subtree, the part of them that it owns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

FAMILY = 100
#: Turns of the base that a conversation may start with: crc32 of its id modulo this.
HEADS = 6
#: Nodes of a family's trie that are held at once; what is over goes on in parts, which merging adds up.
HELD = 50_000
#: Bytes of conversation ids that are joined at once.
JOINED = 1 << 20
ROOT = bytes(16)
_NODE, _PATH, _END = 0, 1, 2
_SCHEMA = pa.schema([("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64())])
_DDL = "kind int, node binary, parent binary, depth long, chars long, conv_id long, n long"


def borrowed(conv_id: int) -> int:
    """How many turns a conversation takes over from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def child(node: bytes, role: str, text: str) -> bytes:
    """The name of the node one turn below ``node``."""
    raw = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(node + len(raw).to_bytes(8, "big") + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Family:
    """One family after the other, turn by turn: its trie's nodes, the paths of its members and their ends, as rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.nodes: dict[bytes, list] = {}
        self.base = self.conv_id = None
        self.heads: list[tuple[str, str]] = []

    def turn(self, base: int, conv_id: int, role: str, text: str) -> None:
        if conv_id != self.conv_id or base != self.base:
            self.end()
            if base != self.base:
                self.flush()
                self.base, self.heads = base, []
            self.begin(conv_id)
        self.seen += 1
        if conv_id == base and self.seen < HEADS:
            self.heads.append((role, text))
        if conv_id == base or self.seen > self.skip:
            self.push(role, text)

    def begin(self, conv_id: int) -> None:
        self.conv_id, self.seen, self.skip = conv_id, 0, borrowed(conv_id)
        self.at, self.depth, self.total = ROOT, 0, 0
        self.visit(ROOT, ROOT, 0)
        if conv_id != self.base:
            for role, text in self.heads[: self.skip]:
                self.push(role, text)

    def push(self, role: str, text: str) -> None:
        parent, self.at, self.depth = self.at, child(self.at, role, text), self.depth + 1
        self.visit(self.at, parent, len(text))
        self.total += len(text)

    def visit(self, node: bytes, parent: bytes, chars: int) -> None:
        self.rows.append((_PATH, node, None, None, self.total, self.conv_id, None))
        if found := self.nodes.get(node):
            found[2] = min(found[2], self.conv_id)
            found[3] += 1
        else:
            self.nodes[node] = [parent, (self.depth, chars), self.conv_id, 1]
        if len(self.nodes) >= HELD:
            self.flush()

    def end(self) -> None:
        if self.conv_id is not None:
            self.rows.append((_END, self.at, None, None, self.total, self.conv_id, None))
            self.conv_id = None

    def flush(self) -> None:
        self.rows += [(_NODE, node, parent, depth, chars, least, n) for node, (parent, (depth, chars), least, n) in self.nodes.items()]
        self.nodes = {}

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.release_state()
    family = _Family()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                family.turn(*row)
            if len(family.rows) >= 8192:
                yield family.taken()
    family.end()
    family.flush()
    yield family.taken()


def families(conversations: DataFrame) -> DataFrame:
    """The rows of all families' tries: nodes, paths and ends, by kind. A family is one sorted stream; its base comes first."""
    c = F.col("conv_id").cast("long")
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where(c.isNotNull()).select((c - c % FAMILY).alias("base"), c.alias("conv_id"), text("role").alias("role"), text("text").alias("text"), F.col("turn").cast("long").alias("turn"))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    return rows.select("base", "conv_id", "role", "text").mapInArrow(_tries, _DDL)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (node, conv_id), each node's ids joined by commas, in pieces of ``JOINED`` bytes or so."""
    node, ids, size, out = None, [], 0, []
    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or size >= JOINED):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            node = n
            ids.append(c)
            size += 20
        if sum(len(x[2]) for x in out) >= JOINED or len(out) >= 8192:
            yield _pieces(out)
            out = []
    if ids:
        out.append((node, ids[0], ",".join(map(str, ids))))
    yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    node, first, ids = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order."""
    node, sha, nodes, out = None, None, [], []
    for batch in batches:
        for i in range(batch.num_rows):  # one piece at a time
            n, ids = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
            if n == node:
                sha.update(b"," + ids)
                continue
            if sha:
                nodes.append(node)
                out.append(sha.hexdigest())
            node, sha = n, hashlib.sha256(ids)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], names=["node", "sha"])
        nodes, out = [], []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "sha"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node, sha``: SHA-256 of the ids of ``ends`` (node, conv_id) at each node, ascending, joined by commas.

    A node with very many ids is sorted and joined in ranges on many tasks; one task then hashes its pieces in order.
    """
    pieces = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digests, "node binary, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: one row per node.

    Reads conv_id, turn, role and text; other columns have no effect. Null roles and texts are empty; turns with
    one number (null first) go by role, then text, and repeated rows count each. Rows with a null conv_id belong to no
    conversation. The base of c is c - c % 100, the remainder having c's sign. A conversation that takes no turn from
    its base and has none beyond is a member of the root alone. An empty table gives an empty result.
    """
    tables = common.Tables(conversations.sparkSession, "trie")
    rows = tables.write(families(conversations), "families")
    merged = rows.where(F.col("kind") == _NODE).groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    merged = tables.write(merged, "merged")
    children = tables.write(merged.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    nodes = tables.write(merged.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")
    owners = tables.write(nodes.groupBy("conv_id").agg(F.sum("chars").alias("owned"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf")), "owners")
    ends = tables.write(rows.where(F.col("kind") == _END).select("conv_id", "node", F.col("chars").alias("total")), "ends")
    members = tables.write(ends.select("conv_id", "total").join(owners, "conv_id", "left").fillna(0, ["owned", "leaf"]), "members")
    paths = rows.where(F.col("kind") == _PATH).select("conv_id", "node", F.col("chars").alias("before")).join(members, "conv_id")
    below = F.col("total") - F.col("before")
    sums = paths.groupBy("node").agg(F.sum(below - F.least(below, F.col("owned"))).alias("saved"), F.sum("leaf").alias("leaves"))
    none: Column = F.lit(None)
    columns = {"parent": "binary", "depth": "long", "conv_id": "long", "n_convs": "long", "n_children": "long", "saved": "long", "leaves": "long", "sha": "string"}

    def part(df: DataFrame) -> DataFrame:
        return df.select("node", *[(F.col(c) if c in df.columns else none).cast(t).alias(c) for c, t in columns.items()])

    # The three facts of a node meet in one shuffle.
    facts = part(nodes).union(part(sums)).union(part(ends_digests(ends))).groupBy("node").agg(*[F.max(c).alias(c) for c in columns])
    facts = tables.write(facts, "facts")
    tables.drop("facts", "nodes")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = facts.join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_family_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all ``conversations``; cases are defined by ``trie``."""
    return trie(common.read(spark, sf_dir, "conversations"))


SQL = r"""
WITH ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  -- CRC-32 of the decimal id: each byte is mixed in, then eight steps of one bit.
  SELECT conv_id, base, xor(list_reduce(flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
                        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM ids
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), own AS (
  SELECT conv_id, max(r) AS n FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT crc.conv_id, r AS depth, role, text FROM crc JOIN turns t ON t.conv_id = crc.base AND r <= h
  UNION ALL
  SELECT crc.conv_id, least(h, coalesce(own.n, 0)) + r - h, role, text FROM crc JOIN turns t ON t.conv_id = crc.conv_id AND r > h LEFT JOIN own ON own.conv_id = crc.base
), members AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM members GROUP BY path, depth
), kids AS (
  SELECT left(path, CAST(64 * (depth - 1) AS BIGINT)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), facts AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), below AS (
  SELECT DISTINCT a.path, b.path AS of FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT below.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM below JOIN facts ON facts.path = below.of GROUP BY below.path
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, path FROM members QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM facts f JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = left(f.path, CAST(64 * (f.depth - 1) AS BIGINT))
"""
