"""Operator 12: Merkle manifest of a dataset with octopus multiproofs.

Every row of documents is a leaf; the leaves of one language, by ascending id, form an 8-ary tree,
and the subroots of all languages, by language, form one more.  Leaves get their positions from a
range partitioning (positions inside a partition, then offsets over the partitions' counts) and are
dealt to leaf partitions of ``8 ** HEIGHT`` consecutive leaves.  A leaf partition

* hashes its own subtree, which is all that the levels above are built from;
* computes the coordinates of the nodes it lacks for the proofs of all its leaves together: for
  each level above its own top the other members of the top's run, once, whatever the number of
  leaves.  The coordinates of all partitions are joined with the node table (``missing``);
* derives the interiors its leaves share from its own leaves, and expands the proof of each leaf
  locally: siblings inside the partition, then the fetched ones, which are the same for all.

``prove`` folds every proof with the leaf that the holder presents and compares with the root.

Edge cases: a NULL in any column counts as ``-`` in its leaf; NULL languages are a tree of their own
that comes first; rows with a NULL id come before all others of their language and are never
tampered with; rows with equal ids lie side by side in the order of their leaves, so equal rows are
equal leaves of their own; a language with one row is its own subroot, a single language's subroot
is the root, and a proof without siblings is the hash of the empty text; an empty text is ``0:``;
extra columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, written

ARITY = 8
HEIGHT = 4                 #: levels of a leaf partition's own subtree
PART = ARITY ** HEIGHT     #: leaves of a leaf partition
#: Nodes of one level that may be broadcast to the coordinates (about 100 bytes each; counted).
BROADCAST_NODES = 50_000
TOP = "top"                #: name of the tree over the languages' subroots


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _value(column):
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text):
    """Leaf of a row whose text is the column ``text``."""
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*map(_value, columns)), 256)


def tree_name(lang):
    """Name of a language's tree: sorts like the languages, NULL first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, tree, leaf, shown): ``shown`` is the leaf of the row as its holder presents it, with
    the text lower-cased (A-Z) where the condition ``tampered`` holds."""
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & F.col("text").rlike("[A-Z]")
    leaf = leaf_hash(F.col("text"))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree_name(F.col("lang")).alias("tree"), leaf.alias("leaf"),
                       F.when(changed, leaf_hash(lower)).alias("shown")).withColumn("shown", F.coalesce("shown", "leaf"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, the position of a row in its ``tree`` by ``order``, and ``total``, the rows of
    the tree.  Ranges of (tree, order) are sorted by one task each; equal rows are dealt to the
    ranges by a row number, so no key fills a task of its own."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = ["tree", *order, "_row"]
    ranges = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column("tree").to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
                names=[*batch.schema.names, "_part", "_at"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    numbered = written(ranges.mapInArrow(number, f"{fields}, _part int, _at long"), "manifest-ranges")
    counts = numbered.groupBy("tree", "_part").agg((F.max("_at") + 1).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(Window.partitionBy("tree")).alias("total"))
    return numbered.join(starts, ["tree", "_part"]).withColumn("idx", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def _up(nodes: list[str]) -> list[str]:
    return [_h("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]


def own_levels(own: list[str], total: int) -> list[list[str]]:
    """Nodes of a leaf partition by level, from its leaves up to its top, the only one of the last
    level.  ``total``: leaves of the whole tree, which ends as soon as a single node is left."""
    levels, width = [own], total
    while len(levels) <= HEIGHT and width > 1:
        levels.append(_up(levels[-1]))
        width = -(-width // ARITY)
    return levels


def _partition_tops(placed: DataFrame) -> DataFrame:
    """(tree, part, total, node): the top of every leaf partition."""
    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf["total"].iloc[0])
        node = own_levels(pdf.sort_values("idx")["leaf"].tolist(), total)[-1][0]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "part": pdf["part"].iloc[:1], "total": [total], "node": [node]})
    return placed.select("tree", "part", "idx", "total", "leaf").groupBy("tree", "part").applyInPandas(
        top, "tree string, part long, total long, node string")


def levels_above(tops: DataFrame) -> list[DataFrame]:
    """Tables (tree, idx, node, width) of the levels from ``tops`` (tree, idx, node, width) up to a
    single node per tree; a tree is in a table only while it has nodes on that level."""
    found, now = [tops], tops
    while now.where("width > 1").head(1):
        runs = now.where("width > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("run"), F.max("width").alias("width"))
        now = written(runs.select("tree", F.col("up").alias("idx"), F.sha2(F.array_join("run.node", ""), 256).alias("node"),
                                  F.ceil(F.col("width") / ARITY).alias("width")), "manifest-level")
        found.append(now)
    return found


def missing(holders: DataFrame, levels: list[DataFrame], first: int) -> DataFrame:
    """(tree, part, level, idx, node): the nodes that the holders of one node each (tree, part, at,
    width) lack on the way to the root: on every level the other members of the run that the way
    passes.  ``levels[i]`` holds the nodes of level ``first + i``."""
    out = None
    for i, nodes in enumerate(levels[:-1]):
        at = F.floor(F.col("at") / ARITY ** i)
        width = F.ceil(F.col("width") / ARITY ** i)
        run = F.floor(at / ARITY) * ARITY
        others = F.filter(F.sequence(run, F.least(run + ARITY, width) - 1), lambda x: x != at)
        wanted = holders.where(width > 1).select("tree", "part", F.explode(others).alias("idx"))
        table = nodes.select("tree", "idx", "node")
        table = F.broadcast(table) if table.count() <= BROADCAST_NODES else table
        got = wanted.join(table, ["tree", "idx"]).select("tree", "part", F.lit(first + i).alias("level"), "idx", "node")
        out = got if out is None else out.unionByName(got)
    return out


class Manifest:
    """Trees over the rows of ``leaves``: nodes by level, subroots, root."""

    def __init__(self, rows: DataFrame):
        self.placed = written(positions(written(rows, "manifest-leaves"), ["doc_id", "leaf"])
                              .withColumn("part", F.floor(F.col("idx") / PART)), "manifest-placed")
        self.tops = written(_partition_tops(self.placed), "manifest-tops").withColumn("width", F.ceil(F.col("total") / PART))
        self.levels = levels_above(self.tops.select("tree", F.col("part").alias("idx"), "node", "width"))
        subroots = self.levels[0].where("width = 1")
        for nodes in self.levels[1:]:
            subroots = subroots.unionByName(nodes.where("width = 1"))
        self.subroots = written(subroots.select("tree", F.col("node").alias("subroot")), "manifest-subroots")
        over = self.subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("node"))
        self.over = written(positions(over, ["of"]), "manifest-top")
        self.top_levels = levels_above(self.over.select("tree", "idx", "node", F.col("total").alias("width")))
        root = self.top_levels[-1].where("width = 1").head()
        self.root = root["node"] if root else None

    def fetched(self) -> DataFrame:
        """(tree, part, kind, level, idx, node): all that a leaf partition fetches: the missing nodes
        of its tree (kind 0) and of the tree of the subroots (1), its tree's place and their number
        there (2), the subroot (3) and the root (4)."""
        parts = self.tops.select("tree", "part", F.col("part").alias("at"), "width")
        own = missing(parts, self.levels, HEIGHT)
        trees = self.over.select("tree", F.col("of").alias("part"), F.col("idx").alias("at"), F.col("total").alias("width"))
        top = missing(trees, self.top_levels, 0)
        zero = F.lit(0).cast("long").alias("idx")
        common = self.over.select(F.col("of").alias("tree"), F.lit(2).alias("kind"), "idx", F.col("total").cast("string").alias("node"))
        common = common.unionByName(self.subroots.select("tree", F.lit(3).alias("kind"), zero, F.col("subroot").alias("node")))
        common = common.unionByName(self.subroots.select("tree", F.lit(4).alias("kind"), zero, F.lit(self.root).alias("node")))
        common = common.withColumn("level", F.lit(0))
        if top is not None:
            common = common.unionByName(top.select(F.col("part").alias("tree"), F.lit(1).alias("kind"), "level", "idx", "node"))
        out = self.tops.select("tree", "part").join(common, "tree").select("tree", "part", "kind", "level", "idx", "node")
        if own is not None:
            out = out.unionByName(own.select("tree", "part", F.lit(0).alias("kind"), "level", "idx", "node"))
        return out

    def prove(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
        rows = self.placed.select("tree", "part", "idx", "total", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "shown")
        proofs = rows.groupBy("tree", "part").cogroup(self.fetched().groupBy("tree", "part")).applyInPandas(
            expand, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return proofs.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def expand(own: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Proofs of all leaves of one partition, from its leaves and the nodes it fetched once."""
    own = own.sort_values("idx")
    total, first = int(own["total"].iloc[0]), int(own["idx"].iloc[0])
    levels = own_levels(own["leaf"].tolist(), total)
    got = {(k, lv, i): n for k, lv, i, n in fetched[["kind", "level", "idx", "node"]].itertuples(index=False)}
    place = next(i for k, _, i in got if k == 2)
    subroot, root = got[3, 0, 0], got[4, 0, 0]
    # the way from the partition's top to the root, the same for all its leaves: (before, after) per
    # level; a run of a single node has no other members but is hashed, too
    above = []
    for kind, at, width, level in ((0, first // PART, -(-total // PART), HEIGHT), (1, place, int(got[2, 0, place]), 0)):
        while width > 1:
            run = at // ARITY * ARITY
            above.append(("".join(got[kind, level, i] for i in range(run, at)),
                          "".join(got[kind, level, i] for i in range(at + 1, min(run + ARITY, width)))))
            at, width, level = at // ARITY, -(-width // ARITY), level + 1
    common = "".join(b + a for b, a in above)
    proofs, folded = [], []
    for i, shown in enumerate(own["shown"].tolist()):
        node, at, siblings = shown, i, []
        for nodes in levels[:-1]:
            run = at // ARITY * ARITY
            before, after = "".join(nodes[run:at]), "".join(nodes[at + 1:run + ARITY])
            siblings.append(before + after)
            node, at = _h(before + node + after), at // ARITY
        for before, after in above:
            node = _h(before + node + after)
        proofs.append(_h("".join(siblings) + common))
        folded.append(node)
    return pd.DataFrame({"doc_id": own["doc_id"].array, "leaf": own["leaf"].array, "subroot": subroot, "root": root, "proof_sha256": proofs,
                         "folded_root": folded, "verified": [f == root for f in folded]})


def tampered_rows():
    """True for rows that the query tampers with: 3 divides the crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def digest(docs: DataFrame) -> DataFrame:
    """Query form: builds the manifest of all rows and folds every row's proof, a third of them with
    a text that was lower-cased after the manifest was made."""
    prepare(docs.sparkSession)
    return Manifest(leaves(docs, tampered_rows())).prove()


#: Levels that the SQL spells out: trees of up to 8 ** SQL_LEVELS leaves.
SQL_LEVELS = 7


def _sql() -> str:
    def value(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = ("xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), "
           "lambda c, b: xor(c >> 8, list_extract(crc.t, (xor(c, b) & 255) + 1)), 4294967295::BIGINT), 4294967295::BIGINT)")
    step = "c"
    for _ in range(8):
        step = f"list_transform({step}, lambda v: xor(v >> 1, 3988292384::BIGINT * (v & 1)))"
    ctes = [f"crc AS (SELECT {step} AS t FROM (SELECT range(256::BIGINT) AS c))",
            f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, "
            f"CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents, crc)",
            "r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, "
            "count(*) OVER (PARTITION BY tree) AS width FROM d)",
            "a0 AS (SELECT tree, idx, leaf AS node, width FROM r)"]

    def grow(name, levels):
        for i in range(levels):
            ctes.append(f"{name}{i + 1} AS (SELECT tree, idx // 8 AS idx, sha256(string_agg(node, '' ORDER BY idx)) AS node, "
                        f"(any_value(width) + 7) // 8 AS width FROM {name}{i} WHERE width > 1 GROUP BY tree, idx // 8)")

    def root_of(name, levels):
        return " UNION ALL ".join(f"SELECT tree, node FROM {name}{i} WHERE width = 1" for i in range(levels + 1))
    grow("a", SQL_LEVELS)
    ctes.append(f"s AS ({root_of('a', SQL_LEVELS)})")
    ctes.append("o AS (SELECT tree AS of, row_number() OVER (ORDER BY tree) - 1 AS idx, node, count(*) OVER () AS width FROM s)")
    ctes.append("b0 AS (SELECT 'top' AS tree, idx, node, width FROM o)")
    grow("b", 3)
    ctes.append(f"top AS ({root_of('b', 3)})")
    ctes.append("p0 AS (SELECT r.doc_id, r.tree, r.idx AS at, r.leaf, r.shown AS now, '' AS proof FROM r)")
    # one step per level: siblings before and after, and the folded node
    n = 0
    for name, levels in (("a", SQL_LEVELS), ("b", 3)):
        if name == "b":
            ctes.append(f"p{n + 1} AS (SELECT p.doc_id, p.tree, o.idx AS at, p.leaf, p.now, p.proof FROM p{n} p JOIN o ON o.of = p.tree)")
            n += 1
        for i in range(levels):
            key = "x.tree" if name == "a" else "'top'"
            ctes.append(f"g{n} AS (SELECT tree, idx // 8 AS run, list(node ORDER BY idx) AS nodes, any_value(width) AS width FROM {name}{i} "
                        "WHERE width > 1 GROUP BY tree, idx // 8)")
            before, after = "array_to_string(g.nodes[1:x.at % 8], '')", "array_to_string(g.nodes[x.at % 8 + 2:], '')"
            ctes.append(f"p{n + 1} AS (SELECT x.doc_id, x.tree, CASE WHEN g.nodes IS NULL THEN x.at ELSE x.at // 8 END AS at, x.leaf, "
                        f"CASE WHEN g.nodes IS NULL THEN x.now ELSE sha256({before} || x.now || {after}) END AS now, "
                        f"CASE WHEN g.nodes IS NULL THEN x.proof ELSE x.proof || {before} || {after} END AS proof "
                        f"FROM p{n} x LEFT JOIN g{n} g ON g.tree = {key} AND g.run = x.at // 8)")
            n += 1
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT p.doc_id, p.leaf, s.node AS subroot, top.node AS root, sha256(p.proof) AS proof_sha256, p.now AS folded_root, p.now = top.node AS verified
FROM p{n} p JOIN s ON s.tree = p.tree CROSS JOIN top""")


SQL = _sql()
