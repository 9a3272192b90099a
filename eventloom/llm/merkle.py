"""A Merkle manifest of a dataset: digests of rows, of runs of rows, of each group and of the whole, and proofs per row.

Levels are DataFrames. Rows get their place in their group (`with_ordinals`), a floor division by the fanout gives a
node's parent, and the sorted digests of a parent's children are hashed into it. Proofs go the other way: each level
joins its parents and appends its own siblings to theirs. Everything is built-in functions; only digests are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stored
from eventloom.operators.ordinals import with_ordinals

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: the digests of the run's other nodes, as one text each side of the own one.
STEP = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its encoded values one after another, which no other values give."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All digests of a proof, from the leaf to the root and from left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass
class Tree:
    """The stored levels of the trees of some groups: `levels[l]` has group, place, n (nodes of the group on this level),
    digest and, above the leaves, children, the digests below in order. A group's root is its row with n = 1."""

    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """group, level, digest: one row a group."""
        found = None
        for at, level in enumerate(self.levels):
            one = level.where("n = 1").select("group", F.lit(at).alias("level"), "digest")
            found = one if found is None else found.unionByName(one)
        return found

    def nodes(self) -> DataFrame:
        """group, level, place, digest of all nodes: what a manifest keeps."""
        found = None
        for at, level in enumerate(self.levels):
            one = level.select("group", F.lit(at).alias("level"), "place", "digest")
            found = one if found is None else found.unionByName(one)
        return found

    def proofs(self, tops: DataFrame) -> DataFrame:
        """The leaves' rows with subroot and proof. `tops`: group, level, subroot, proof, as of each group's root."""
        below = None
        for at in range(len(self.levels) - 1, -1, -1):
            level = self.levels[at]
            top = tops.where(F.col("level") == at).select(F.col("group").alias("_group"), "subroot", "proof")
            ended = level.where("n = 1").join(top, F.col("group") == F.col("_group")).drop("_group")
            if below is not None:
                ended = ended.unionByName(self._with_siblings(level, below))
            below = ended
        return below

    def _with_siblings(self, level: DataFrame, parents: DataFrame) -> DataFrame:
        above = parents.select(F.col("group").alias("_group"), F.col("place").alias("_place"), F.col("children").alias("_run"), "subroot", F.col("proof").alias("_proof"))
        mine = (F.col("place") % self.fanout).cast("int")
        left = F.array_join(F.slice("_run", 1, mine), "")
        right = F.array_join(F.slice("_run", mine + 2, self.fanout), "")
        met = level.where("n > 1").join(above, (F.col("group") == F.col("_group")) & (F.floor(F.col("place") / self.fanout) == F.col("_place")))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        return met.withColumn("proof", F.concat(step, "_proof")).drop("_group", "_place", "_run", "_proof")


def tree_of(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """The tree of each group. `leaves`: group (not null), place (dense from 0), n, digest and any other columns.

    A level has at most a part in `fanout` of the rows of the one below, rounded up in each group; groups with one node
    are ready, and the levels end when all are.
    """
    if fanout < 2:
        raise ValueError("a tree needs runs of two nodes or more")
    levels = [leaves]
    while True:
        open_nodes = levels[-1].where("n > 1")
        if open_nodes.isEmpty():
            return Tree(levels, fanout)
        runs = open_nodes.groupBy("group", F.floor(F.col("place") / fanout).alias("place"), F.ceil(F.col("n") / fanout).alias("n")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("_run"))
        made = runs.withColumn("children", F.transform("_run", lambda x: x["digest"])).drop("_run")
        levels.append(stored(made.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "merkle-level"))


@dataclass
class Manifest:
    """A dataset's trees: one of its rows per group, and one of the groups' roots, whose root is the dataset's (null
    without rows)."""

    rows: Tree
    groups: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """kind (row or group), group, level, place, digest: what to keep beside a dataset."""
        return self.rows.nodes().withColumn("kind", F.lit("row")).unionByName(self.groups.nodes().withColumn("kind", F.lit("group"))).select("kind", "group", "level", "place", "digest")

    def proofs(self) -> DataFrame:
        """The leaves with subroot and proof: the steps to their group's root and on to the dataset's."""
        top = self.groups.roots().select("group", "level", F.col("digest").alias("subroot"), F.array().cast(STEP).alias("proof"))
        above = self.groups.proofs(top).select("own", "row_level", F.col("digest").alias("subroot"), "proof")
        return self.rows.proofs(stored(above.select(F.col("own").alias("group"), F.col("row_level").alias("level"), "subroot", "proof"), "merkle-tops"))


def manifest(rows: DataFrame, order: list[str], group: str | None = None, digest: str = "digest", fanout: int = FANOUT) -> Manifest:
    """The manifest of `rows`: in each group their digests, a column of hex texts, in the order of `order` (nulls first) and
    then of the digest; groups in the bytewise order of `group`, null first.

    A group of any size is dealt to many tasks, also one of rows that are all alike. An empty table has no root. Columns
    of `rows` come back with `Manifest.proofs`; those named group, place, n, children, subroot, proof must not occur.
    """
    # Null sorts before all texts, and so does the empty text before marked ones.
    key = F.lit("") if group is None else F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = with_ordinals(rows.withColumns({"group": key, "digest": F.col(digest)}), ["group"], [*order, "digest"], "place", "n")
    trees = tree_of(stored(leaves, "merkle-leaves"), fanout)
    subroots = trees.roots().select(F.lit("").alias("group"), F.col("group").alias("own"), F.col("level").alias("row_level"), "digest")
    over = tree_of(stored(with_ordinals(subroots, ["group"], ["own"], "place", "n"), "merkle-subroots"), fanout)
    # One digest.
    root = over.roots().select("digest").first()
    return Manifest(trees, over, root and root["digest"])


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, changed: a leaf per row, and the leaf with its text's line feeds deleted where an even
    CRC-32 of the decimal id asks for that (a null id doesn't), as a stand-in for a tampered copy."""
    plain = [F.col(c) for c in COLUMNS]
    tampered = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return docs.select("doc_id", "source", leaf_digest(plain).alias("digest"), F.when(even, leaf_digest(tampered)).alias("changed"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of `docs`.

    Null ids come first in their source, null sources first of all; rows with one id are ordered by their leaves, and rows
    alike in all five columns are leaves of their own with different proofs. Null and empty values have different leaves.
    Texts of any length are hashed where they are read. An empty table gives an empty result; other columns don't count.
    """
    found = manifest(stored(document_leaves(docs), "merkle-digests"), ["doc_id"], "source")
    rows = found.proofs().select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(found.root).cast("string").alias("root"), F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a text of ASCII digits: each byte is followed by its eight shifts.
CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_split_to_array(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END)"
FIELDS = lambda text: " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
SQL = f"""WITH RECURSIVE
lf AS (SELECT doc_id, source, sha256({FIELDS('text')}) AS leaf,
         coalesce(CASE WHEN xor({CRC}, 4294967295) % 2 = 0 THEN sha256({FIELDS("replace(text, chr(10), '')")}) END, sha256({FIELDS('text')})) AS told FROM documents),
placed AS (SELECT *, coalesce('=' || source, '') AS own, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM lf),
tree AS (
  SELECT own, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY own
  UNION ALL SELECT own, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM tree WHERE len(nodes) > 1),
sub AS (SELECT own, nodes[1] AS subroot, row_number() OVER (ORDER BY own) - 1 AS place FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM top WHERE len(nodes) > 1),
way AS (
  SELECT row_number() OVER () AS row, doc_id, own, leaf, told AS digest, '' AS proof, place, 0 AS level FROM placed
  UNION ALL SELECT row, doc_id, own, leaf, sha256(array_to_string(nodes[place // 3 * 3 + 1 : place], '') || digest || array_to_string(nodes[place + 2 : place // 3 * 3 + 3], '')),
    proof || array_to_string(nodes[place // 3 * 3 + 1 : place], '') || array_to_string(nodes[place + 2 : place // 3 * 3 + 3], ''), place // 3, level + 1
  FROM way JOIN tree USING (own, level) WHERE len(nodes) > 1),
up AS (
  SELECT row, doc_id, leaf, subroot, digest, proof, sub.place, 0 AS level FROM (SELECT * FROM way QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1) JOIN sub USING (own)
  UNION ALL SELECT row, doc_id, leaf, subroot, sha256(array_to_string(nodes[place // 3 * 3 + 1 : place], '') || digest || array_to_string(nodes[place + 2 : place // 3 * 3 + 3], '')),
    proof || array_to_string(nodes[place // 3 * 3 + 1 : place], '') || array_to_string(nodes[place + 2 : place // 3 * 3 + 3], ''), place // 3, level + 1
  FROM up JOIN top USING (level) WHERE len(nodes) > 1),
whole AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1), whole"""
