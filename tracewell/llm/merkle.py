"""Merkle manifest of a dataset: levels built bottom-up and stored, proofs pushed top-down.

A tree for each source, and one over the sources' roots. Every 16 consecutive nodes (the last of a level: fewer) become the
node above, the hash of their digests one behind the other; each level is a table, a sixteenth of the one below. A proof goes
the other way: the stored levels join children to parents, and each child puts its siblings before the proof that its parent
has. So a level's proofs are made of those of the level above by one join on the parent, and only the leaves' own join makes
a row for each document. Siblings are never more than 15, whatever a source holds, and places in a source come from counted
ranges, so a source with a third of all documents is dealt to as many tasks as any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.shared import ranged, running, written

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One step of a proof: the digests left and right of a node among its parent's children.
STEP = "array<struct<left:string,right:string>>"


def hashed(*inputs: Column) -> Column:
    """SHA-256 of texts one behind the other, in lower-case hexadecimal digits."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field as a leaf holds it: '-' for null, else its UTF-8 length, ':', and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return hashed(*[framed(changed.get(c, F.col(c))) for c in FIELDS])


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of the id's decimal text; not without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def levels(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The levels of all trees, lowest first: (tree, place, digest, total), total being the nodes of the tree's level.

    ``nodes``: the same for the lowest level, places from 0. A tree is in as many levels as it needs to come down to one node.
    """
    out = [nodes]
    while out[-1].where("total > 1").limit(1).count():
        run = out[-1].where("total > 1").groupBy("tree", F.expr(f"place div {WIDTH}").alias("place"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda n: n["digest"]), "")
        above = run.agg(hashed(joined).alias("digest"), F.max(F.expr(f"(total + {WIDTH - 1}) div {WIDTH}")).alias("total"))
        out.append(written(above, f"{label}-level-{len(out)}"))
    return out


def roots(levels_: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the one node that each tree ends in."""
    out = levels_[0].where("total = 1").select("tree", "digest")
    for level in levels_[1:]:
        out = out.unionByName(level.where("total = 1").select("tree", "digest"))
    return out


def pushed(level: DataFrame, above: DataFrame | None, tops: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """(tree, place, digest, proof, *kept) of a level: children take their parent's proof, a tree's one node that of ``tops``.

    ``above``: (tree, place, proof) of the level over it; ``tops``: (tree, proof) of the trees' roots. A child's proof is its
    siblings, left and right of it, before what it inherits.
    """
    alone = level.where("total = 1").join(tops, "tree").select("tree", "place", "digest", "proof", *kept)
    if above is None:
        return alone
    run = level.where("total > 1").groupBy("tree", F.expr(f"place div {WIDTH}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", *kept))).alias("children"))
    over = above.select("tree", F.col("place").alias("parent"), "proof")
    both = run.join(over, ["tree", "parent"]).withColumn("digests", F.transform("children", lambda n: n["digest"])).select("tree", "digests", "proof", F.posexplode("children").alias("i", "child"))
    joined = lambda start, length: F.array_join(F.slice("digests", start, length), "")
    own = F.struct(joined(F.lit(1), F.col("i")).alias("left"), joined(F.col("i") + 2, F.lit(WIDTH)).alias("right"))
    return both.select("tree", "child.place", "child.digest", F.concat(F.array(own), "proof").alias("proof"), *[f"child.{c}" for c in kept]).unionByName(alone)


def placed(nodes: DataFrame, order: list[str | Column], label: str) -> DataFrame:
    """``nodes`` with their place in their tree, from 0, and the number of the tree's nodes."""
    dealt = ranged(nodes, ["tree", *order], label)
    return running(dealt, ["tree"], "part", [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("row")], F.lit(1).cast("long"), "place", "total").drop("part", "row")


def manifest(docs: DataFrame) -> DataFrame:
    """The leaves of ``docs`` with their proofs: doc_id, leaf, subroot, root, proof and, for the check, ``tampered_leaf``.

    A leaf holds doc_id, source, lang, n_chars and text, null or not; an empty text is not a null one. Documents of one id and
    source stand in the order of their leaves; repeated rows are a leaf each. Null sources are one source, the first; null ids
    come first in theirs. Long texts are hashed where they are read and go nowhere. Other columns, whatever their names, are
    left out. An empty table has no leaves and gives no rows.
    """
    lower = F.translate("text", UPPER, LOWER)
    # a key without nulls that sorts as the sources do, null first
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = docs.select(*[F.col(c) for c in FIELDS]).select("doc_id", tree.alias("tree"), leaf().alias("digest"), F.when(tampered(F.col("doc_id")), leaf(text=lower)).alias("changed"))
    leaves = written(placed(rows, [F.col("doc_id").asc_nulls_first(), "digest"], "leaves"), "placed-leaves")
    below = levels(leaves.select("tree", "place", "digest", "total"), "source")
    subroots = written(placed(roots(below).withColumnsRenamed({"tree": "source"}).withColumn("tree", F.lit(0)), ["source"], "subroots"), "placed-subroots")
    over = levels(subroots.select("tree", "place", "digest", "total"), "sources")
    # one row, whatever the input
    root = roots(over).select("tree", F.col("digest").alias("root"), F.array().cast(STEP).alias("proof"))
    top = root.select("tree", "proof")
    proofs = None
    for level in reversed(over[1:]):
        proofs = written(pushed(level, proofs, top), "proofs")
    sources = pushed(subroots, proofs, top, ("source",)).join(root.select("tree", "root"), "tree")
    tops = written(sources.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "proof"), "source-proofs")
    proofs = None
    for level in reversed(below[1:]):
        proofs = written(pushed(level, proofs, tops), "proofs")
    whole = pushed(leaves, proofs, tops, ("doc_id", "changed"))
    return whole.join(tops.select("tree", "subroot", "root"), "tree").select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", F.coalesce("changed", "digest").alias("tampered_leaf"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda node, step: hashed(step["left"], node, step["right"]))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document; see ``manifest``.

    The root is folded from the tampered leaf where there is one; a text without capitals is the same when tampered.
    """
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), "")
    rows = manifest(docs).select("doc_id", "leaf", "subroot", "root", hashed(siblings).alias("proof_sha256"), folded(F.col("tampered_leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int, source_depth: int) -> str:
    """SQL of ``verified`` for sources of at most 16^depth documents and at most 16^source_depth sources."""
    frame = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: "sha256(" + " || ".join(frame(text if c == "text" else c) for c in FIELDS) + ")"
    # fixed values: the polynomial of crc32 and its table, computed
    crc = (
        "crc AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),\n"
        "tab AS (SELECT list(v ORDER BY i) AS t FROM crc)"
    )
    digits = "list_concat([4294967295], list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)))"
    code = f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295)"
    lower = "translate(text, '" + UPPER + "', '" + LOWER + "')"
    parts = [crc, f"d AS (SELECT doc_id, source, {fields('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({code}) % 5 = 0 THEN {fields(lower)} END AS changed FROM documents, tab)"]
    parts.append("a0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, doc_id, leaf AS digest, leaf, coalesce(changed, leaf) AS node, '' AS proof FROM d)")

    def climb(name: str, depth: int) -> str:
        """Nodes of each level as {name}n<level>, their runs as {name}r<level>, and leaves with node and proof as {name}<level>."""
        parts.append(f"{name}n0 AS (SELECT tree, place, digest, count(*) OVER (PARTITION BY tree) AS total FROM {name}0)")
        for i in range(depth):
            parts.append(f"{name}r{i} AS (SELECT tree, place // 16 AS run, list(digest ORDER BY place) AS digests, max(total) AS total FROM {name}n{i} GROUP BY ALL)")
            parts.append(f"{name}n{i + 1} AS (SELECT tree, run AS place, CASE WHEN total > 1 THEN sha256(array_to_string(digests, '')) ELSE digests[1] END AS digest, CAST(ceil(total / 16.0) AS BIGINT) AS total FROM {name}r{i})")
            left, right = "array_to_string(digests[:place % 16], '')", "array_to_string(digests[place % 16 + 2:], '')"
            parts.append(
                f"{name}{i + 1} AS (SELECT a.* REPLACE (place // 16 AS place, CASE WHEN total > 1 THEN sha256({left} || node || {right}) ELSE node END AS node, CASE WHEN total > 1 THEN proof || {left} || {right} ELSE proof END AS proof)"
                f" FROM {name}{i} a JOIN {name}r{i} r ON a.tree IS NOT DISTINCT FROM r.tree AND a.place // 16 = r.run)"
            )
        return f"{name}{depth}"

    low = climb("a", depth)
    parts.append(f"b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, tree AS source, digest, digest AS subroot FROM an{depth})")
    parts.append(f"c0 AS (SELECT 0 AS tree, b.place, b.subroot, b.digest, l.doc_id, l.leaf, l.node, l.proof FROM {low} l JOIN b0 b ON l.tree IS NOT DISTINCT FROM b.source)")
    at = len(parts)
    climb("b", source_depth)
    # the tree over sources is built of subroots only; documents climb it by their source's place
    parts[at:] = [p for p in parts[at:] if not p.startswith(tuple(f"b{i} AS" for i in range(1, source_depth + 1)))]
    for i in range(source_depth):
        left, right = "array_to_string(digests[:place % 16], '')", "array_to_string(digests[place % 16 + 2:], '')"
        parts.append(
            f"c{i + 1} AS (SELECT c.* REPLACE (place // 16 AS place, CASE WHEN total > 1 THEN sha256({left} || node || {right}) ELSE node END AS node, CASE WHEN total > 1 THEN proof || {left} || {right} ELSE proof END AS proof)"
            f" FROM c{i} c JOIN br{i} r ON c.place // 16 = r.run)"
        )
    root = f"(SELECT digest FROM bn{source_depth})"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = {root} AS verified FROM c{source_depth}"


ORACLE = _oracle(7, 4)
