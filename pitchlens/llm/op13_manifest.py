"""Merkle dataset manifest: a hash tree over all rows, and for each row the siblings that prove it, by pointer jumping.

Each row is a leaf; leaves of a tree (one for each language) stand in order of
their id, runs of eight make a node of the next level, and the roots of the
trees are the leaves of a last tree whose top is the root of the data set.  Every
inner node starts with a pointer to its parent and the step there: the digests
of its siblings on either side.  A self-join then replaces a node's pointer by
that of the node it points to and joins the steps, so the distance doubles each
round until every node points to the root.  A leaf's run jumps last, once for
eight leaves, when its node has the whole way; so no round moves the leaves,
and nodes that nobody points to any more are left out of the rounds.

Rows are numbered by a range partition in order of (tree, id, digest) and the
counts of the partitions before; no window holds a tree.  Every level and round
is written to the shared folder.  Joins are by node, so near the root many nodes
ask for one: adaptive execution splits such keys, and a level of few nodes is
small enough for it to be sent to all.  The driver gets the size of the largest
tree, the number of trees and one digest, the root.

Defined results: null fields are ``-`` in the digest, which no value gives;
a null id stands first in its tree and is never tampered with; a null language
is the first tree; rows of the same id are ordered by digest, and repeated rows
are leaves of their own, which may change places; empty and very long texts are
values like others; one row alone is leaf, subroot and root, with the digest of
nothing as its proof; an empty table has no rows and no root; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchlens.llm._sql import CRC32, crc32
from pitchlens.llm._text import ascii_lower, read
from pitchlens.session import materialize

#: Children of a node.
WIDTH = 8
#: The tree of the subroots; languages' names start with a plus or are empty.
TOP = "^"

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value such that no two rows of fields read alike: its length in bytes, a colon, itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their number from 0 in their tree by ``order``, and ``n``, the rows of the tree.

    Equal rows are told apart by where they were read, so that no number of them fills a partition.
    """
    by = [F.col(c).asc_nulls_first() for c in [tree, *order]]
    rows = rows.withColumn("_from", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by, F.col("_from")).sortWithinPartitions(*by, F.col("_from")).drop("_from")
    rows = materialize(rows.withColumn("_line", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_line", 33)
    counts = rows.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    whole = Window.partitionBy("_tree")
    counts = counts.select("_tree", "_part", "_first", F.sum("_n").over(whole).alias("n"), F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    both = rows.withColumn("_p", part).join(counts, (F.col(tree) == F.col("_tree")) & (F.col("_p") == F.col("_part")))
    return both.select(*rows.drop("_line").columns, (F.col("_line") - F.col("_first") + F.col("_before")).alias("at"), "n")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and the tops of the trees.

    nodes: t, l, i (which node: tree, level and number), tree, at (where it
    stands), n (how many stand there), d (digest), row (what a leaf carries).
    A run has tree, j (the number of the node that it makes), n, run.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while most > 1:
        grouped = nodes.where("n > 1").groupBy("tree", F.expr(f"at div {WIDTH}").alias("j"))
        runs = materialize(grouped.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "t", "l", "i", "d", "row"))).alias("run")), "runs")
        tops.append(nodes.where("n = 1"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: hexed(x["d"])), ""), 256))
        nodes = runs.select(F.col("tree").alias("t"), F.lit(len(levels) + 1).alias("l"), F.col("j").alias("i"), "tree", F.col("j").alias("at"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), digest.alias("d"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
        levels.append(runs)
        most = -(-most // WIDTH)
    for top in tops:
        nodes = nodes.unionByName(top)
    return levels, nodes.where("n = 1")


def steps(run: str) -> Column:
    """For each member of a run what is beside it: the digests to the left and to the right."""
    def beside(some: Column) -> Column:
        return F.unhex(F.array_join(F.transform(some, lambda y: hexed(y["d"])), ""))

    return F.transform(run, lambda x, k: F.struct(x.alias("node"), F.struct(beside(F.slice(run, F.lit(1), k)).alias("left"), beside(F.slice(run, k + 2, F.lit(WIDTH))).alias("right")).alias("step")))


def ways(levels: list[DataFrame], root: tuple, depth: int) -> DataFrame:
    """(t, l, i, way): the steps from each node in ``levels`` that leaves' runs ask for to the root, by pointer jumping."""
    nodes = None
    for level, runs in levels:
        some = runs.select("tree", "j", F.explode(steps("run")).alias("x"))
        some = some.select("x.node.t", "x.node.l", "x.node.i", F.col("tree").alias("to_t"), F.lit(level).alias("to_l"), F.col("j").alias("to_i"), F.array("x.step").alias("way"))
        nodes = some if nodes is None else nodes.unionByName(some)
    arrived = (F.col("to_t") == root[0]) & (F.col("to_l") == root[1]) & (F.col("to_i") == root[2])
    nodes, far = materialize(nodes, "ways"), 1
    while far < depth:
        # what is pointed to stands so many levels above another inner node, or in the last tree
        ahead = nodes.where((F.col("t") == TOP) | (F.col("l") > far)).select(*[F.col(c).alias(f"_{c}") for c in nodes.columns])
        jumped = nodes.where(~arrived).join(ahead, (F.col("to_t") == F.col("_t")) & (F.col("to_l") == F.col("_l")) & (F.col("to_i") == F.col("_i")))
        jumped = jumped.select("t", "l", "i", *[F.col(f"_{c}").alias(c) for c in ("to_t", "to_l", "to_i")], F.concat("way", "_way").alias("way"))
        far *= 2
        asked = (F.col("l") <= 1) | (F.col("t") == TOP) | (F.col("l") > far)
        nodes = materialize(jumped.unionByName(nodes.where(arrived)).where(asked), "ways")
    return nodes.select("t", "l", "i", "way")


def prove(rows: DataFrame, tree: str, order: list[str], digest: str) -> tuple[DataFrame, str | None]:
    """The proofs of all rows, and the root.

    rows: ``tree``, a string that is not null, ``digest`` as bytes, and the columns
    of ``order`` by which leaves ascend (then by digest).  The proofs have
    row (a struct of the row's columns), subroot (bytes) and way, an array of
    (left, right), from the leaf's own run to the root.
    """
    leaves = numbered(materialize(rows, "digests"), tree, [*order, digest])  # else texts are read once more to find the ranges
    leaves = leaves.select(F.col(tree).alias("t"), F.lit(0).alias("l"), F.col("at").alias("i"), F.col(tree).alias("tree"), "at", "n", F.col(digest).alias("d"), F.struct(*rows.columns).alias("row"))
    levels, tops = climb(leaves)
    tops = materialize(tops.select("t", "l", "i", "d", "row"), "subroots")
    last = numbered(tops.select("t", "l", "i", "d", "row", F.lit(TOP).alias("_all")), "_all", ["t"])
    over, top = climb(last.select("t", "l", "i", F.col("_all").alias("tree"), "at", "n", "d", "row"))
    found = top.select("t", "l", "i", hexed(F.col("d")).alias("d")).first()
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    # the leaves, run by run, and the node from which the run goes on; a leaf alone in its tree goes on from itself
    alone = leaves.where("n = 1").select("t", "l", "i", F.array(F.struct("row", "d", none.alias("first"))).alias("members"))
    groups = alone
    if levels:
        members = F.transform(steps("run"), lambda x: F.struct(x["node"]["row"].alias("row"), x["node"]["d"].alias("d"), F.array(x["step"]).alias("first")))
        groups = levels[0].select(F.col("tree").alias("t"), F.lit(1).alias("l"), F.col("j").alias("i"), members.alias("members")).unionByName(alone)
    links = [(k + 1, r) for k, r in enumerate(levels) if k] + [(k + 1, r) for k, r in enumerate(over)]
    if links:
        way = ways(links, (found["t"], found["l"], found["i"]), max(0, len(levels) - 1) + len(over))
        way = way.select(*[F.col(c).alias(f"_{c}") for c in way.columns])
        groups = groups.join(way, (F.col("t") == F.col("_t")) & (F.col("l") == F.col("_l")) & (F.col("i") == F.col("_i")), "left")
    else:
        groups = groups.withColumn("_way", none)
    out = groups.select("t", F.explode("members").alias("x"), F.coalesce("_way", none).alias("_way"))
    out = out.select("t", F.col("x.row").alias("row"), F.concat("x.first", "_way").alias("way"))
    subroots = tops.select(F.col("t").alias("_t"), F.col("d").alias("subroot"))
    return out.join(subroots, F.col("t") == F.col("_t")).select("row", "subroot", "way"), found["d"] if found else None


def siblings(way: str) -> Column:
    """All digests of a proof, level by level and from left to right, as hex text."""
    return F.array_join(F.transform(way, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


def folded(start: Column, way: str) -> Column:
    """The root, as hex text, that a leaf's digest (hex text) and its siblings give."""
    return F.aggregate(way, start, lambda at, s: F.sha2(F.concat(hexed(s["left"]), at, hexed(s["right"])), 256))


def manifest(documents: DataFrame) -> tuple[DataFrame, str | None]:
    """Proofs of ``documents``: row (doc_id, tree, leaf, other: the digest after tampering, or null), subroot, way; and the root."""
    doc_id = F.col("doc_id")
    values = [F.col(c) for c in FIELDS]
    changed = [*values[:-1], ascii_lower(F.col("text"))]
    tampered = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 0
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("lang")))  # null first, then by bytes
    rows = documents.select("doc_id", tree.alias("tree"), leaf(values).alias("leaf"), F.when(tampered, leaf(changed)).alias("other"))
    return prove(rows, "tree", ["doc_id"], "leaf")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, checked against the root after the texts of a third of them were lower-cased."""
    proofs, root = manifest(read(spark, sf_dir, "documents"))
    out = proofs.select("row.doc_id", hexed(F.col("row.leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), F.sha2(siblings("way"), 256).alias("proof_sha256"),
                        folded(hexed(F.coalesce("row.other", "row.leaf")), "way").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8, last: int = 3) -> str:
    """The query in DuckDB's SQL, level by level without pointers, for up to 8 ** levels rows of a language and 8 ** last languages."""
    def row(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in ["doc_id", "source", "lang", "n_chars", text]]
        return f"sha256({' || '.join(parts)})"

    def up(name: str, k: int) -> str:
        return f"""{name}{k + 1} AS (SELECT t, i // 8 AS i, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
            FROM {name}{k} GROUP BY t, i // 8, n),
        {name}_run{k} AS (SELECT t, i // 8 AS j, list(d ORDER BY i) AS ds FROM {name}{k} WHERE n > 1 GROUP BY t, i // 8)"""

    def beside(before: str, after: str, run: str, t: str, at: str, k: int) -> str:
        own = f"({at} // {8**k}) % 8"
        left, right = f"array_to_string(ds[1:{own}], '')", f"array_to_string(ds[{own} + 2:], '')"
        return f"""{after} AS (SELECT p.* REPLACE (CASE WHEN ds IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN ds IS NULL THEN proof ELSE proof || {left} || {right} END AS proof)
            FROM {before} p LEFT JOIN {run}{k} r ON r.t = {t} AND r.j = {at} // {8 ** (k + 1)})"""

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [CRC32, f"""own AS (SELECT doc_id, lang, {row("text")} AS leaf, CASE WHEN {crc32("[ord(c) for c in string_split(doc_id::VARCHAR, '')]")} % 3 = 0 THEN {row(lower)} END AS other FROM documents, crc32_table)""",
            "leaves AS (SELECT doc_id, leaf, other, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM own))",
            "a0 AS (SELECT t, i, n, leaf AS d FROM leaves)", *[up("a", k) for k in range(levels)],
            f"b0 AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, d FROM a{levels})", *[up("b", k) for k in range(last)],
            "p0 AS (SELECT doc_id, t, i, leaf, coalesce(other, leaf) AS f, '' AS proof FROM leaves)",
            *[beside(f"p{k}", f"p{k + 1}", "a_run", "p.t", "p.i", k) for k in range(levels)],
            *[beside(f"p{levels + k}", f"p{levels + k + 1}", "b_run", "0", "p.t", k) for k in range(last)]]
    return f"""WITH {", ".join(ctes)}
        SELECT p.doc_id, p.leaf, s.d AS subroot, r.d AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.d AS verified
        FROM p{levels + last} p JOIN a{levels} s ON s.t = p.t CROSS JOIN b{last} r"""
