"""Merkle manifest of a dataset: a hash per row, per source and for all, and the proof of each row.

Leaves of a source are ranked by doc_id. The rank, read in digits of base FAN, says where a leaf
stands: grouping the last digit away nests FAN leaves in their parent, grouping the next one away
nests FAN parents, and so on. A block is what two digits hold, so no row ever nests more than
FAN * FAN leaves. The roots of blocks are ranked nodes again and go through the same rollup, tier by
tier, until one node is left for a source; the sources' nodes are then leaves of one more tree.

Proofs run the other way: a block meets the path from its root to the top (one row a block, brought
together by an aggregation), and transform and explode hand it down to the leaves. No join carries a
proof, and no group is larger than a block, whatever share of the rows a source holds.

Ranks come from a range partitioning: row numbers inside a part of a source, plus the sizes of the
parts before it, a table with a row for each source and part.

Defined cases: null fields hash as `-`; a null source is a source of its own, first in order; rows
without id stand first in their source and are never tampered with; repeated rows are leaves each, in
either order; a null or empty text is a leaf like any other; an empty table gives no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .staging import staged

FAN = 16
BLOCK = FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_PATH = "CAST(array() AS array<struct<before:string,after:string>>)"


def field(value: Column) -> Column:
    """A value as it enters a leaf: its bytes in UTF-8, a colon, and itself; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def lower_cased() -> Column:
    """The leaf of a row whose text has lost its capitals A-Z, for rows that the check tampers with."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf_hash(text=F.translate("text", _UPPER, _LOWER)))


def _ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds rank and n to nodes: the place of a node in its group by an order, and the size of the group."""
    spread = nodes.repartitionByRange("group", *order, "salt")
    placed = staged(spread.withColumn("part", F.spark_partition_id()), name)
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("group", "part").agg(F.count("*").alias("size"))
    starts = sizes.select(
        "group",
        "part",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        F.sum("size").over(Window.partitionBy("group")).alias("n"),
    )
    within = Window.partitionBy("group", "part").orderBy(*order, "salt")
    numbered = placed.withColumn("row", F.row_number().over(within) - 1).join(starts, ["group", "part"])
    return numbered.withColumn("rank", F.col("start") + F.col("row")).drop("start", "row", "part", "salt")


def _rolled(nodes: DataFrame) -> DataFrame:
    """group, block, n, runs, hash: two rank digits grouped away, the nodes nested in runs of FAN.

    A level hashes only if its group has more than one node there; else the lone node goes up as it is.
    """

    def up(children: str, more: Column) -> Column:
        hashes = F.col(children)["hash"]
        return F.when(more, F.sha2(F.array_join(hashes, ""), 256)).otherwise(F.element_at(hashes, 1))

    digits = nodes.select(
        "group",
        "n",
        F.floor(F.col("rank") / BLOCK).alias("block"),
        (F.floor(F.col("rank") / FAN) % FAN).cast("int").alias("high"),
        F.struct((F.col("rank") % FAN).cast("int").alias("low"), "hash", "extra").alias("node"),
    )
    runs = digits.groupBy("group", "n", "block", "high").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    runs = runs.withColumn("hash", up("nodes", F.col("n") > 1))
    blocks = runs.groupBy("group", "n", "block").agg(F.sort_array(F.collect_list(F.struct("high", "hash", "nodes"))).alias("runs"))
    return blocks.withColumn("hash", up("runs", F.col("n") > FAN))


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of every tier, lowest first; the last tier has one block for each group."""
    tiers = []
    while True:
        tiers.append(staged(_rolled(nodes), name))
        if tiers[-1].where("block > 0").isEmpty():
            return tiers
        nodes = tiers[-1].select(
            "group", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "hash", F.lit(0).alias("extra")
        )


def _handed_down(blocks: DataFrame) -> DataFrame:
    """A row for each node of blocks that know their path: group, rank, hash, extra, path, seal."""

    def others(all_nodes: str, place: Column) -> Column:
        hashes = F.col(all_nodes)["hash"]
        return F.struct(
            F.array_join(F.slice(hashes, F.lit(1), place), "").alias("before"),
            F.array_join(F.slice(hashes, place + 2, F.lit(FAN)), "").alias("after"),
        )

    def longer(step: Column, more: Column) -> Column:
        return F.when(more, F.concat(F.array(step), "path")).otherwise(F.col("path"))

    runs = blocks.select("group", "block", "n", "path", "seal", "runs", F.posexplode("runs").alias("i", "run"))
    runs = runs.withColumn("path", longer(others("runs", F.col("i")), F.col("n") > FAN))
    nodes = runs.select("group", "block", "n", "path", "seal", F.col("run")["high"].alias("high"), F.col("run")["nodes"].alias("nodes"))
    nodes = nodes.select("*", F.posexplode("nodes").alias("j", "node"))
    return nodes.select(
        "group",
        (F.col("block") * BLOCK + F.col("high") * FAN + F.col("node")["low"]).alias("rank"),
        F.col("node")["hash"].alias("hash"),
        F.col("node")["extra"].alias("extra"),
        longer(others("nodes", F.col("j")), F.col("n") > 1).alias("path"),
        "seal",
    )


def _met(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the path and the seal from above them: two kinds of rows of a block, grouped."""
    paths = above.select("group", F.col("rank").alias("block"), "path", "seal")
    both = blocks.select("group", "block", "n", "runs").unionByName(paths, allowMissingColumns=True)
    kept = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "runs", "path", "seal")]
    return both.groupBy("group", "block").agg(*kept)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, tampered (a leaf to be tried in its place, or null), path, subroot, root of every row.

    path has the siblings of each level from the leaf up: the hashes before and after the node's own.
    """
    tampered = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(
        # nulls first, then by bytes
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("group"),
        F.col("doc_id").alias("id"),
        leaf_hash().alias("hash"),
        F.struct("doc_id", "source", tampered.alias("tampered")).alias("extra"),
        F.monotonically_increasing_id().alias("salt"),
    )
    ranked = _ranked(staged(leaves, "leaves"), ["id", "hash"], "leaves")
    own = _climb(ranked.drop("id"), "manifest")

    subroots = own[-1].select(
        F.lit("").alias("group"), F.col("group").alias("id"), "hash", F.struct(F.col("group").alias("source")).alias("extra"), F.lit(0).alias("salt")
    )
    shared = _climb(_ranked(subroots, ["id"], "subroots").drop("id"), "manifest")

    top = shared[-1].select("*", F.expr(_NO_PATH).alias("path"), F.struct(F.col("hash").alias("root")).alias("seal"))
    above = _handed_down(top)
    for blocks in reversed(shared[:-1]):
        above = _handed_down(_met(blocks, above))
    above = above.select(
        F.col("extra")["source"].alias("group"),
        F.lit(0).cast("long").alias("rank"),
        "path",
        F.struct(F.col("hash").alias("subroot"), F.col("seal")["root"].alias("root")).alias("seal"),
    )
    for blocks in reversed(own):
        above = _handed_down(_met(blocks, above))
    return above.select("extra.*", F.col("hash").alias("leaf"), "path", "seal.subroot", "seal.root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _sql(levels: int = 6) -> str:
    """The twin: levels of 16 spelled out, enough for 16 ** levels rows of a source and as many sources."""

    def levels_of(of: str, first: str) -> list[str]:
        out = []
        for k in range(levels):
            src = first if k == 0 else f"{of}{k - 1}u"
            run = "PARTITION BY grp, r // 16 ORDER BY r ROWS BETWEEN"
            out.append(
                f"{of}{k} AS (SELECT grp, r, n, hash, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS pre, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS post FROM {src})"
            )
            out.append(
                f"{of}{k}u AS (SELECT grp, r // 16 AS r, (any_value(n) + 15) // 16 AS n, "
                f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(hash, '' ORDER BY r)) ELSE any_value(hash) END AS hash FROM {src} GROUP BY grp, r // 16)"
            )
        return out

    def fold(of: str, carry: str, src: str, key: str) -> list[str]:
        out = []
        for k in range(levels):
            before = src if k == 0 else f"{carry}{k - 1}"
            out.append(
                f"{carry}{k} AS (SELECT x.* REPLACE (CASE WHEN t.pre IS NULL THEN x.f ELSE sha256(t.pre || x.f || t.post) END AS f, "
                f"x.sib || coalesce(t.pre || t.post, '') AS sib) FROM {before} x JOIN {of}{k} t ON t.grp = {key[0]} AND t.r = {key[1]} // {16**k})"
            )
        return out

    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {value(text)})"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, {leaf('text')} AS hash, "
        f"CASE WHEN {crc} % 5 = 0 THEN {leaf(f'''translate(text, '{_UPPER}', '{_LOWER}')''')} END AS changed FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM d)",
        *levels_of("a", "n0"),
        f"s AS (SELECT grp AS source, hash, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS r, count(*) OVER () AS n FROM a{levels - 1}u)",
        *levels_of("b", "s"),
        "x AS (SELECT n0.doc_id, n0.grp, n0.r, n0.hash AS leaf, coalesce(n0.changed, n0.hash) AS f, '' AS sib, s.hash AS subroot, s.r AS sr, "
        f"(SELECT hash FROM b{levels - 1}u) AS root FROM n0 JOIN s ON s.source = n0.grp)",
        *fold("a", "fa", "x", ("x.grp", "x.r")),
        *fold("b", "fb", f"fa{levels - 1}", ("''", "x.sr")),
    ]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified "
        f"FROM fb{levels - 1}"
    )


@query("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its possibly tampered leaf leads to the root."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    sealed = manifest(docs, lower_cased())
    folds = sealed.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return folds.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
