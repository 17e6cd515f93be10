"""Merkle manifest of a dataset: digests of aligned blocks, a root above them, and each row's proof of membership."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, drop_kept, id_bucket, keep, read

#: Nodes of a run, and levels that a block holds: FAN**DEPTH nodes are the most that one call traverses.
FAN, DEPTH = 8, 4
_PATH = "array<struct<left:string,right:string>>"
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: list[str]) -> str:
    """Lower-case hex SHA-256 of the parts put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """Runs of FAN that are taken until one of n nodes is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def traverse(nodes: list[str], depth: int, paths: list[list[tuple[str, str]]] | None = None) -> str:
    """The digest of the tree of that depth over nodes, a block in its order.

    Postorder: a call returns the digest of its subtree; while the calls above it unwind, each appends to the leaves below a
    child what stands left and right of that child. So a leaf's path grows from its own level upwards."""

    def below(level: int, first: int) -> str:
        if not level:
            return nodes[first]
        width = FAN ** (level - 1)
        starts = range(first, min(first + FAN * width, len(nodes)), width)
        run = [below(level - 1, a) for a in starts]
        if paths is not None:
            for i, a in enumerate(starts):
                beside = ("".join(run[:i]), "".join(run[i + 1 :]))
                for leaf in range(a, min(a + width, len(nodes))):
                    paths[leaf].append(beside)
        return digest(run)

    return below(depth, 0)


def numbered(df: DataFrame, group: str, by: list[Column]) -> DataFrame:
    """df, written, with pos (from 0 in each value of group, in the order of by) and total (rows of that value).

    Rows are dealt by ranges of group and order, and their place in the input where these are equal, so that neither a large
    group nor a repeated key meets in one task. A range counts its own rows; the table of counts, a row for each range and
    group in it, gives the offsets."""
    put = keep(df.withColumn("_row", F.monotonically_increasing_id()))
    order = [F.col(group).asc_nulls_first(), *by, F.col("_row")]
    ranged = keep(put.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    drop_kept(put)
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("total"))
    met = ranged.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_g", "_shift")


def _block(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, their digests, and the levels to take: all of them if other blocks are beside it."""
    table = table.sort_by("pos")
    total = table.column("total")[0].as_py()
    return table, table.column("digest").to_pylist(), DEPTH if total > FAN**DEPTH else levels(total)


def _roots(nodes: DataFrame) -> DataFrame:
    """(grp, pos, digest, total): the roots of the blocks of nodes, as nodes of the next table."""

    def root(table: pa.Table) -> pa.Table:
        table, digests, depth = _block(table)
        total = -(-table.column("total")[0].as_py() // FAN**DEPTH)
        return table.slice(0, 1).select(["grp", "block"]).append_column("digest", pa.array([traverse(digests, depth)])).append_column("total", pa.array([total], pa.int64()))

    return nodes.select("grp", "block", "pos", "total", "digest").groupBy("grp", "block").applyInArrow(root, "grp string, block long, digest string, total long").withColumnRenamed("block", "pos")


def _forest(nodes: DataFrame) -> list[DataFrame]:
    """The written tables of nodes from (grp, pos, total, digest) up to that in which every group has one node."""
    block = F.floor(F.col("pos") / F.lit(FAN**DEPTH)).cast("long")
    out = [keep(nodes.withColumn("block", block))]
    while not out[-1].where("total > 1").isEmpty():
        out.append(keep(_roots(out[-1]).withColumn("block", block)))
    return out


def _paths(found: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [x for path in found for x in path]
    offsets = [0]
    for path in found:
        offsets.append(offsets[-1] + len(path))
    sides = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sides)


def _unwound(nodes: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """nodes with the path through their block and then that of the block in above, and above's texts in carry."""
    own = [c for c in nodes.columns if c not in ("block", "total")]

    def paths(mine: pa.Table, top: pa.Table) -> pa.Table:
        mine, digests, depth = _block(mine)
        rest = [(x["left"], x["right"]) for x in top.column("path")[0].as_py()]
        found: list[list[tuple[str, str]]] = [[] for _ in digests]
        traverse(digests, depth, found)
        out = mine.select(own).append_column("path", _paths([x + rest for x in found]))
        for c in carry:
            out = out.append_column(c, pa.array([top.column(c)[0].as_py()] * len(digests), pa.string()))
        return out

    types = dict(nodes.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in own] + [f"path {_PATH}"] + [f"{c} string" for c in carry])
    return nodes.groupBy("grp", "block").cogroup(above.select("grp", "block", "path", *carry).groupBy("grp", "block")).applyInArrow(paths, schema)


def _down(tables: list[DataFrame], top: DataFrame, carry: list[str]) -> DataFrame:
    """Paths of the nodes of tables[0]; top has those of the one node that each group has in the last table."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for nodes in tables[-2:0:-1]:
        above = keep(_unwound(nodes.select("grp", "block", "pos", "total", "digest"), above, carry).withColumn("block", F.col("pos")))
    if len(tables) > 1:
        return _unwound(tables[0], above, carry)
    return tables[0].drop("block", "total").join(top.select(F.col("grp").alias("_g"), "path", *carry), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, leaf, subroot, root, path) of every row of leaves.

    Each value of group, a string, has a tree over its leaves in the order of key (nulls first, ties by digest); one more tree
    stands over these subroots in the order of group (null first, bytewise). While several nodes remain, each FAN
    consecutive ones, the last run fewer, become the digest of theirs; a lone leaf is its tree's root. path has, from
    the leaf up to root, what stands left and right of its node in each run.

    A task sees one block of FAN**DEPTH nodes, however large a group is; the blocks' roots, one in thousands, are a table
    like the leaves, traversed the same way. Rows that repeat are leaves of their own; a null group or key is a value
    like others; an empty table gives no row. A carried column that is named as a result gets an underscore behind its name."""
    own = ["leaf", "subroot", "root", "path"]
    taken = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    mine = leaves.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{key}`").alias("_key"), F.col(f"`{leaf}`").alias("digest"), *taken)
    low = _forest(numbered(mine, "grp", [F.col("_key").asc_nulls_first(), F.col("digest")]).drop("_key"))
    groups = low[-1].select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest")
    ranked = keep(numbered(groups, "grp", [F.col("member").asc_nulls_first()]))
    high = _forest(ranked.drop("member"))
    end = high[-1].select("grp", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    over = _down(high, end, ["root"]).select(F.col("pos").alias("_pos"), F.col("digest").alias("subroot"), "path", "root")
    top = keep(ranked.join(over, F.col("pos") == F.col("_pos")).select(F.col("member").alias("grp"), "path", "subroot", "root"))
    out = _down(low, top, ["subroot", "root"])
    names = apart(carry, own)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings of a path together, level by level."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def field(c: Column) -> Column:
    """A value as a leaf holds it: its UTF-8 byte count, a colon and itself; - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' fields put together."""
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document's leaf, subroot, root and proof, and whether its text, lower-cased where 3 divides its id's
    CRC-32, still leads to root."""
    docs = read(spark, sf_dir, "documents")
    row = lambda text: row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    leaves = docs.select("doc_id", "lang", row(F.col("text")).alias("digest"), F.when(id_bucket("doc_id", 3) == 0, row(F.translate("text", _ASCII, _ASCII.lower()))).alias("other"))
    out = manifest(leaves, "lang", "doc_id", "digest", ("doc_id", "other"))
    root = folded(F.coalesce("other", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1)))"
    bits = "list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _beside(frame: str) -> str:
    return f"coalesce(string_agg(digest, '') OVER (PARTITION BY g, level, pos // {FAN} ORDER BY pos ROWS BETWEEN {frame}), '')"


_UP = f"level + 1, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + {FAN - 1}) // {FAN})"
_SIDES = f"{_beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {_beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE 'x' || lang END AS g, {_leaf('text')} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(f"translate(text, '{_ASCII}', '{_ASCII.lower()}')")} END AS other FROM documents)),
low AS (SELECT g, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM d UNION ALL SELECT g, {_UP} FROM low WHERE n > 1 GROUP BY g, level, pos // {FAN}),
sub AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS place FROM low WHERE n = 1),
high AS (SELECT '' AS g, 0 AS level, place AS pos, digest, count(*) OVER () AS n FROM sub UNION ALL SELECT '', {_UP} FROM high WHERE n > 1 GROUP BY level, pos // {FAN}),
steps AS (SELECT d.id, x.level, l, r FROM d JOIN (SELECT *, {_SIDES} FROM low WHERE n > 1) x ON x.g = d.g AND x.pos = d.pos // CAST(pow({FAN}, x.level) AS BIGINT)
  UNION ALL SELECT d.id, 100 + x.level, l, r FROM d JOIN sub ON sub.g = d.g JOIN (SELECT *, {_SIDES} FROM high WHERE n > 1) x ON x.pos = sub.place // CAST(pow({FAN}, x.level) AS BIGINT)),
path AS (SELECT id, string_agg(l || r, '' ORDER BY level) AS proof, list({{'l': l, 'r': r, 'd': ''}} ORDER BY level) AS x FROM steps GROUP BY id),
done AS (SELECT d.*, sub.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_concat([{{'l': '', 'r': '', 'd': coalesce(other, leaf)}}], coalesce(x, [])), lambda a, s: {{'l': '', 'r': '', 'd': sha256(s.l || a.d || s.r)}}).d AS folded_root
  FROM d JOIN sub ON sub.g = d.g LEFT JOIN path ON path.id = d.id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done"""
