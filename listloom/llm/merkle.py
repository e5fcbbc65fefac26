"""Merkle manifest of a table: a tree of hashes for each language, a tree of their roots above, and a proof for each row.

Leaves are numbered within their tree; a node carries the interval of leaf numbers that it covers. A node of level k covers
at most 8**k leaves and its number there is its interval's start divided by that, so a node and the ancestor one level up
meet in a join on (tree, bucket of the level) whose intervals contain one another. A node's siblings are what is left of
the parent's interval without its own: the parent's children before it and after it. No join gathers more than 8 rows.

Numbers come from range partitions: rows are counted within a partition, and the partitions' totals, one row each, give every
partition its start. A hot language is as many partitions as its share of the rows. Each level is a table of its own in the
session's shared folder, an eighth of the one below; the texts are read once.

Leaves ascend by doc_id, null ids first; equal ids go by their hashes, and rows that are equal throughout have the same hash
and proofs of their own. A null value is hashed as `-`. Rows with a null language form a tree, the first. An empty table
gives an empty table. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import stored
from .frames import table

#: Children of a node, and one of so many ids whose row is tampered with by the registered query.
FANOUT, TAMPERED = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that fields can't run into one another."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id", changed: Column | None = None, text: str = "text") -> DataFrame:
    """tree, doc_id, leaf, altered: the hash of each row's fields, and that with another text, null where it is the same.

    `tree` is a text that sorts like the column of that name, null first.
    """
    now = digest(*(field(F.col(f)) for f in fields))
    then = F.when(changed != F.col(text), digest(*(field(changed if f == text else F.col(f)) for f in fields))) if changed is not None else F.lit(None).cast("string")
    key = F.when(F.col(tree).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    return docs.select(key.alias("tree"), F.col(doc_id).cast("long").alias("doc_id"), now.alias("leaf"), then.alias("altered"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with `tree`) and their number in the tree from 0 (`lo`, and `hi` one above), and the tree's size `n`."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows are dealt too; any order of them is right
    ranged = stored(spread.repartitionByRange("tree", *order, "_tie").withColumn("_piece", F.spark_partition_id()), name)
    totals = ranged.groupBy("tree", "_piece").agg(F.count("*").alias("_n"))
    by_tree = Window.partitionBy("tree")
    so_far = by_tree.orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("tree", "_piece", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"), F.sum("_n").over(by_tree).alias("n"))
    inner = Window.partitionBy("tree", "_piece").orderBy(*order, "_tie")
    placed = ranged.withColumn("_nth", F.row_number().over(inner) - 1).join(starts, ["tree", "_piece"])
    lo = (F.col("_before") + F.col("_nth")).cast("long")
    return placed.select(*rows.columns, lo.alias("lo"), (lo + 1).alias("hi"), "n")


def _bucket(level: int) -> Column:
    return F.floor(F.col("lo") / F.lit(FANOUT**level)).cast("long")


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The tables of inner nodes from the lowest level up: tree, n, bucket, lo, hi, kids (lo, hi, h) and h.

    nodes: the leaves as tree, n, lo, hi, h. A tree of n leaves has a node on a level only where n asks for it: the level
    of the root is the first whose one node covers all.
    """
    largest = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    made: list[DataFrame] = []
    while FANOUT ** len(made) < largest:
        below = nodes.where(F.col("n") > FANOUT ** len(made)).withColumn("bucket", _bucket(len(made) + 1))
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "h")))  # at most FANOUT of them
        grouped = below.groupBy("tree", "n", "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
        nodes = stored(grouped.withColumn("h", digest(F.array_join(F.col("kids")["h"], ""))), f"{name}-{len(made) + 1}")
        made.append(nodes)
    return made


def roots(nodes: DataFrame, made: list[DataFrame]) -> DataFrame:
    """tree, h: what remains of each tree, a lone leaf itself."""
    found = nodes.where("n = 1").select("tree", "h")
    for k, level in enumerate(made, 1):
        found = found.unionAll(level.where((F.col("n") <= FANOUT**k) & (F.col("n") > FANOUT ** (k - 1))).select("tree", "h"))
    return found


def attached(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """nodes of the level below with `above`: their siblings and those of each ancestor, from the lowest up.

    A parent is the node of its level whose interval contains the node's own.
    """
    up = parents.select("tree", F.col("bucket").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("above").alias("_above"), *(c for c in ("subroot", "root") if c in parents.columns))
    inside = nodes.withColumn("_bucket", _bucket(level)).join(up, ["tree", "_bucket"]).where("_lo <= lo and hi <= _hi")
    left = F.array_join(F.filter("_kids", lambda k: k["hi"] <= F.col("lo"))["h"], "")
    right = F.array_join(F.filter("_kids", lambda k: k["lo"] >= F.col("hi"))["h"], "")
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    return inside.withColumn("above", F.concat(own, "_above")).drop("_bucket", "_lo", "_hi", "_kids", "_above")


def proofs(nodes: DataFrame, made: list[DataFrame], tops: DataFrame) -> DataFrame:
    """nodes with `above` up to the root and on through `tops` (tree, above and other columns for each root)."""
    ready = None
    for k in range(len(made), -1, -1):
        level = made[k - 1] if k else nodes
        first = level.where((F.col("n") <= FANOUT**k) & (F.col("n") > (FANOUT ** (k - 1) if k else 0))).join(tops, "tree")
        rest = attached(level.where(F.col("n") > FANOUT**k), ready, k + 1) if ready is not None else None
        ready = first if rest is None else first.unionByName(rest)
    return ready


def proof(above: Column) -> Column:
    """The siblings' hashes one after another, level by level, left to right."""
    return F.array_join(F.transform(above, lambda s: F.concat(s["left"], s["right"])), "")


def folded(h: Column, above: Column) -> Column:
    """The root that a hash and its siblings give."""
    return F.aggregate(above, h, lambda acc, s: digest(s["left"], acc, s["right"]))


def manifest(rows: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, altered, subroot, root and `above`, an array of (left, right), for each of `leaves`."""
    own = numbered(stored(rows, "leaves"), ["doc_id", "leaf"], "ranged")
    own = stored(own, "numbered")
    nodes = own.withColumnRenamed("leaf", "h")
    made = levels(nodes.select("tree", "n", "lo", "hi", "h"), "level")
    subroots = stored(roots(nodes, made), "subroots")
    top = stored(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), ["name"], "top"), "top-numbered")
    over = levels(top.select("tree", "n", "lo", "hi", "h"), "top-level")
    one = roots(top, over).select("tree", F.array().cast(f"array<{_STEP}>").alias("above"), F.col("h").alias("root"))
    tops = proofs(top, over, one).select(F.col("name").alias("tree"), "above", F.col("h").alias("subroot"), "root")
    return proofs(nodes, made, stored(tops, "tops")).select("tree", "doc_id", F.col("h").alias("leaf"), "altered", "subroot", "root", "above")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    rows = leaves(docs, changed=F.when(hit, F.translate("text", _UPPER, _LOWER)))
    end = manifest(rows).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("above")))
    return end.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("above")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(depth: int = 7) -> str:
    """For up to 8**depth rows a language: levels written out one after another, in each tree a node has a number and a hash."""
    value = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(concat(" + ", ".join(value(text if f == "text" else f) for f in FIELDS) + "))"
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ord(substr(doc_id::varchar, i, 1)))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"

    def up(name: str, k: int) -> str:
        """A level: what was alone stays, others become hashes of eight; `deep` counts the levels of a tree."""
        return f"""{name}{k + 1} as materialized (select tree, nr // 8 as nr, case when any_value(m) > 1 then sha256(string_agg(h, '' order by nr)) else any_value(h) end as h,
            any_value(deep) + case when any_value(m) > 1 then 1 else 0 end as deep, count(*) over (partition by tree) as m
            from {name}{k} group by tree, nr // 8)"""

    def climb(name: str, k: int, who: str) -> str:
        """Adds a level's siblings to proofs and folds them; levels above a tree's root add nothing."""
        return f"""select p.rid, p.tree, p.nr // 8 as nr, case when p.deep > {k} then concat(p.proof, coalesce(s.l, ''), coalesce(s.r, '')) else p.proof end as proof,
            case when p.deep > {k} then sha256(concat(coalesce(s.l, ''), p.fold, coalesce(s.r, ''))) else p.fold end as fold, p.deep
            from {who}{k} p left join {name}sib{k} s on p.tree = s.tree and p.nr = s.nr"""

    def siblings(name: str, k: int) -> str:
        return f"""{name}sib{k} as materialized (select a.tree, a.nr, string_agg(b.h, '' order by b.nr) filter (b.nr < a.nr) as l, string_agg(b.h, '' order by b.nr) filter (b.nr > a.nr) as r
            from {name}{k} a join {name}{k} b on a.tree = b.tree and a.nr // 8 = b.nr // 8 group by a.tree, a.nr)"""

    steps = [up("t", k) for k in range(depth)] + [siblings("t", k) for k in range(depth)]
    steps += [f"p{k + 1} as materialized ({climb('t', k, 'p')})" for k in range(depth)]
    tops = [up("u", k) for k in range(depth)] + [siblings("u", k) for k in range(depth)]
    tops += [f"q{k + 1} as materialized ({climb('u', k, 'q')})" for k in range(depth)]
    return f"""with d as materialized (select row_number() over () as rid, coalesce('=' || lang, '-') as tree, doc_id, {leaf("text")} as leaf,
            case when doc_id is not null and {crc} % 3 = 0 then {leaf(low)} end as altered from documents),
        t0 as materialized (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf, rid) - 1 as nr, leaf as h, 0 as deep, count(*) over (partition by tree) as m, rid from d),
        {", ".join(steps[:depth])}, high as (select tree, max(deep) as deep, any_value(h) as h from t{depth} group by 1), {", ".join(steps[depth:2 * depth])},
        p0 as materialized (select rid, tree, nr, '' as proof, coalesce(altered, leaf) as fold, high.deep from t0 join d using (rid, tree) join high using (tree)), {", ".join(steps[2 * depth:])},
        u0 as materialized (select 'all' as tree, row_number() over (order by tree) - 1 as nr, h, 0 as deep, count(*) over () as m, tree as name from high),
        {", ".join(tops[:depth])}, peak as (select max(deep) as deep, any_value(h) as h from u{depth}), {", ".join(tops[depth:2 * depth])},
        q0 as materialized (select rid, 'all' as tree, u0.nr, proof, fold, (select deep from peak) as deep from p{depth} p join u0 on u0.name = p.tree), {", ".join(tops[2 * depth:])}
        select doc_id, leaf, high.h as subroot, (select h from peak) as root, sha256(proof) as proof_sha256, fold as folded_root, fold = (select h from peak) as verified
        from d join q{depth} using (rid) join high on high.tree = d.tree"""


SQL = _sql()
