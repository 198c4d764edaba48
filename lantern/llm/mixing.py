"""Mixing sources to target weights by hierarchical budgets, with DataFrame operations only.

The tree is root, domain, language, source. Each leaf can give its tokens for so many epochs. From the root down, each
node's budget goes to its children in proportion to their weights; a child that can't use its part gives the rest to its
siblings, and only what all of them can't use remains with the ancestors' other children. A leaf then gives whole epochs
and, of the next one, the prefix of its documents in that epoch's seeded order that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import written

LEVELS = ["domain", "lang", "source"]
#: Parts of an epoch's order. Only the part in which the budget ends is summed row by row.
PARTS = 4096


def token_count(text: Column) -> Column:
    """Words of a text, split at white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def weighted(rows: DataFrame, level: str, weights: DataFrame) -> DataFrame:
    """Adds weight, that of the level's value; if the weights have columns of higher levels too, that of the value there."""
    path = [c for c in LEVELS if c in weights.columns or c == level]
    rows = rows.join(weights.select(*path, F.col("weight").cast("double").alias("_w")), path, "left")
    return rows.withColumn("weight", F.greatest(F.coalesce("_w", F.lit(1.0)), F.lit(0.0))).drop("_w")


def filled(children: DataFrame, parent: list[str], level: str, weights: DataFrame | None) -> DataFrame:
    """Adds given, the budget of each child. children: the columns of parent and level, capacity, and budget, the
    parent's. weights: level and weight, and columns of higher levels where a value's weight isn't the same below all parents;
    a child without a weight there counts 1, one of weight 0 or less gets nothing.

    With the children in the order of capacity / weight, the level to which all are filled is the largest of the levels
    that follow if the first 0, 1, 2 ... are full, as each of these bounds it from below.
    """
    if weights is None:
        children = children.withColumn("weight", F.lit(1.0))
    else:
        children = weighted(children, level, weights)
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    children = children.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
    order = group.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    children = children.withColumn("_full", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    children = children.withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    children = children.withColumn("_level", F.max(F.when(F.col("_rest") > 0, (F.col("budget") - F.col("_full")) / F.col("_rest"))).over(group))
    given = F.least("capacity", F.greatest(F.lit(0), F.floor(F.col("_level") * F.col("weight")))).cast("long")
    return children.withColumn("given", given).drop("_full", "_rest", "_level", "weight")


def leaf_budgets(leaves: DataFrame, budget: int, epochs: int, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """domain, lang, source, tokens and given, from a table of leaves with their tokens; budget is that of the root. Each level's
    budgets are a small table in the shared folder, or the plan would hold those of the levels above many times."""
    weights = weights or {}
    nodes = leaves.select(*LEVELS, "tokens", (F.col("tokens") * epochs).cast("long").alias("capacity"))
    for level in weights:  # what is weighted out is no capacity of the nodes above
        nodes = weighted(nodes, level, weights[level])
        nodes = nodes.select(*LEVELS, "tokens", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).alias("capacity"))
    tables = {len(LEVELS): written(nodes, "nodes")}
    for depth in range(len(LEVELS) - 1, 0, -1):
        tables[depth] = tables[depth + 1].groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity"))
    here = tables[1].withColumn("budget", F.lit(budget))
    for depth in range(1, len(LEVELS) + 1):
        here = written(filled(here, LEVELS[: depth - 1], LEVELS[depth - 1], weights.get(LEVELS[depth - 1])), "given")
        if depth < len(LEVELS):
            here = tables[depth + 1].join(here.select(*LEVELS[:depth], F.col("given").alias("budget")), LEVELS[:depth])
    return here.select(*LEVELS, "tokens", "given")


def mix(docs: DataFrame, domain: Column, share: float, epochs: int, seed: int = 1, weights: dict[str, DataFrame] | None = None, parts: int = PARTS, key: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens and copies: how many epochs take the document (at least one); and key, if one is
    given to tell rows of a repeated id apart.

    share: the budget as a share of all tokens; more than the leaves can give is cut to that. Null lang, source or domain
    is a child of its own, named ''. In each epoch a leaf's documents are in the order of md5 of seed, epoch and doc_id,
    then doc_id; those are taken whose running sum of tokens stays within the budget, so documents without words are
    taken as far as the prefix goes, also after whole epochs. A leaf without budget gives none. Rows with a null id take
    no part; a repeated id counts each time. Other columns are ignored.
    """
    base = written(docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]],
        token_count(F.col("text")).alias("tokens"),
        *([] if key is None else [key.alias("key")]),
    ), "tokens")
    leaves = base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, min(int(tokens * share), tokens * epochs), epochs, weights).where("given > 0")
    plan = plan.select(*LEVELS, F.floor(F.col("given") / F.col("tokens")).cast("int").alias("full"), (F.col("given") % F.col("tokens")).alias("left"))
    drawn = base.join(plan, LEVELS)
    drawn = drawn.withColumn("spot", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
    drawn = drawn.withColumn("part", (F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("int"))
    sums = drawn.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("within"), F.first("left").alias("left"))
    ahead = F.sum("within").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("within")
    sums = sums.withColumn("ahead", ahead).where("ahead <= left")
    sums = sums.select(*LEVELS, "part", "ahead", (F.col("ahead") + F.col("within") <= F.col("left")).alias("all"))
    drawn = drawn.join(sums, [*LEVELS, "part"], "left")
    sure = drawn.where("all or ahead is null").withColumn("next", F.coalesce("all", F.lit(False)).cast("int"))
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS, "part").orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = drawn.where("not all").withColumn("next", (F.col("ahead") + running <= F.col("left")).cast("int"))
    columns = ["doc_id", *LEVELS, "tokens", *([] if key is None else ["key"]), (F.col("full") + F.col("next")).alias("copies")]
    return sure.select(*columns).unionByName(edge.select(*columns)).where("copies > 0")


def taken(docs: DataFrame, domain: Column, share: float, epochs: int, **options) -> DataFrame:
    """The rows of docs that mix takes, each as often as it does, with the columns of docs. Rows of a repeated id count each;
    of rows that are equal in id, text, lang and source, which of them come more often isn't defined."""
    names = {c: f"_mix_{k}" for k, c in enumerate(docs.columns)}
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", *LEVELS[1:])])
    plan = mix(docs, domain, share, epochs, key=key, **options).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    rows = docs.where("doc_id is not null").select(*[F.col(c).alias(n) for c, n in names.items()], F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    # equal rows share their copies; counting only rows that mix takes, some of them may come to nought
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(1)))
    rows = rows.join(plan, ["doc_id", "key"]).withColumn("nth", nth)
    often = F.when(F.col("nth") <= F.col("n"), F.floor((F.col("copies") + F.col("n") - F.col("nth")) / F.col("n"))).otherwise(0)
    return rows.withColumn("often", often.cast("int")).where("often > 0").select(*names.values(), F.explode(F.sequence(F.lit(1), "often")).alias("_mix_copy")).select(*[F.col(n).alias(c) for c, n in names.items()])
