"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree (domain, language, source) by weights. A child that cannot
take its share takes all it has, its siblings share the rest by their weights, and only what a
whole family cannot take goes to its parent's siblings. Each leaf then gives its budget as whole
epochs and a token-prefix of one more epoch, in an order seeded for each epoch.

Only DataFrame functions are used. The tree lives in small tables of one row for each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

WORDS = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "language", "source")
#: Weights among siblings of each level, by name; others count DEFAULT_WEIGHT.
WEIGHTS = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
DEFAULT_WEIGHT = 1.0


def tokens_of(text: Column) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def tree_names(lang: Column, source: Column) -> list[Column]:
    """Domain (one of four, by the source's checksum), language and source; null names are `none`."""
    source = F.coalesce(source, F.lit("none"))
    domain = F.concat(F.lit("domain"), (F.crc32(source.cast("binary")) % 4).cast("string"))
    return [domain.alias("domain"), F.coalesce(lang, F.lit("none")).alias("language"), source.alias("source")]


def weight_of(level: str, name: Column, weights: dict) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for value, weight in weights.get(level, {}).items():
        out = F.when(name == value, F.lit(float(weight))).otherwise(out)
    return out


def shared_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """`budget` of each child (cap, weight, given: its parent's budget).

    By rising cap / weight, a child is full if its cap is at most its weight's share of what the
    full ones before it leave; the others share the rest by weight.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")), *LEVELS[: len(parent) + 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    full = children.withColumn("full", F.col("cap") * F.sum("weight").over(onward) <= F.col("weight") * left)
    family = Window.partitionBy(*parent)
    rest = F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(family)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(family)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.try_divide(rest, open_weight)))
    return full.withColumn("budget", share)


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict) -> DataFrame:
    """domain, language, source, supply, budget (whole tokens), epochs (whole ones), rest of each leaf.

    `leaves` has the names and the supply. The budget is `share` of all tokens, or all that
    max_epochs of everything give if that is less.
    """
    caps = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("double"))
    total = caps.agg(F.least(F.sum("supply") * F.lit(share), F.sum("cap")).alias("given"))
    given = total.first()["given"] or 0.0  # one number
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        names, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = caps.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, F.col(level), weights))
        if above is None:
            nodes = nodes.withColumn("given", F.lit(float(given)))
        else:
            nodes = nodes.join(above.select(*parent, F.col("budget").alias("given")), parent)
        above = shared_out(nodes, parent)
    whole = F.floor(F.col("budget") + 1e-6).cast("long")
    epochs = F.when(F.col("supply") > 0, F.floor(whole / F.col("supply"))).otherwise(0).cast("long")
    out = leaves.join(above.select(*LEVELS, "budget"), list(LEVELS)).select(*LEVELS, "supply", whole.alias("budget"), epochs.alias("epochs"))
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))


def mix(rows: DataFrame, names: list[Column], tokens: Column, key: list[Column], share: float, max_epochs: int, seed: int, weights: dict) -> DataFrame:
    """`rows` with domain, language, source, tokens, epochs, part_tokens, and order: its place in the leaf's last epoch.

    Columns of these names are not allowed in `rows`, which should be narrow: they are shuffled.

    part_tokens: what the row gives to the last, cut epoch. Running totals are made within pieces
    of a range-partitioned order, then moved by the sums of the pieces before: no leaf, however
    large, meets in one task. Equal rows are interchangeable.
    """
    spark = rows.sparkSession
    named = rows.select("*", *[c.alias(f"__{level}") for c, level in zip(names, LEVELS, strict=True)], tokens.alias("__tokens"), F.xxhash64(*key).alias("__key"))
    named = saved(named, "mix-rows")
    leaves = named.groupBy(*[F.col(f"__{level}").alias(level) for level in LEVELS]).agg(F.sum("__tokens").alias("supply"))
    plan = saved(budgets(saved(leaves, "mix-leaves"), share, max_epochs, weights), "mix-plan")
    on = [named[f"__{level}"] == plan[level] for level in LEVELS]
    joined = named.join(plan, on).withColumn("__order", F.xxhash64(F.lit(seed), "epochs", "__key"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort = [*LEVELS, "__order", "__key"]
    placed = joined.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    placed = saved(placed.withColumn("__part", F.shiftright("__at", 33)), "mix-order")
    pieces = placed.groupBy(*LEVELS, "__part").agg(F.sum("__tokens").alias("__sum"))
    earlier = Window.partitionBy(*LEVELS).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(level).alias(f"__p_{level}") for level in LEVELS], F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    local = Window.partitionBy(*LEVELS, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__before", F.coalesce(F.sum("__tokens").over(local), F.lit(0)))
    match = [placed["__part"] == pieces["__p"], *[placed[level] == pieces[f"__p_{level}"] for level in LEVELS]]
    start = F.col("__base") + F.col("__before")
    part = F.greatest(F.lit(0), F.least(F.col("__tokens"), F.col("rest") - start))
    return placed.join(pieces, match).select(*rows.columns, *LEVELS, F.col("__tokens").alias("tokens"), "epochs", F.col("__order").alias("order"), part.cast("long").alias("part_tokens"))


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("__doc"), F.col("lang").alias("__l"), F.col("source").alias("__s"), tokens_of(F.col("text")).alias("__n"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("__c"))


def mixed(docs: DataFrame, share: float, max_epochs: int, seed: int, weights: dict) -> DataFrame:
    """Rows of `docs`, without their text, that give tokens."""
    out = mix(narrow(docs), tree_names(F.col("__l"), F.col("__s")), F.col("__n"), [F.col("__doc"), F.col("__c")], share, max_epochs, seed, weights)
    return out.filter((F.col("tokens") > 0) & ((F.col("epochs") > 0) | (F.col("part_tokens") > 0)))


def mix_documents(docs: DataFrame, share: float = 0.6, max_epochs: int = 3, seed: int = 17, weights: dict = WEIGHTS) -> DataFrame:
    """doc_id, domain, language, source, tokens, epochs, part_tokens of every document that gives tokens.

    Nulls in lang or source are the name `none`; null or empty texts have no tokens and are never
    chosen; repeated rows each count; other columns are left out.
    """
    given = mixed(docs, share, max_epochs, seed, weights)
    return given.select(F.col("__doc").alias("doc_id"), *LEVELS, "tokens", "epochs", "part_tokens")


def chosen_documents(docs: DataFrame, share: float, seed: int = 17, weights: dict = WEIGHTS) -> DataFrame:
    """Rows of `docs`, all columns, that one epoch's token-prefixes reach; a document cut by the budget stays whole.

    A leaf's choice is all that comes up to a place in its order, so the texts meet only a table
    of one row for each leaf. Columns of `docs` must not start with `__m_`.
    """
    given = mixed(docs, share, 1, seed, weights)
    ends = given.groupBy(*[F.col(level).alias(f"__m_{level}") for level in LEVELS]).agg(F.max("epochs").alias("__m_epochs"), F.max("order").alias("__m_end"))
    ends = saved(ends, "mix-ends")
    own = [c.alias(f"__m_own_{level}") for c, level in zip(tree_names(F.col("lang"), F.col("source")), LEVELS, strict=True)]
    key = F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select("*", *own, key.alias("__m_key"))
    joined = rows.join(ends, [F.col(f"__m_own_{level}") == F.col(f"__m_{level}") for level in LEVELS])
    reached = F.xxhash64(F.lit(seed), "__m_epochs", "__m_key") <= F.col("__m_end")
    return joined.filter(reached & (tokens_of(F.col("text")) > 0)).select(*docs.columns)
