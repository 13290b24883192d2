"""Mixing sources to target weights over a domain-language-source tree, in DataFrame expressions.

Budgets go down the tree by weight. A child that cannot fill its share takes what it has (its
tokens times the epochs allowed) and its siblings share the rest by weight; only when all of them
are full does a shortage show at the parent, which then passes it to its own siblings. With
capacities summed upwards, that is water-filling at each node from the root down: children ordered
by capacity per weight, a child is full if that ratio is at most the level that the budget and the
children before it leave.

A leaf's quota is a number of whole epochs and a token-prefix of one more. An epoch's order is a
seeded hash of the ids, so the prefix is a threshold on the hash: it is found by summing tokens per
hash range first and then by rows inside the one range where the quota ends. Rows are chosen by
comparing their own hash with their leaf's threshold; texts are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.sizing import bounded_broadcast
from quarry.session import written

LEVELS = ("domain", "lang", "source")
NONE = "(none)"


@dataclass(frozen=True)
class Mixture:
    """Weights by name at each level, ``other`` for names not listed; a level without any weighs all names
    alike. ``share`` of all tokens is the budget; ``epochs`` bounds how often a row may be taken."""

    domain: dict = field(default_factory=dict)
    lang: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.7
    epochs: int = 3
    seed: int = 1
    rows_a_range: int = 2000


def tokens(text: Column) -> Column:
    """Words without white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(names: dict, key: Column, other: float) -> Column:
    out = F.lit(float(other))
    for name, w in sorted(names.items()):
        out = F.when(key == name, F.lit(float(w))).otherwise(out)
    return out


def _poured(children: DataFrame, parents: list[str], budget: Column, name: str) -> DataFrame:
    """Adds ``quota`` to children with ``weight`` and ``capacity``: the parent's budget by weight up to each capacity."""
    by = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name) if parents else Window.orderBy(F.col("capacity") / F.col("weight"), name)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.greatest(budget - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.lit(0.0))
    out = children.withColumn("_left", left).withColumn("_level", F.col("_left") / F.sum("weight").over(after))
    full = F.col("capacity") <= F.col("_level") * F.col("weight")
    # the level is that of the first child that is not full
    first = F.min(F.when(~full, F.struct((F.col("capacity") / F.col("weight")).alias("r"), F.col(name).alias("n"), F.col("_level").alias("level")))).over(
        Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1)))
    return out.withColumn("quota", F.when(first.isNull() | (F.col("capacity") / F.col("weight") < first["r"]), F.col("capacity")).otherwise(
        F.least("capacity", first["level"] * F.col("weight")))).drop("_left", "_level")


def budgets(leaves: DataFrame, cfg: Mixture) -> DataFrame:
    """Leaves (domain, lang, source, n_rows, n_tokens) with ``quota`` tokens each, never over n_tokens x epochs.

    Leaves without tokens and names of weight 0 get nothing.
    """
    weight = {level: _weight(getattr(cfg, level), F.col(level), cfg.other if getattr(cfg, level) else 1.0) for level in LEVELS}
    usable = (weight["domain"] > 0) & (weight["lang"] > 0) & (weight["source"] > 0) & (F.col("n_tokens") > 0)
    tree = leaves.filter(usable).withColumn("capacity", F.col("n_tokens").cast("double") * cfg.epochs)
    total = leaves.agg((F.sum("n_tokens") * F.lit(float(cfg.share))).alias("budget"))
    level, parents = None, []
    for name in LEVELS:
        children = tree.groupBy(*parents, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight[name])
        children = children.join(F.broadcast(total)) if level is None else children.join(level.select(*parents, F.col("quota").alias("budget")), parents)
        level = _poured(children, parents, F.col("budget"), name)
        parents = [*parents, name]
    return leaves.join(level.select(*LEVELS, "quota"), list(LEVELS))


def _order(cfg: Mixture, epoch: Column, doc: Column) -> Column:
    return F.xxhash64(F.lit(cfg.seed), epoch, doc)


def plan(rows: DataFrame, cfg: Mixture) -> DataFrame:
    """Rows (doc_id, domain, lang, source, n_tokens) -> leaves with quota, whole ``epochs``, and ``cut``:
    rows of the next epoch whose hash is at most ``cut`` are its token-prefix (null: none)."""
    leaf = list(LEVELS)
    leaves = written(budgets(rows.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens")), cfg), "leaves")
    leaves = leaves.withColumn("quota", F.floor(F.col("quota") + 1e-6)).withColumn("epochs", F.least(F.floor(F.col("quota") / F.col("n_tokens")), F.lit(cfg.epochs)).cast("int"))
    leaves = leaves.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("n_tokens"))
    placed = rows.join(bounded_broadcast(leaves.select(*leaf, "n_rows", "epochs", "rest")), leaf).withColumn("hash", _order(cfg, F.col("epochs"), F.col("doc_id")))
    ranges = F.ceil(F.col("n_rows") / cfg.rows_a_range)
    placed = placed.withColumn("range", F.least(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * ranges), ranges - 1))
    sums = placed.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("t"), F.max("hash").alias("high"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*leaf).orderBy("range")
    sums = sums.withColumn("through", F.sum("t").over(upto)).withColumn("before", F.col("through") - F.col("t"))
    sums = written(sums, "ranges")
    whole = sums.filter("through <= rest").groupBy(*leaf).agg(F.max("high").alias("cut"))
    split = sums.filter("through > rest and before <= rest").select(*leaf, "range", "before")
    inside = placed.join(bounded_broadcast(split), [*leaf, "range"]).groupBy(*leaf, "range", "hash").agg(
        F.sum("n_tokens").alias("t"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = inside.withColumn("through", F.col("before") + F.sum("t").over(Window.partitionBy(*leaf, "range").orderBy("hash")))
    cut = whole.unionByName(inside.filter("through <= rest").groupBy(*leaf).agg(F.max("hash").alias("cut"))).groupBy(*leaf).agg(F.max("cut").alias("cut"))
    return written(leaves.join(cut, leaf, "left"), "mixture")


def leaf_columns(domain: Column, lang: str = "lang", source: str = "source") -> list[Column]:
    """The three levels; a null name is a name of its own."""
    return [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip((domain, F.col(lang), F.col(source)), LEVELS)]


def mixture(docs: DataFrame, domain: Column, cfg: Mixture, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies, quota: the rows taken, ``copies`` times each.

    Rows that share a doc_id stand at one place of an epoch's order and come or go together, and so
    do rows without id. Empty and null texts have no tokens; they come with the prefix that
    reaches them, and a leaf of only such rows is not taken. Null names are names of their own.
    An empty table gives an empty table. Other columns are not read.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), *leaf_columns(domain, lang_col, source_col), tokens(F.col(text_col)).alias("n_tokens")), "tokens")
    return chosen(rows, plan(rows, cfg), cfg)


def chosen(rows: DataFrame, leaves: DataFrame, cfg: Mixture) -> DataFrame:
    """Rows taken, with ``copies`` and their leaf's ``quota``; other columns of ``rows`` stay."""
    own = leaves.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"), F.col("quota"))
    joined = rows.join(bounded_broadcast(own), [F.col(c) == F.col(f"_{c}") for c in LEVELS])
    more = F.coalesce(_order(cfg, F.col("_epochs"), F.col("doc_id")) <= F.col("_cut"), F.lit(False)).cast("int")
    return joined.withColumn("copies", F.col("_epochs") + more).filter("copies > 0").select(*rows.columns, "copies", "quota")


#: Domains of the documents' sources src0, src1, ...: by the number's rest, None for other names.
DOMAINS = ("web", "reference", "forum", "news")


def source_domain(source: Column) -> Column:
    number = F.regexp_extract(source, r"^src(\d{1,9})$", 1)
    names = F.array(*map(F.lit, DOMAINS))
    return F.when(number != "", F.element_at(names, F.pmod(number.cast("int"), F.lit(len(DOMAINS))) + 1))


DEFAULT = Mixture(domain={"web": 0.4, "reference": 0.3, "forum": 0.1, "news": 0.2}, lang={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, other=0.05)
