"""Problem 7: a mixture of sources by target weights, budgeted over a tree and drawn from seeded epochs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm.byte_bpe import VOCABULARY, token_ids

BINS = 4096


@dataclass
class Node:
    """A domain, language or source; leaves have a weight and a capacity.

    ``due`` is what the node would get if no node were short, ``budget`` what it gets.
    """

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    due: Fraction = Fraction(0)
    budget: float = 0.0

    def gather(self) -> None:
        """Weights and capacities of inner nodes; a child without weight gets nothing, so its capacity doesn't count."""
        for child in self.children.values():
            child.gather()
        if self.children:
            self.weight = math.fsum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values() if c.weight > 0)

    def divide(self, due: Fraction) -> None:
        """Hand the whole out by weight alone, level by level; exact, so that no rounding decides who is short."""
        self.due = due
        total = sum(c.exact() for c in self.children.values())
        for c in self.children.values():
            c.divide(due * c.exact() / total if total else Fraction(0))

    def exact(self) -> Fraction:
        """The weight as a fraction: of an inner node the sum of its leaves' weights."""
        return sum((c.exact() for c in self.children.values()), Fraction(0)) if self.children else Fraction(self.weight)

    def short(self) -> bool:
        """A node that can't use its share as the tree hands it out."""
        return self.capacity < self.due

    def spend(self, budget: float) -> None:
        """Divide the budget among the children by weight; what one can't use goes to its siblings.

        A node gets no more than its subtree can use, so a shortage leaves a subtree only when all of it is
        spent: siblings are served before ancestors' other children.
        """
        self.budget = min(budget, self.capacity)
        left, open_ = self.budget, [c for c in self.children.values() if c.weight > 0 and c.capacity > 0]
        share = {id(c): 0.0 for c in open_}
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_)
            full = [c for c in open_ if share[id(c)] + left * c.weight / total >= c.capacity]
            if not full:
                for c in open_:
                    share[id(c)] += left * c.weight / total
                break
            for c in full:
                left -= c.capacity - share[id(c)]
                share[id(c)] = c.capacity
            open_ = [c for c in open_ if c not in full]
        for c in self.children.values():
            c.spend(share.get(id(c), 0.0))


def place(source: str) -> tuple[str, str]:
    """Domain and language of a source: the first word of its name, and a last word en or ja (else any)."""
    words = source.split("-")
    return words[0], words[-1] if words[-1] in ("en", "ja") else "any"


def budgets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [f for f in frames if len(f)]
    if not rows:
        return
    t = pd.concat(rows, ignore_index=True).sort_values("source", ignore_index=True)
    t["weight"] = t["target_weight"].where(np.isfinite(t["target_weight"].astype(float)), 0.0).astype(float).clip(lower=0.0)
    t["repeats"] = t["max_repeats"].fillna(0).clip(lower=0)
    total, weights = float(t["tokens"].sum()), float(t["weight"].sum())
    root = Node()
    for r in t.itertuples(index=False):
        domain, lang = place(r.source)
        leaf = root.children.setdefault(domain, Node()).children.setdefault(lang, Node()).children
        leaf[r.source] = Node(r.weight, float(r.repeats) * r.tokens)
    root.gather()
    root.divide(Fraction(int(t["tokens"].sum())))
    root.spend(total)
    leaves = {name: leaf for d in root.children.values() for g in d.children.values() for name, leaf in g.children.items()}
    t["target_share"] = t["weight"] / weights if weights else 0.0
    t["wanted"] = total * t["target_share"]
    t["budget"] = [leaves[x].budget for x in t["source"]]
    t["short"] = [leaves[x].short() for x in t["source"]]
    yield t[["source", "tokens", "repeats", "target_share", "wanted", "budget", "short"]]


def plain_source(name: str = "source"):
    return F.trim(F.lower(F.col(name)))


def allocation(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Budget of each source of ``targets``: source, tokens, repeats, target_share, wanted, budget, short.

    ``sizes``: source and tokens, one row per source. ``short`` says that the leaf can't use, even with all its
    repeats, the share that the tree hands down to it by weight before anything is redistributed. The rows of ``targets`` (a table of the sources, not of the documents) are put on one
    task; a source listed more than once counts once with its greatest weight and repeats.
    """
    once = targets.where(F.col("source").isNotNull()).groupBy(plain_source().alias("source")).agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    joined = once.join(sizes, "source", "left").select("source", "target_weight", "max_repeats", F.coalesce(F.col("tokens"), F.lit(0)).alias("tokens"))
    return joined.coalesce(1).mapInPandas(budgets, "source string, tokens bigint, repeats bigint, target_share double, wanted double, budget double, short boolean")


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (lower case, trimmed) and the number of tokens of each document's whole text."""
    known = documents.select("doc_id", plain_source().alias("source"), "text").where(F.col("source").isNotNull())
    return token_ids(known, ["doc_id", "source"], vocabulary).select("doc_id", "source", F.size("ids").cast("long").alias("tokens"))


def source_sizes(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def mixture(sizes: DataFrame, budget: DataFrame, seed: int = 7, few_sources: bool = False) -> DataFrame:
    """How often each document is used: doc_id, source, tokens, copies (at least 1).

    A leaf's budget is that many whole epochs over its documents and a prefix of one more, in an order drawn
    anew from the seed for that epoch: the documents before the point where the budget is met. Documents without
    tokens are not used.

    ``few_sources`` says that the caller has counted the targets and that their budgets may be broadcast.

    The prefix is found in two steps, so that no source gathers in one task: totals of a source's bins of the
    order are summed up (at most 4096 rows a source), which leaves one bin open; only its documents are ordered.
    """
    plan = budget.where((F.col("budget") > 0) & (F.col("tokens") > 0))
    epochs = F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("repeats")).cast("long")
    plan = plan.select("source", epochs.alias("epochs"), F.when(epochs < F.col("repeats"), F.col("budget") - epochs * F.col("tokens")).otherwise(0.0).alias("rest"))
    drawn = sizes.where(F.col("tokens") > 0).join((F.broadcast(plan) if few_sources else plan), "source")
    draw = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    drawn = drawn.withColumn("draw", draw).withColumn("bin", F.pmod("draw", F.lit(BINS)).cast("int"))
    bins = drawn.groupBy("source", "bin").agg(F.sum("tokens").alias("in_bin"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source", "bin", "in_bin", F.coalesce(F.sum("in_bin").over(ahead), F.lit(0)).alias("ahead"))
    placed = drawn.join(bins, ["source", "bin"])
    inside = F.col("ahead") + F.col("in_bin") <= F.col("rest")
    open_ = ~inside & (F.col("ahead") < F.col("rest"))
    sure = placed.where(~open_).select("doc_id", "source", "tokens", (F.col("epochs") + inside.cast("long")).alias("copies"))
    within = Window.partitionBy("source", "bin").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.where(open_).withColumn("up_to", F.col("ahead") + F.sum("tokens").over(within))
    edge = ordered.select("doc_id", "source", "tokens", (F.col("epochs") + (F.col("up_to") <= F.col("rest")).cast("long")).alias("copies"))
    return sure.unionByName(edge).where(F.col("copies") > 0)


def reached(budget: DataFrame, mix: DataFrame) -> DataFrame:
    """Per source: target_share, tokens, budget, mixed tokens, actual share and whether it is short."""
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"))
    joined = budget.join(used, "source", "left").withColumn("mixed", F.coalesce(F.col("mixed"), F.lit(0)))
    share = F.col("mixed") / F.nullif(F.sum("mixed").over(Window.partitionBy()), F.lit(0))
    return joined.select("source", F.round("target_share", 6).alias("target_share"), "tokens", F.round("budget", 3).alias("budget"), "mixed", F.coalesce(F.round(share, 6), F.lit(0.0)).alias("share"), F.coalesce(F.col("most_copies"), F.lit(0)).alias("most_copies"), "short")
