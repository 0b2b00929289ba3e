"""Leak-free stratified splits: all rows of a text share a fold."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modloom.domains import SPLITS
from modloom.functions.keys import packed, seeded_key, unpacked
from modloom.operators.dedup import with_flags
from modloom.operators.groups import HOT_GROUP_ROWS, attach_groups, dominant_stratum, written_groups
from modloom.operators.labels import crosstab, domain_counts
from modloom.rules import SPLIT_RULES, SplitRules
from modloom.sources.storage import cut_lineage

# Hex digits of the deal key that name a slice of a stratum's size class.
SLICE_DIGITS = 3
# A repeated text with at least this share of all rows belongs to the head, so the head has at
# most HEAD_SHARES texts.
HEAD_SHARES = 1000
# Turns after which the deal of the tail starts anew.
TURNS = 1000


class Loads:
    """Rows of each fold by stratum, while the head is placed."""

    def __init__(self, totals: list[int], rules: SplitRules = SPLIT_RULES):
        self.totals, self.rules = totals, rules
        self.cells = [[0] * len(totals) for _ in range(rules.folds)]
        held = [rules.val_fold, rules.test_fold]
        #: Training folds come first where nothing else decides.
        self.order = [f for f in range(rules.folds) if f not in held] + held

    def rows(self, fold: int) -> int:
        return sum(self.cells[fold])

    def share(self) -> float:
        return sum(self.totals) / self.rules.folds

    def place(self, counts: list[int]) -> int:
        """The fold that holds least of the text's own strata; validation and test never overflow.

        Rows of a stratum weigh by its size, and all rows together as much as all strata.
        """
        size, total = sum(counts), sum(self.totals)

        def cost(fold: int) -> tuple[float, int, int]:
            own = [n * at / of for n, at, of in zip(counts, self.cells[fold], self.totals, strict=True) if n]
            rows = self.rows(fold)
            return round(sum(own) + size * rows * len(counts) / total, 9), rows, self.order.index(fold)

        train = self.order[:-2]
        fits = [f for f in self.order if f in train or self.rows(f) + size <= self.share()]
        best = min(fits, key=cost)
        self.cells[best] = [x + n for x, n in zip(self.cells[best], counts, strict=True)]
        return best

    def deficits(self) -> list[float]:
        """Rows of the tail that each fold should get: validation and test up to their share, the
        training folds up to a common level; none to a fold that has more already."""
        rows = [self.rows(f) for f in range(self.rules.folds)]
        left = sum(self.totals) - sum(rows)
        wanted = {f: max(0.0, self.share() - rows[f]) for f in self.order[-2:]}
        fit = min(1.0, left / sum(wanted.values())) if left and sum(wanted.values()) else 0.0
        found = [wanted.get(f, 0.0) * fit for f in range(self.rules.folds)]
        rest, train = left - sum(found), self.order[:-2]
        filled = sorted(rows[f] for f in train)
        level = min(((rest + sum(filled[:k])) / k for k in range(1, len(filled) + 1)), default=0.0)
        for f in train:
            found[f] = max(0.0, level - rows[f])
        return found

    def pattern(self) -> list[int]:
        """TURNS folds, each as often as its deficit asks, spread evenly; in turn if all are equal."""
        deficits = self.deficits()
        total, bounds, run = sum(deficits), [0], 0.0
        for deficit in deficits:
            run += deficit
            bounds.append(math.floor(TURNS * run / total + 0.5) if total else 0)
        counts = [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
        turns = sorted(((j + 0.5) / n, f) for f, n in enumerate(counts) for j in range(n))
        return [f for _, f in turns] or [0]


def in_turn(tail: DataFrame, pattern: list[int], seed: int) -> DataFrame:
    """``fold`` of the tail: the groups of a stratum take the folds of ``pattern`` in turn.

    Larger size classes (powers of two) come first, a seeded hash orders a class. A group's turn
    is the number of groups in earlier slices of the stratum plus its rank in its own slice. So no
    window spans a stratum, and no fold depends on how the table was cut.
    """
    slice_key = ["stratum", "size_class", "slice"]
    earlier = (
        Window.partitionBy("stratum")
        .orderBy(F.desc("size_class"), "slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = tail.groupBy(*slice_key).agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    turn = F.row_number().over(Window.partitionBy(*slice_key).orderBy("deal_key")) - 1
    # The deal key follows from the text's, so it is made after the shuffle, which moves that one packed.
    text = F.col("text_hash")
    moved = tail.drop("deal_key").withColumn("text_hash", packed(text)).repartition(*slice_key)
    keyed = moved.withColumn("text_hash", unpacked(text)).withColumn("deal_key", seeded_key(seed, text))
    position = F.col("before") + F.col("turn") + F.col("stratum")
    dealt = keyed.withColumn("turn", turn).join(offsets, slice_key).drop("size_class", "slice")
    spot = F.pmod(position, F.lit(len(pattern))).cast("int") + 1
    return dealt.withColumn("fold", F.element_at(F.lit(pattern), spot)).drop("before", "turn", "stratum")


def fold_groups(groups: DataFrame, rules: SplitRules = SPLIT_RULES) -> DataFrame:
    """Adds ``fold`` to a group table, which is read three times: pass a written one.

    The heaviest texts, at most HEAD_SHARES, are placed one by one, largest first, where their
    own classes are rarest. The tail then fills what each fold lacks, stratum by stratum, in turn.
    So the rows come out at the folds' shares unless a single text is larger than that.
    """
    cells = [name for name in groups.columns if re.fullmatch(r"n\d+", name)]
    columns = [*groups.columns, "fold"]
    keyed = groups.withColumns(
        {
            "stratum": dominant_stratum(),
            "size_class": F.length(F.bin("group_size")),
            "deal_key": seeded_key(rules.seed, F.col("text_hash")),
        }
    ).withColumn("slice", F.substring("deal_key", 1, SLICE_DIGITS))
    totals = groups.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in cells)).first()
    heavy = (F.col("group_size") > 1) & (F.col("group_size") * HEAD_SHARES >= F.lit(sum(totals)))
    head = keyed.filter(heavy)
    loads = Loads(list(totals), rules)
    order = head.orderBy(F.desc("group_size"), "deal_key").select("text_hash", *cells).collect()
    folds = [(key, loads.place(list(counts))) for key, *counts in order]
    tail = in_turn(keyed.filter(~heavy), loads.pattern(), rules.seed).select(*columns)
    if not folds:
        return tail
    placed = groups.sparkSession.createDataFrame(folds, "text_hash string, fold int")
    return tail.unionByName(head.join(F.broadcast(placed), "text_hash").select(*columns))


def fold_to_split(fold: Column, rules: SplitRules = SPLIT_RULES) -> Column:
    return (
        F.when(fold == rules.test_fold, "test")
        .when(fold == rules.val_fold, "val")
        .when(fold.isNotNull(), "train")
        .otherwise(F.raise_error(F.lit("a row received no fold")))
    )


def assign_split(
    df: DataFrame, rules: SplitRules = SPLIT_RULES, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Adds ``split`` by text_hash. The folds of the groups are written before the join."""
    groups = cut_lineage(written_groups(df), "group-table")
    folded = fold_groups(groups, rules).select("text_hash", "group_size", "fold")
    joined = attach_groups(
        df, cut_lineage(folded, "folds"), ["fold"], "group_size", hot_rows=hot_rows
    )
    return joined.withColumn("split", fold_to_split(F.col("fold"), rules)).drop("fold")


def add_groups_and_split(
    df: DataFrame, rules: SplitRules = SPLIT_RULES, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Duplicate flags and split from one group table, written once, and one join."""
    columns = ["is_duplicate", "dup_group_size", "label_conflict", "fold"]
    groups = cut_lineage(with_flags(written_groups(df)), "group-table")
    prepared = fold_groups(groups, rules).select("text_hash", "group_size", *columns)
    joined = attach_groups(
        df, cut_lineage(prepared, "groups"), columns, "group_size", hot_rows=hot_rows
    )
    return joined.withColumn("split", fold_to_split(F.col("fold"), rules)).drop("fold")


def split_leakage(df: DataFrame) -> DataFrame:
    """The text_hash groups that span more than one split; must be empty.

    The split is coded as a number so that the aggregate keeps no strings.
    """
    code = F.array_position(F.array(*[F.lit(name) for name in SPLITS]), F.col("split"))
    return (
        df.groupBy("text_hash")
        .agg(F.min(code).alias("low"), F.max(code).alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("text_hash")
    )


def split_counts(df: DataFrame) -> DataFrame:
    return crosstab(df, ["source"], "split", SPLITS)


def split_summary(df: DataFrame) -> DataFrame:
    return crosstab(df, ["source", "label_name"], "split", SPLITS)


def split_shares(df: DataFrame) -> DataFrame:
    counts = domain_counts(df, "split", SPLITS).filter("n > 0")
    return counts.select(
        F.col("name").alias("split"), F.round(F.col("n") / F.col("total"), 3).alias("share")
    )
