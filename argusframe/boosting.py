"""Boosted trees grown leaf by leaf on histograms, as Spark aggregates.

Features are cut into bins once. A round takes the first and second derivatives of the weighted logistic loss, sums
them by (leaf, feature, bin) with partial aggregates, and splits the leaf that gains most until the tree has its
leaves. Of two children only the smaller one is summed; the other is what is left of their parent. One job sums the
children of all leaves that may be split next, so a tree costs about as many jobs as it is deep. Rounds stop once the
loss on val has not improved ``patience`` times in a row, and the best round is kept.

What reaches the driver is one row per (leaf, feature, bin), so it grows with features and bins, never with rows.
Derivatives and losses are summed as whole numbers, so sums don't depend on which task ends first: given the same
bins, a rerun gives the same trees. Weights are at most 1, so that such sums hold for 10^11 rows.

A missing value goes left at every split. Rows of null label, or of a split other than train and val, aren't looked
at. Ties between splits go to the first feature and the lowest bin.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import discard, materialize, scratch
from argusframe.functions.columns import sigmoid

#: One of a derivative, in the whole numbers that are summed.
UNIT = 1 << 24
#: Rounds between two tables of margins: the expression in between holds so many trees.
TREES_A_TABLE = 5


@dataclass
class Node:
    """A leaf with its value, or a split: rows whose bin of ``feature`` is at most ``cut`` go left."""

    value: float = 0.0
    feature: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None

    def sql(self, goes_left, leaf) -> str:
        if self.left is None:
            return leaf(self)
        return f"CASE WHEN {goes_left(self)} THEN {self.left.sql(goes_left, leaf)} ELSE {self.right.sql(goes_left, leaf)} END"

    def leaves(self) -> int:
        return 1 if self.left is None else self.left.leaves() + self.right.leaves()

    def plain(self) -> list:
        return [self.value] if self.left is None else [self.feature, self.cut, self.left.plain(), self.right.plain()]

    @staticmethod
    def of(plain: list) -> Node:
        if len(plain) == 1:
            return Node(plain[0])
        return Node(feature=plain[0], cut=plain[1], left=Node.of(plain[2]), right=Node.of(plain[3]))


def number(value: float) -> str:
    """A double that Spark and other engines read alike."""
    return f"{value:.17e}"


def by_bin(node: Node) -> str:
    return f"b[{node.feature}] <= {node.cut}"


def value_of(node: Node) -> str:
    return number(node.value)


@dataclass
class Trees:
    """Trees over named feature columns, the edges of their bins, and a calibration of margins."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Node]
    losses: list[float] = field(default_factory=list)
    slope: float = 1.0
    intercept: float = 0.0
    quoted: bool = False

    def goes_left(self, node: Node) -> str:
        name = f'"{self.features[node.feature]}"' if self.quoted else f"`{self.features[node.feature]}`"
        return f"{name} IS NULL" if node.cut == 0 else f"coalesce({name} <= {number(self.edges[node.feature][node.cut - 1])}, true)"

    def margin_sql(self, ansi: bool = False) -> str:
        """The margin as SQL text over the feature columns, for Spark or, with ``ansi``, any other engine."""
        same = Trees(self.features, self.edges, self.trees, quoted=ansi)
        return " + ".join([number(0.0), *(f"({t.sql(same.goes_left, value_of)})" for t in self.trees)])

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with margin and score, the calibrated probability; a missing feature column is an error."""
        missing = [c for c in self.features if c not in rows.columns]
        if missing:
            raise ValueError(f"features missing: {missing}")
        return rows.withColumn("margin", F.expr(self.margin_sql())).withColumn("score", sigmoid(F.col("margin") * self.slope + self.intercept))

    def to_json(self) -> str:
        kept = {"features": self.features, "edges": self.edges, "losses": self.losses, "slope": self.slope, "intercept": self.intercept}
        return json.dumps(kept | {"trees": [t.plain() for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Trees:
        kept = json.loads(text)
        return Trees(kept["features"], kept["edges"], [Node.of(t) for t in kept["trees"]], kept["losses"], kept["slope"], kept["intercept"])


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins, near its quantiles: one pass, a sketch a feature."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), shares, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(found[f"e{i}"] or [])) for i in range(len(features))]


def bin_of(value: Column, edges: list[float]) -> Column:
    """0 for null, else 1 + the number of edges below the value; NaN is above them all."""
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)
    return F.when(value.isNull(), 0).otherwise(1 + below).cast("smallint")


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    left_is_smaller: bool


def best_split(sums: np.ndarray, least_rows: int, easing: float) -> Split | None:
    """The split of the greatest gain for sums[feature, bin] of derivatives and rows, or None where none gains."""
    low = sums.cumsum(axis=1)
    whole = low[:, -1:]
    high = whole - low
    worth = lambda s: (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + easing)
    gain = worth(low) + worth(high) - worth(whole)
    gain[(low[..., 2] < least_rows) | (high[..., 2] < least_rows)] = -np.inf
    at = int(gain.argmax())
    feature, cut = divmod(at, sums.shape[1])
    if not gain[feature, cut] > 1e-9:
        return None
    return Split(float(gain[feature, cut]), feature, cut, bool(low[feature, cut, 2] <= high[feature, cut, 2]))


def histograms(rows: DataFrame, leaf: Column, shape: tuple[int, int]) -> dict[int, np.ndarray]:
    """Sums of g, h and rows by leaf, feature and bin; rows of null leaf are left out."""
    own = rows.select(leaf.alias("leaf"), "g", "h", "b").where("leaf IS NOT NULL")
    cells = own.select("leaf", "g", "h", F.posexplode("b").alias("f", "bin")).groupBy("leaf", "f", "bin")
    out: dict[int, np.ndarray] = {}
    for r in cells.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():  # features x bins a leaf
        out.setdefault(r.leaf, np.zeros((*shape, 3), np.int64))[r.f, r.bin] = r.g, r.h, r.n
    return out


@dataclass
class Leaf:
    node: Node
    sums: np.ndarray
    split: Split | None
    children: tuple[np.ndarray, np.ndarray] | None = None


def grow(rows: DataFrame, shape: tuple[int, int], most_leaves: int, least_rows: int, easing: float, rate: float) -> Node:
    """One tree over ``rows`` (g, h, b), best leaf first."""
    root = Node()
    whole = histograms(rows, F.lit(0), shape).get(0, np.zeros((*shape, 3), np.int64))
    leaves = [Leaf(root, whole, best_split(whole, least_rows, easing))]
    while len(leaves) < most_leaves:
        open_ = sorted((x for x in leaves if x.split), key=lambda x: -x.split.gain)[: most_leaves - len(leaves)]
        if not open_:
            break
        if open_[0].children is None:
            # All leaves that may still be split are summed in this job, whether they will be or not.
            asked = [x for x in open_ if x.children is None]
            number_of = {id(x.node): i for i, x in enumerate(asked)}
            by_node = {id(x.node): x for x in asked}

            def wanted(node: Node, number_of=number_of, by_node=by_node) -> str:
                if id(node) not in number_of:
                    return "NULL"
                s = by_node[id(node)].split
                return f"CASE WHEN b[{s.feature}] {'<=' if s.left_is_smaller else '>'} {s.cut} THEN {number_of[id(node)]} END"

            found = histograms(rows, F.expr(root.sql(by_bin, wanted)).cast("int"), shape)
            for i, x in enumerate(asked):
                small, rest = found[i], x.sums - found[i]
                x.children = (small, rest) if x.split.left_is_smaller else (rest, small)
        best = open_[0]
        node = best.node
        node.feature, node.cut, node.left, node.right = best.split.feature, best.split.cut, Node(), Node()
        leaves.remove(best)
        leaves += [Leaf(n, s, best_split(s, least_rows, easing)) for n, s in zip((node.left, node.right), best.children, strict=True)]
    for x in leaves:
        g, h, _ = x.sums[0].sum(axis=0) / UNIT
        x.node.value = float(-rate * g / (h + easing))
    return root


def with_derivatives(rows: DataFrame) -> DataFrame:
    p = sigmoid(F.col("m"))
    return rows.select("b", F.round((p - F.col("y")) * F.col("w") * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * F.col("w") * UNIT).cast("long").alias("h"))


def loss_of(rows: DataFrame) -> float:
    """Weighted mean logistic loss of margin m against y."""
    z = F.when(F.col("y") == 1, -F.col("m")).otherwise(F.col("m"))
    one = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    total, weight = rows.agg(F.sum(F.round(one * F.col("w") * (1 << 20)).cast("long")), F.sum(F.round(F.col("w") * (1 << 20)).cast("long"))).first()
    return total / weight if weight else 0.0


def fit(
    rows: DataFrame, features: list[str], rounds: int = 1000, leaves: int = 31, rate: float = 0.1, patience: int = 20, bins: int = 64,
    least_rows: int = 20, easing: float = 1.0, balanced: bool = True
) -> Trees:
    """Fit on ``rows`` (label 0 or 1, split in train, val and cal, and features). Without rows of val all rounds are
    kept; the margins of cal calibrate the score, if it has both labels."""
    with scratch():
        used = rows.where(F.col("split").isin("train", "val") & F.col("label").isNotNull())
        edges = edges_of(used.where("split = 'train'"), features, bins)
        sizes = {r.label: r.n for r in used.where("split = 'train'").groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
        rarer = min(sizes.get(0, 0), sizes.get(1, 0)) if balanced else 0
        weight = lambda label: min(1.0, rarer / sizes[label]) if rarer else 1.0
        state = used.select(
            F.col("label").cast("int").alias("y"), F.when(F.col("label") == 1, weight(1)).otherwise(weight(0)).alias("w"), (F.col("split") == "val").alias("is_val"),
            F.array(*[bin_of(F.col(f"`{c}`").cast("double"), e) for c, e in zip(features, edges, strict=True)]).alias("b"), F.lit(0.0).alias("m")
        )
        kept = state = materialize(state, "boosting-rows")
        shape = (len(features), max(map(len, edges), default=0) + 2)
        trees, losses, best = [], [], 0
        for i in range(rounds):
            tree = grow(with_derivatives(state.where("NOT is_val")), shape, leaves, least_rows, easing, rate)
            if tree.left is None:
                break  # nothing gains any more
            trees.append(tree)
            state = state.withColumn("m", F.col("m") + F.expr(tree.sql(by_bin, value_of)))
            if (i + 1) % TREES_A_TABLE == 0:
                before, kept = kept, materialize(state, "boosting-rows")
                state = kept
                discard(before)
            losses.append(loss_of(state.where("is_val")))
            if losses[-1] < losses[best]:
                best = i
            if losses[-1] and i - best >= patience:
                break
        is_judged = bool(losses) and losses[best] > 0
    model = Trees(features, edges, trees[: best + 1] if is_judged else trees, losses)
    return calibrated(model, rows.where("split = 'cal'"))


def calibrated(model: Trees, cal: DataFrame) -> Trees:
    """The model with slope and intercept fitted on the margins of ``cal``."""
    ready = model.score(cal.where("label IS NOT NULL")).select("margin", F.col("label").cast("double").alias("label"))
    if ready.agg(F.count_distinct("label")).first()[0] == 2:
        platt = LogisticRegression(featuresCol="_m", labelCol="label", regParam=0.0).fit(VectorAssembler(inputCols=["margin"], outputCol="_m").transform(ready))
        model.slope, model.intercept = float(platt.coefficients[0]), float(platt.intercept)
    return model
