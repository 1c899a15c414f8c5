"""Screens of predictors: dropping and adding by collinearity over several groups, and cross-validated drops of blocks.

Correlations are cross products that Spark adds up once for all groups; what comes to the driver is one p x p matrix of each kind
for each of a fixed few groups. From there on variables come and go by pivots of the sweep operator.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import expit
from gridloom.operators.association import value_ranks
from gridloom.operators.count_fits import fit_many, linear, parameters
from gridloom.operators.counts import out_of_fold
from gridloom.sources.scratch import checkpointed

TINY = 1e-10


@dataclass(frozen=True)
class Limits:
    """Greatest inflation, absolute rank correlation and condition number (of the correlation matrix) of a set."""

    vif: float = 5.0
    rho: float = 0.8
    condition: float = 100.0


class Swept:
    """A correlation matrix swept on the variables within: then minus the diagonal is their inflation, and for one outside the
    diagonal is the share of it that those within do not explain."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.now = matrix.copy()
        self.inside: list[int] = []

    def pivot(self, k: int) -> None:
        """Takes k in, or out if it is within. One that the others explain wholly is not taken in: refused by ValueError."""
        a = self.now
        out = k in self.inside
        d = a[k, k]
        if not out and d <= 1e-12:
            raise ValueError("the variable is explained by those within")
        row, column = a[k].copy(), a[:, k].copy()
        a -= np.outer(column, row) / d
        sign = -1.0 if out else 1.0
        a[k], a[:, k] = sign * row / d, sign * column / d
        a[k, k] = -1.0 / d
        if out:
            self.inside.remove(k)
        else:
            self.inside.append(k)

    def vif(self) -> dict[int, float]:
        return {k: float(-self.now[k, k]) for k in self.inside}

    def unexplained(self, k: int) -> float:
        return float(self.now[k, k])

    def bound_to(self, k: int) -> list[int]:
        """Those within that take part in the explanation of k, which is outside."""
        return [j for j in self.inside if abs(self.now[k, j]) > 1e-8]

    def condition(self) -> float:
        part = self.matrix[np.ix_(self.inside, self.inside)]
        values = np.linalg.eigvalsh(part)
        return float(values[-1] / max(values[0], 1e-300))


@dataclass
class Matrices:
    """Correlations of the values and of their ranks in a group, and its complete rows."""

    pearson: np.ndarray
    spearman: np.ndarray
    rows: int


def matrices(df: DataFrame, columns: list[str], group: str) -> dict[str, Matrices]:
    """Matrices of each group (a fixed few, as text) over its rows with all columns.

    A constant column has no correlation: refused by ValueError. Ranks come from counts of distinct values by ranges.
    """
    p = len(columns)
    own = df.select(F.col(group).cast("string").alias("g"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    rows = checkpointed(own.withColumn("_row", F.monotonically_increasing_id()))
    means = rows.groupBy("g").agg(F.array(*(F.avg(c) for c in columns)).alias("m"), F.array(*(F.greatest(F.stddev_pop(c), F.lit(0.0)) for c in columns)).alias("s"), F.count("*").alias("n")).collect()
    flat = [(r["g"], c) for r in means for c, s, m in zip(columns, r["s"], r["m"], strict=True) if not s > 1e-12 * max(1.0, abs(m))]
    if flat:
        raise ValueError(f"constant in a group: {flat}")
    long = rows.select("_row", "g", F.inline(F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).alias("x")) for i, c in enumerate(columns)))))
    ranked = value_ranks(long, ["g", "at"], "x", "r").groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda s: s["r"]).alias("r"))
    middles = df.sparkSession.createDataFrame([(r["g"], r["m"], r["s"], (r["n"] + 1) / 2, float(r["n"])) for r in means], "g string, m array<double>, s array<double>, middle double, n double")
    centred = rows.join(ranked, "_row").join(F.broadcast(middles), "g").select("g", "n", *(((F.col(c) - F.get("m", i)) / F.get("s", i)).alias(f"z{i}") for i, c in enumerate(columns)), *(((F.get("r", i) - F.col("middle")) / F.col("n")).alias(f"r{i}") for i in range(p)))
    cells = [F.sum(F.col(f"{kind}{i}") * F.col(f"{kind}{j}")).alias(f"{kind}_{i}_{j}") for kind in "zr" for i in range(p) for j in range(i, p)]
    out = {}
    for r in centred.groupBy("g").agg(F.count("*").alias("n"), *cells).collect():
        found = {}
        for kind in "zr":
            a = np.empty((p, p))
            for i in range(p):
                for j in range(i, p):
                    a[i, j] = a[j, i] = r[f"{kind}_{i}_{j}"]
            d = np.sqrt(np.diag(a))
            found[kind] = a / np.outer(d, d)
        out[r["g"]] = Matrices(found["z"], found["r"], r["n"])
    return out


@dataclass
class Step:
    """A step of a screen: what was done to which variable, the set after it, and the worst of the groups where it was measured."""

    step: int
    action: str
    variable: str | None
    accepted: bool
    size: int
    variables: str
    vif: float | None
    rho: float | None
    condition: float | None


class Screen:
    """A set of variables, measured in all groups at once.

    domain: the variable's domain; minimum: the variables that a domain keeps at least (0 if not given); priority: those of a
    lower one go first.
    """

    def __init__(self, found: dict[str, Matrices], columns: list[str], limits: Limits, domain: dict[str, str] | None = None, minimum: dict[str, int] | None = None, priority: dict[str, int] | None = None):
        self.found, self.columns, self.limits = found, columns, limits
        self.domain, self.minimum, self.priority = domain or {}, minimum or {}, priority or {}
        self.swept = {g: Swept(m.pearson) for g, m in sorted(found.items())}
        self.inside: list[str] = []
        self.tied: set[str] = set()
        self.history: list[Step] = []

    def _set(self, names: list[str]) -> None:
        """Takes in what can be taken in; a variable that the others explain wholly in some group is tied: of infinite inflation."""
        for name in [n for n in self.inside if n not in names]:
            self._pivot_all(name)
            self.inside.remove(name)
        self.tied.clear()
        for name in names:
            if name in self.inside:
                continue
            k = self.columns.index(name)
            if min(s.unexplained(k) for s in self.swept.values()) <= 1e-12:
                self.tied.add(name)
                continue
            self._pivot_all(name)
            self.inside.append(name)

    def _pivot_all(self, name: str) -> None:
        for s in self.swept.values():
            s.pivot(self.columns.index(name))

    def _pair(self, g: str, names: list[str]) -> tuple[float, str | None, str | None]:
        best: tuple[float, str | None, str | None] = (0.0, None, None)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                v = abs(float(self.found[g].spearman[self.columns.index(a), self.columns.index(b)]))
                if v > best[0]:
                    best = (v, a, b)
        return best

    def measured(self, names: list[str]) -> dict:
        """Worst inflation by variable, worst pair by group, worst condition number, and whether the set is within the limits."""
        self._set(names)
        vif = {n: max(s.vif()[self.columns.index(n)] for s in self.swept.values()) for n in self.inside}
        for n in self.tied:
            k = self.columns.index(n)
            bound = {self.columns[j] for s in self.swept.values() if s.unexplained(k) <= 1e-12 for j in s.bound_to(k)}
            vif.update(dict.fromkeys({n, *bound}, float("inf")))
        pairs = {g: self._pair(g, names) for g in self.swept}
        condition = float("inf") if self.tied else max(s.condition() for s in self.swept.values())
        rho = max(p[0] for p in pairs.values())
        within = max(vif.values()) <= self.limits.vif + TINY and rho <= self.limits.rho + TINY and condition <= self.limits.condition + TINY
        return {"vif": vif, "pairs": pairs, "rho": rho, "condition": condition, "within": within}

    def _note(self, action: str, variable: str | None, accepted: bool, names: list[str], m: dict | None) -> None:
        finite = lambda v: None if not np.isfinite(v) else float(v)
        worst = (finite(max(m["vif"].values())), m["rho"], finite(m["condition"])) if m else (None, None, None)
        self.history.append(Step(len(self.history) + 1, action, variable, accepted, len(names), ";".join(names), *worst))

    def _droppable(self, names: list[str], among: list[str]) -> list[str]:
        def can(n: str) -> bool:
            d = self.domain.get(n)
            return sum(self.domain.get(o) == d for o in names) - 1 >= self.minimum.get(d, 0)

        return [n for n in among if can(n)] or [n for n in names if can(n)]

    def _worst(self, names: list[str], m: dict) -> str:
        """Of the variables of too close pairs, else of the greatest inflation, else all: the one of lowest priority, then of greatest
        inflation, then of greatest mean correlation, then by name."""
        among = sorted({v for p in m["pairs"].values() if p[0] > self.limits.rho + TINY for v in p[1:]})
        if not among and (top := max(m["vif"].values())) > self.limits.vif + TINY:
            among = sorted(n for n in names if m["vif"][n] >= top - TINY)
        free = self._droppable(names, among or names)
        if not free:
            raise ValueError("no variable can go without leaving a domain short")

        def close(n: str) -> float:
            others = [self.columns.index(o) for o in names if o != n]
            return float(np.mean([np.abs(f.spearman[self.columns.index(n), others]).mean() for f in self.found.values()]))

        return min(free, key=lambda n: (self.priority.get(n, 0), -m["vif"][n], -close(n), n))

    def repair(self, names: list[str]) -> list[str]:
        """names less those dropped one by one until the rest is within the limits in every group. One variable alone always is."""
        names = list(names)
        while True:
            m = self.measured(names)
            self._note("measure", None, m["within"], names, m)
            if m["within"] or len(names) == 1:
                return names
            gone = self._worst(names, m)
            names.remove(gone)
            self._note("drop", gone, True, names, None)

    def extend(self, core: list[str], optional: list[str]) -> list[str]:
        """core and, in their order, those of optional that leave the set within the limits in every group."""
        names = list(core)
        for n in optional:
            m = self.measured([*names, n])
            if m["within"]:
                names.append(n)
            self._note("add", n, m["within"], names, m)
        return names


def within_limits(df: DataFrame, group: str, core: list[str], optional: list[str], limits: Limits = Limits(), domain: dict[str, str] | None = None, minimum: dict[str, int] | None = None, priority: dict[str, int] | None = None) -> tuple[list[str], list[Step]]:
    """(variables, steps): core repaired, then optional ones added, over all groups of df at once."""
    columns = [*core, *(o for o in optional if o not in core)]
    screen = Screen(matrices(df, columns, group), columns, limits, domain, minimum, priority)
    return screen.extend(screen.repair(core), [o for o in optional if o not in core]), screen.history


def without_blocks(features: list[str], blocks: dict[str, list[str]]) -> dict[str, list[str]]:
    """Candidates: all features, and all but one block each; a candidate without a feature is left out."""
    unknown = sorted({c for b in blocks.values() for c in b} - set(features))
    if unknown:
        raise ValueError(f"blocks name other columns: {unknown}")
    return {"full": list(features), **{f"without_{k}": rest for k, b in blocks.items() if (rest := [f for f in features if f not in b])}}


def _chances(df: DataFrame, features: list[str], y: str, exposure: str, keys: list[str], fold: str) -> DataFrame:
    """df with positive, the logistic chance of a count above 0 by fits on the other folds of its keys, and its log score log_p."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in keys)) if keys else F.lit("")
    fits = parameters(df.sparkSession, fit_many(df, "occurrence", features, y, exposure, keys, fold), "_o")
    own = df.withColumns({"_k": key, "_f": F.col(fold).cast("long")}).join(F.broadcast(fits), ["_k", "_f"])
    eta = linear("_o", features)
    # ln of the chance and of its complement straight from eta, so that neither is ln 0
    yes, no = -F.log1p(F.exp(-F.abs(eta))) + F.least(eta, F.lit(0.0)), -F.log1p(F.exp(-F.abs(eta))) - F.greatest(eta, F.lit(0.0))
    return own.withColumns({"positive": expit(eta), "log_p": F.when(F.col(y) > 0, yes).otherwise(no), "expected": F.lit(None).cast("double")}).drop("_k", "_f", "_o")


def screened(df: DataFrame, family: str, candidates: dict[str, list[str]], y: str, exposure: str, keys: list[str], fold: str, at_once: int = 4) -> DataFrame:
    """candidate, n_features and, of every complete row, keys, fold, y, expected, positive and log_p out of fold.

    family: occurrence (logistic, without expected) or one of out_of_fold(). Rows that lack any candidate's feature are left out of all, so that candidates are judged on the same rows. Their fits are jobs
    of their own, at_once of them side by side; the fits of a candidate's keys and folds take common passes.
    """
    every = sorted({f for fs in candidates.values() for f in fs})
    own = checkpointed(df.where(F.col(exposure) > 0).dropna(subset=[y, fold, *keys, *every]).select(*dict.fromkeys([*keys, fold, y, exposure, *every])))

    def run(name: str) -> DataFrame:
        scored = _chances(own, candidates[name], y, exposure, keys, fold) if family == "occurrence" else out_of_fold(own, family, candidates[name], y, exposure, keys, fold)
        return scored.select(F.lit(name).alias("candidate"), F.lit(len(candidates[name])).alias("n_features"), *keys, fold, y, "expected", "positive", "log_p")

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(inheritable_thread_target(own.sparkSession)(run), candidates))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(df: DataFrame, keys: list[str], loss: Column, absolute: float = 1e-4, relative: float = 1e-4) -> DataFrame:
    """Candidates of each group by rank: those whose mean loss is as good as the least (within both distances) by fewer features first.

    loss: the loss of a row; a row whose loss is NULL or not finite makes its candidate unstable, ranked last.
    """
    good = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < F.lit(float("inf")))
    own = df.groupBy(*keys, "candidate", "n_features").agg(F.count("*").alias("n"), F.avg(F.when(good, loss)).alias("loss"), (F.count_if(good) == F.count("*")).alias("stable"))
    w = Window.partitionBy(*keys)
    own = own.withColumn("delta", F.col("loss") - F.min(F.when(F.col("stable"), F.col("loss"))).over(w))
    near = F.col("stable") & (F.col("delta") <= absolute) & (F.col("delta") <= relative * F.abs(F.col("loss") - F.col("delta")))
    own = own.withColumn("equivalent", F.coalesce(near, F.lit(False)))
    order = [F.col("stable").desc(), F.col("equivalent").desc(), F.when(F.col("equivalent"), F.col("n_features")).asc_nulls_last(), F.col("loss").asc_nulls_last(), F.col("candidate")]
    return own.withColumn("rank", F.row_number().over(w.orderBy(*order)))
