"""Many maximum likelihood fits of counts at once: NB1, NB2, zero-truncated, zero-inflated and occurrence, by key, held-out fold and start.

A pass over the rows adds up value, slope and curvature of every open fit, each over its own rows; only those sums reach the
driver, which takes Newton steps with the observed information. Settled fits drop out of the next pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.mixed import lgamma

#: Counts up to this take the recurrence of the gamma function instead of its series.
SHORT = 24
_FACTORIALS = np.r_[0.0, np.cumsum(np.log(np.arange(1, SHORT + 1)))]

FAMILIES = ("nb1", "nb2", "ztnb1", "zinb1", "occurrence")


@dataclass(frozen=True)
class Fit:
    """One fit: covariance is the inverse of the observed information; gradient is the greatest slope left a row.

    rank counts the directions that the data identify (eigenvalues of the scaled information above 1e-8); agreeing says how many
    of the starts ended at this likelihood.
    """

    family: str
    names: tuple[str, ...]
    estimate: np.ndarray
    covariance: np.ndarray
    loglik: float
    rows: int
    gradient: float
    information: np.ndarray
    settled: bool
    rank: int
    starts: int = 1
    agreeing: int = 1
    key: str = ""
    fold: int | None = None

    @property
    def aic(self) -> float:
        return 2 * len(self.names) - 2 * self.loglik

    @property
    def identified(self) -> bool:
        return self.rank == len(self.names)


def polygamma_sums(y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln gamma, digamma and trigamma at y + r less those at r, exactly 0 at y = 0."""

    def digamma(x):
        z = x + 6
        f = 1 / (z * z)
        return np.log(z) - 0.5 / z - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - sum(1 / (x + k) for k in range(6))

    def trigamma(x):
        z = x + 6
        f = 1 / (z * z)
        return 1 / z + f / 2 + f / z * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30))) + sum(1 / (x + k) ** 2 for k in range(6))

    out = tuple(np.zeros(len(y)) for _ in range(3))
    few = (y <= SHORT) & (y == np.floor(y))
    at = np.flatnonzero(few & (y > 0))
    x, left = r[at], y[at]
    while len(at):  # the recurrence: a term for each count below y, over ever fewer rows
        one = 1 / x
        for total, term in zip(out, (np.log(x), one, -one * one), strict=True):
            total[at] += term
        more = left > 1
        at, x, left = at[more], x[more] + 1, left[more] - 1
    if not few.all():
        at = np.flatnonzero(~few)
        for total, g in zip(out, (lgamma, digamma, trigamma), strict=True):
            total[at] = g(y[at] + r[at]) - g(r[at])
    return out


def log_factorial(y: np.ndarray) -> np.ndarray:
    """ln gamma at y + 1, from a table where y is a small count."""
    few = (y >= 0) & (y <= SHORT) & (y == np.floor(y))
    out = _FACTORIALS[np.where(few, y, 0).astype(np.int64)]
    if not few.all():
        out[~few] = lgamma(y[~few] + 1)
    return out


def count_terms(family: str, y: np.ndarray, eta: np.ndarray, ln_alpha: float) -> tuple:
    """(ll, slope and curvature by eta and ln alpha as m, a, mm, ma, aa) of NB1 or NB2, and the same of ln P(0)."""
    a, m = np.exp(ln_alpha), np.exp(eta)
    if family == "nb2":
        r, am = np.full(len(y), 1 / a), a * m
        low, one = np.log1p(am), 1 + am
        g, d, t = polygamma_sums(y, r)
        ll = g - log_factorial(y) - r * low + np.where(y > 0, y * (np.log(am) - low), 0.0)
        own = ((y - m) / one, -d * r + r * low + (y - m) / one, -m * (1 + a * y) / one**2, -(y - m) * am / one**2, t * r * r + d * r - r * low + m / one - (y - m) * am / one**2)
        zero = (-m / one, r * low - m / one, -m / one**2, m * am / one**2, -r * low + m / one + am * m / one**2)
        return ll, own, -r * low, zero
    r, low, k, k1 = m / a, np.log1p(a), a / (1 + a), a / (1 + a) ** 2
    g, d, t = polygamma_sums(y, r)
    dr = (d - low) * r
    ll = g - log_factorial(y) - r * low + y * (ln_alpha - low)
    own = (dr, -dr - r * k + y / (1 + a), t * r * r + dr, -t * r * r - k * r - dr, t * r * r + dr + 2 * r * k - r * k1 - y * k1)
    zero = (-r * low, r * low - r * k, -r * low, r * low - r * k, -r * low + 2 * r * k - r * k1)
    return ll, own, -r * low, zero


def sums(family: str, y: np.ndarray, offset: np.ndarray, x: np.ndarray, z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Value, slope and curvature (by rows) of a family's log likelihood over rows, and their number.

    theta: coefficients of x (with intercept), ln alpha, and for zinb1 coefficients of z in the logit of an extra zero.
    """
    k = x.shape[1]
    if family == "occurrence":
        eta = x @ theta
        p = 1 / (1 + np.exp(-eta))
        ll = np.where(y > 0, -np.logaddexp(0, -eta), -np.logaddexp(0, eta))
        slope, w = x.T @ ((y > 0) - p), -p * (1 - p)
        return np.r_[ll.sum(), slope, (x.T @ (w[:, None] * x)).ravel(), len(y)]
    eta = np.clip(x @ theta[:k] + offset, -80, 80)
    ll, (m, a, mm, ma, aa), ln0, (m0, a0, mm0, ma0, aa0) = count_terms(family, y, eta, theta[k])
    blocks = [x, np.ones((len(y), 1))]
    if family == "ztnb1":
        odds = 1 / np.expm1(-ln0)
        bend = odds * (1 + odds)
        ll = ll - np.log(-np.expm1(ln0))
        m, a, mm, ma, aa = m + odds * m0, a + odds * a0, mm + odds * mm0 + bend * m0 * m0, ma + odds * ma0 + bend * m0 * a0, aa + odds * aa0 + bend * a0 * a0
    firsts, seconds = [m, a], {(0, 0): mm, (0, 1): ma, (1, 1): aa}
    if family == "zinb1":
        zeta = np.clip(z @ theta[k + 1 :], -80, 80)
        pi, p0 = 1 / (1 + np.exp(-zeta)), np.exp(ln0)
        whole = pi + (1 - pi) * p0
        share, q = (1 - pi) * p0 / whole, pi * (1 - pi) * (1 - p0) / whole
        none = y == 0
        ll = np.where(none, np.log(whole), -np.logaddexp(0, zeta) + ll)
        spread = share * (1 - share)
        seconds = {
            (0, 0): np.where(none, share * mm0 + spread * m0 * m0, mm), (0, 1): np.where(none, share * ma0 + spread * m0 * a0, ma), (1, 1): np.where(none, share * aa0 + spread * a0 * a0, aa),
            (0, 2): np.where(none, -(pi * (1 - pi) * p0 / whole + share * q) * m0, 0.0), (1, 2): np.where(none, -(pi * (1 - pi) * p0 / whole + share * q) * a0, 0.0),
            (2, 2): np.where(none, pi * (1 - pi) * (1 - 2 * pi) * (1 - p0) / whole - q * q, -pi * (1 - pi)),
        }
        firsts = [np.where(none, share * m0, m), np.where(none, share * a0, a), np.where(none, q, -pi)]
        blocks.append(z)
    edge = np.cumsum([0, *(b.shape[1] for b in blocks)])
    curve = np.zeros((edge[-1], edge[-1]))
    for (i, j), w in seconds.items():
        part = blocks[i].T @ (w[:, None] * blocks[j])
        curve[edge[i] : edge[i + 1], edge[j] : edge[j + 1]] = part
        curve[edge[j] : edge[j + 1], edge[i] : edge[i + 1]] = part.T
    slope = np.concatenate([b.T @ d for b, d in zip(blocks, firsts, strict=True)])
    return np.r_[ll.sum(), slope, curve.ravel(), len(y)]


@dataclass(frozen=True)
class Job:
    """Fits of one family: by key, and for each fold (if any) on the rows of the others."""

    family: str
    keys: tuple[str, ...] = ()
    fold: str | None = None

    @property
    def where(self) -> tuple:
        return self.keys, self.fold


def packed(rows: DataFrame, marks: int, most: int = 1 << 17) -> DataFrame:
    """k, f and body of rows (k0, f0, k1, f1 ..., then values): one row for the rows of a task, `most` at a time, that share all k and f.

    body is the matrix of their values as bytes, column by column, so that a pass over the rows reads a few large rows.
    """

    def run(batches):
        held, n = {}, 0

        def flush():
            cells = list(held)
            bodies = [np.concatenate(held[c], axis=1).tobytes() for c in cells]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.list_(pa.string())), pa.array([c[1] for c in cells], pa.list_(pa.int64())), pa.array(bodies, pa.binary())], ["k", "f", "body"])

        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for c in b.columns[: 2 * marks]:
                own = c.dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
            matrix = np.stack([c.to_numpy() for c in b.columns[2 * marks :]])
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                cell = [c[int(at[0])].as_py() for c in b.columns[: 2 * marks]]
                held.setdefault((tuple(cell[::2]), tuple(cell[1::2])), []).append(matrix[:, at])
            n += b.num_rows
            if n >= most:
                yield flush()
                n = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "k array<string>, f array<long>, body binary")


def _pass(rows: DataFrame, open_: list[tuple[int, str, int, str, int | None, np.ndarray]], x_at: list[int], z_at: list[int]) -> dict[int, np.ndarray]:
    """The sums of all open fits (number, family, mark, key, held-out fold, theta) over packed rows, in one job."""
    width = 2 + len({*x_at, *z_at} - {-1})

    def design(m: np.ndarray, at: list[int]) -> np.ndarray:
        return np.stack([np.ones(m.shape[1]) if i < 0 else m[i] for i in at], axis=1)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, f, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                mine = [o for o in open_ if o[3] == k[o[2]] and (o[4] is None or (f[o[2]] is not None and f[o[2]] != o[4]))]
                if not mine:
                    continue
                m = np.frombuffer(body.as_buffer(), np.float64).reshape(width, -1)
                hit = m[:, m[0] > 0] if any(o[1] == "ztnb1" for o in mine) else None
                whole = m[0], m[1], design(m, x_at), design(m, z_at)
                above = hit is not None and (hit[0], hit[1], design(hit, x_at), design(hit, z_at))
                for number, family, _, _, _, theta in mine:
                    part = above if family == "ztnb1" else whole
                    if len(part[0]):
                        total[number] = total.get(number, 0) + sums(family, *part, theta)
        for number, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([v])], ["i", "v"])

    out = {o[0]: np.full(2 + len(o[5]) + len(o[5]) ** 2, np.nan) for o in open_}
    parts = rows.mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("cell", "v"))
    for i, cell, v in parts.groupBy("i", "cell").agg(F.sum("v")).collect():
        out[i][cell] = v
    return out


def _step(slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, float]:
    """An ascent step by the curvature's eigenvalues in size, two at most in a parameter, and the gain that it promises."""
    values, vectors = np.linalg.eigh(-curve)
    size = np.maximum(np.abs(values), 1e-9 * max(np.abs(values).max(), 1e-12))
    step = vectors @ ((vectors.T @ slope) / size)
    gain = float(slope @ step)
    return step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12)), gain


def fit_many(df: DataFrame, family: str, features: list[str], y: str, exposure: str, keys: list[str] | None = None, fold: str | None = None, zero_features: list[str] | None = None, starts: tuple[float, ...] = (0.0, -2.0, 1.5), rounds: int = 50, tolerance: float = 1e-9) -> list[Fit]:
    """The best fit of each key, and for each of its folds (if any) of the rows of the others: from several ln alpha as starts.

    Incomplete rows and those without exposure are left out; ztnb1 takes counts above 0 only. A fit that does not settle, or
    whose information lacks rank, says so. Folds and keys are a fixed few.
    """
    return fit_jobs(df, [Job(family, tuple(keys or ()), fold)], features, y, exposure, zero_features, starts, rounds, tolerance)[0]


def fit_jobs(df: DataFrame, jobs: list[Job], features: list[str], y: str, exposure: str, zero_features: list[str] | None = None, starts: tuple[float, ...] = (0.0, -2.0, 1.5), rounds: int = 50, tolerance: float = 1e-9) -> list[list[Fit]]:
    """fit_many() of several jobs in common passes over the rows, which are read once."""
    for job in jobs:
        if job.family not in FAMILIES:
            raise ValueError(f"unknown family {job.family}")
    zero = list(zero_features or []) if any(j.family == "zinb1" for j in jobs) else []
    columns = list(dict.fromkeys([*features, *zero]))
    names = {j.family: ["(intercept)", *features] + ([] if j.family == "occurrence" else ["ln_alpha"]) + (["zero:(intercept)", *(f"zero:{c}" for c in zero)] if j.family == "zinb1" else []) for j in jobs}
    marks = list(dict.fromkeys(j.where for j in jobs))
    cells = []
    for i, (keys, fold) in enumerate(marks):
        cells += [(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")).alias(f"k{i}"), (F.col(fold) if fold else F.lit(-1)).cast("long").alias(f"f{i}")]
    values = [F.col(y).cast("double").alias("v0"), F.when(F.col(exposure) > 0, F.ln(F.col(exposure).cast("double"))).alias("v1"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns, 2))]
    own = df.select(*cells, *values).dropna(subset=[f"v{i}" for i in range(len(values))])
    own = own.where("v0 > 0") if all(j.family == "ztnb1" for j in jobs) else own
    own = packed(own, len(marks)).persist()
    place = {c: i for i, c in enumerate(columns, 2)}
    x_at, z_at = [-1, *(place[c] for c in features)], [-1, *(place[c] for c in zero)]
    try:
        state = []
        found = _totals(own, len(values))
        for number, job in enumerate(jobs):
            at = marks.index(job.where)
            mine = [{"k": k[at], "f": f[at], **(v if job.family != "ztnb1" else {**v, "n": v["hits"], "e": v["hit_e"]})} for k, f, v in found if f[at] is not None]
            mine = [c for c in mine if c["n"]]
            for k in sorted({c["k"] for c in mine}):
                of_key = [c for c in mine if c["k"] == k]
                for held in sorted({c["f"] for c in of_key}) if job.fold else [None]:
                    part = [c for c in of_key if held is None or c["f"] != held]
                    total, e, n, hits = (sum(c[v] for c in part) for v in ("y", "e", "n", "hits"))
                    share = hits / max(n, 1)
                    if not total or (job.family == "occurrence" and share == 1):
                        raise ValueError(f"key {k!r}, fold {held}: no positive count to fit" if not total else f"key {k!r}, fold {held}: no zero to fit")
                    for alpha in starts[:1] if job.family == "occurrence" else starts:
                        theta = np.zeros(len(names[job.family]))
                        theta[0] = np.log(share / (1 - share)) if job.family == "occurrence" else np.log(total / e)
                        if job.family != "occurrence":
                            theta[len(features) + 1] = alpha
                        if job.family == "zinb1":
                            theta[len(features) + 2] = -1.0
                        state.append({"job": number, "family": job.family, "mark": at, "key": k, "fold": held, "try": theta, "at": None, "value": -np.inf, "damp": 1.0, "settled": False, "open": True})
        for _ in range(rounds):
            open_ = [(i, s["family"], s["mark"], s["key"], s["fold"], s["try"]) for i, s in enumerate(state) if s["open"]]
            if not open_:
                break
            for i, v in _pass(own, open_, x_at, z_at).items():
                s = state[i]
                if not np.isfinite(v).all() or v[0] < s["value"] - 1e-12 * abs(s["value"]):
                    s["damp"] /= 4
                    if s["at"] is None or s["damp"] < 1e-6:
                        s["open"] = False
                    else:
                        s["try"] = s["at"] + s["damp"] * s["step"]
                    continue
                n = len(s["try"])
                curve = v[1 + n : -1].reshape(n, n)
                step, gain = _step(v[1 : 1 + n], curve)
                s |= {"at": s["try"], "value": v[0], "slope": v[1 : 1 + n], "curve": curve, "rows": round(v[-1]), "step": step, "damp": 1.0, "try": s["try"] + step}
                if gain < tolerance * max(1.0, abs(v[0])):
                    s |= {"open": False, "settled": True}
        return [_best([s for s in state if s["job"] == number], job.family, tuple(names[job.family])) for number, job in enumerate(jobs)]
    finally:
        own.unpersist()


def _totals(rows: DataFrame, width: int) -> list[tuple[list, list, dict]]:
    """k, f and sums of the packed rows of each cell: count, exposure, rows, and rows and exposure of those above 0."""

    def run(batches):
        for b in batches:
            sums_ = []
            for body in b.column(2):
                m = np.frombuffer(body.as_buffer(), np.float64).reshape(width, -1)
                e, hit = np.exp(m[1]), m[0] > 0
                sums_.append([m[0].sum(), e.sum(), float(m.shape[1]), float(hit.sum()), e[hit].sum()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums_, pa.list_(pa.float64()))], ["k", "f", "v"])

    own = rows.mapInArrow(run, "k array<string>, f array<long>, v array<double>")
    own = own.groupBy("k", "f").agg(*(F.sum(F.get("v", i)).alias(c) for i, c in enumerate(("y", "e", "n", "hits", "hit_e"))))
    return [(r["k"], r["f"], {c: r[c] for c in ("y", "e", "n", "hits", "hit_e")}) for r in own.collect()]


def _best(state: list[dict], family: str, names: tuple[str, ...]) -> list[Fit]:
    out: dict[tuple, Fit] = {}
    for where in sorted({(s["key"], -1 if s["fold"] is None else s["fold"]) for s in state}):
        mine = [s for s in state if (s["key"], -1 if s["fold"] is None else s["fold"]) == where and s["at"] is not None]
        if not mine:
            raise ValueError(f"no start of {where} has a finite likelihood")
        top = max(mine, key=lambda s: (s["settled"], s["value"]))
        info = -top["curve"]
        scale = 1 / np.sqrt(np.maximum(np.diag(info), 1e-300))
        rank = int((np.linalg.eigvalsh(info * scale[:, None] * scale) > 1e-8).sum())
        agreeing = sum(s["settled"] and s["value"] > top["value"] - 1e-5 * max(1.0, abs(top["value"])) for s in mine)
        out[where] = Fit(family, names, top["at"], np.linalg.pinv(info), float(top["value"]), top["rows"], float(np.abs(top["slope"]).max() / max(top["rows"], 1)), info, top["settled"], rank, len(mine), agreeing, top["key"], top["fold"])
    return list(out.values())


def clipped(v: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest matrix without a negative eigenvalue, and how many were clipped."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    low = values < 0
    return (vectors * np.where(low, 0.0, values)) @ vectors.T, int(low.sum())


def parameters(spark: SparkSession, fits: list[Fit], name: str) -> DataFrame:
    """_k, _f (fold, -1 without) and the estimates of fits as an array column: a row for each fit."""
    return spark.createDataFrame([(f.key, -1 if f.fold is None else int(f.fold), [float(b) for b in f.estimate]) for f in fits], f"_k string, _f long, {name} array<double>")


def linear(theta: str, features: list[str], first: int = 0) -> Column:
    """The sum of an array column's coefficients, from place `first` on, times 1 and the features."""
    out = F.get(theta, first)
    for i, c in enumerate(features, 1):
        out = out + F.get(theta, first + i) * F.col(c).cast("double")
    return out
