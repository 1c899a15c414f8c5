"""Mixed models with crossed random intercepts of many units and a few levels (years): Gaussian, and Tweedie with log link.

Unit effects are eliminated inside their unit, so the driver only sees matrices of the fixed effects and levels.

Gaussian: a unit's effect enters through its number of rows n and its sums alone, with the weight 1 / (n + 1 / ratio).
Cross products of the sums are added up by n, in one aggregation; the likelihood of any variances follows from those.

Tweedie: the likelihood is Laplace's approximation. A pass over the units, packed in blocks, finds each unit's mode by Newton
steps where its rows are, and adds up value, slopes and curvature for several candidates of all systems at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import normal_two_sided, ratio
from gridloom.sources.scratch import checkpointed


@dataclass
class MixedFit:
    """One system's fit. covariance is of the fixed effects; sd_* are standard deviations; power and phi are Tweedie's."""

    system: str
    family: str
    names: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    sd_unit: float
    sd_level: float
    scale: float
    loglik: float
    rows: int
    units: int
    levels: list
    level_effects: np.ndarray
    gradient: float
    positive_definite: bool
    power: float | None = None
    extra: dict = field(default_factory=dict)

    @property
    def parameters(self) -> int:
        return len(self.names) + (3 if self.power is None else 4)

    @property
    def valid(self) -> bool:
        """Settled, with finite errors, a curvature of the right sign and variances above 0."""
        return bool(self.positive_definite and np.isfinite(self.covariance).all() and self.gradient < 1e-2 and self.sd_unit > 1e-4 and self.sd_level > 1e-4)


def _levels(df: DataFrame, level: str, most: int) -> list:
    rows = [r[0] for r in df.select(level).distinct().orderBy(level).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"{level} has over {most} levels; it takes the place of units")
    return rows


def complete(df: DataFrame, system: str, unit: str, level: str, y: str, features: list[str], offset: str | None = None) -> DataFrame:
    """system, unit, level, y, offset and features as doubles, of the rows that have them all."""
    off = F.col(offset).cast("double") if offset else F.lit(0.0)
    own = df.select(F.col(system).cast("string").alias("_s"), F.col(unit).alias("_u"), F.col(level).alias("_t"), F.col(y).cast("double").alias("_y"), off.alias("_o"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)))
    return own.dropna()


def minimise(f, start: np.ndarray, step: float = 1.0, rounds: int = 400, tolerance: float = 1e-10) -> np.ndarray:
    """The least point of a smooth function of a few numbers, by the simplex of Nelder and Mead."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + step * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance and np.abs(points[-1] - points[0]).max() < 1e-6:
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        value = f(tried)
        if value < values[0]:
            far = middle + 2 * (middle - points[-1])
            tried, value = min(((tried, value), (far, f(far))), key=lambda t: t[1])
        elif value >= values[-2]:
            near = middle + 0.5 * ((tried if value < values[-1] else points[-1]) - middle)
            tried, value = near, f(near)
            if value >= values[-1]:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = tried, value
    return points[int(np.argmin(values))]


def curvature(f, at: np.ndarray, h: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of f by central differences."""
    n = len(at)
    e, mid = h * np.eye(n), f(at)
    up, down = [f(at + e[i]) for i in range(n)], [f(at - e[i]) for i in range(n)]
    hess = np.zeros((n, n))
    for i in range(n):
        hess[i, i] = (up[i] - 2 * mid + down[i]) / h**2
        for j in range(i):
            hess[i, j] = hess[j, i] = (f(at + e[i] + e[j]) - f(at + e[i] - e[j]) - f(at - e[i] + e[j]) + f(at - e[i] - e[j])) / (4 * h * h)
    return (np.array(up) - np.array(down)) / (2 * h), hess


@dataclass
class Moments:
    """Sums of a system's rows d = (1, features, levels, y): dd adds up d d', sized[n] the units of n rows: how many, and the sum of s s' of their sums s."""

    p: int
    levels: list
    dd: np.ndarray
    sized: dict[int, tuple[int, np.ndarray]]

    @property
    def rows(self) -> int:
        return round(self.dd[0, 0])

    @property
    def units(self) -> int:
        return sum(k for k, _ in self.sized.values())

    def eliminated(self, ratio_unit: float) -> np.ndarray:
        """The cross products of d after the units' effects are taken out, for a variance ratio of unit and residual."""
        return self.dd - sum(s * (ratio_unit / (1 + ratio_unit * n)) for n, (_, s) in self.sized.items())


def moments(df: DataFrame, system: str, unit: str, level: str, features: list[str], y: str, most_levels: int = 366, most_sizes: int = 4096) -> dict[str, Moments]:
    """Moments by system. A unit's sums are one aggregation; their cross products are added up by its number of rows.

    Only matrices come to the driver: for each system and number of rows of a unit, of which most_sizes may differ.
    """
    own = complete(df, system, unit, level, y, features)
    levels = _levels(own, "_t", most_levels)
    parts = [F.lit(1.0), *(F.col(f"_x{i}") for i in range(len(features))), *((F.col("_t") == F.lit(t)).cast("double") for t in levels), F.col("_y")]
    q = len(parts)
    rows = own.select("_s", "_u", F.array(*parts).alias("d"))
    names = [f"d{i}" for i in range(q)]
    units = own.select("_s", "_u", *(c.alias(n) for c, n in zip(parts, names, strict=True))).groupBy("_s", "_u").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))
    sized = crossed(units.select("_s", "n", F.array(*names).alias("d")), q)
    whole = crossed(rows.select("_s", F.lit(0).cast("long").alias("n"), "d"), q)
    out: dict[str, Moments] = {}
    found = sized.unionByName(whole).collect()
    if len(found) > most_sizes * max(1, len({r["_s"] for r in found})):
        raise ValueError(f"units have over {most_sizes} different numbers of rows")
    for r in found:
        own_m = out.setdefault(r["_s"], Moments(len(features) + 1, levels, np.zeros((q, q)), {}))
        matrix = np.array(r["cross"]).reshape(q, q)
        if r["n"]:
            own_m.sized[r["n"]] = r["k"], matrix
        else:
            own_m.dd = matrix
    return out


def crossed(df: DataFrame, q: int) -> DataFrame:
    """_s, n, k and cross (q x q, by rows) of the vectors d, added up by _s and n: partial sums in Arrow batches, then by cell."""

    def run(batches):
        for b in batches:
            s, n = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
            d = b.column(2).flatten().to_numpy().reshape(-1, q)
            keys, which = np.unique(np.array([f"{x}\x00{m}" for x, m in zip(s, n, strict=True)], object), return_inverse=True)
            for i, key in enumerate(keys):
                part = d[which == i]
                name, m = key.rsplit("\x00", 1)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(m)], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([(part.T @ part).ravel()])], ["_s", "n", "k", "cross"])

    parts = df.mapInArrow(run, "_s string, n long, k long, cross array<double>")
    cells = parts.select("_s", "n", "k", F.posexplode("cross").alias("cell", "v")).groupBy("_s", "n", "cell").agg(F.sum("k").alias("k"), F.sum("v").alias("v"))
    return cells.groupBy("_s", "n").agg(F.max("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda c: c["v"]).alias("cross"))


def given_ratios(spark: SparkSession, found: dict[str, Moments], names: list[str], ratio_unit: float, ratio_level: float = 0.0) -> DataFrame:
    """system, term, estimate, se and residual variance at given variance ratios of unit and level to residual (0: no such effect)."""
    rows = []
    for system, m in sorted(found.items()):
        s = _solved(m, ratio_unit, ratio_level)
        rows += [(system, t, float(b), float(np.sqrt(s["variance"] * v)), float(s["variance"])) for t, b, v in zip(["(intercept)", *names], s["beta"], np.diag(s["inverse"]), strict=True)]
    return spark.createDataFrame(rows, "system string, term string, estimate double, se double, variance double")


def _solved(m: Moments, ratio_unit: float, ratio_level: float) -> dict:
    """Everything at given variance ratios: -2 log likelihood, estimate, inverse of the fixed effects' cross products, residual variance, level effects."""
    c = m.eliminated(ratio_unit)
    q, p = len(c), m.p
    at = np.arange(p, q - 1)
    keep = np.r_[np.arange(p), q - 1]
    logdet = sum(k * np.log1p(ratio_unit * n) for n, (k, _) in m.sized.items())
    if ratio_level > 0:
        inner = np.eye(len(at)) / ratio_level + c[np.ix_(at, at)]
        solved = np.linalg.solve(inner, c[np.ix_(at, keep)])
        rest = c[np.ix_(keep, keep)] - c[np.ix_(keep, at)] @ solved
        logdet += np.linalg.slogdet(ratio_level * inner)[1]
    else:
        solved, rest = np.zeros((len(at), p + 1)), c[np.ix_(keep, keep)]
    inverse = np.linalg.pinv(rest[:p, :p])
    beta = inverse @ rest[:p, p]
    rss = max(rest[p, p] - rest[p, :p] @ beta, 1e-300)
    n = m.rows
    return {"m2ll": n * (np.log(2 * np.pi * rss / n) + 1) + logdet, "beta": beta, "inverse": inverse, "variance": rss / n, "levels": solved[:, p] - solved[:, :p] @ beta}


def gaussian(df: DataFrame, system: str, unit: str, level: str, features: list[str], y: str) -> list[MixedFit]:
    """Maximum likelihood fits of y on the features with random intercepts of unit and level, one for each system.

    Incomplete rows are left out. A system whose variances go to 0 has standard deviations near 0 and is not valid.
    """
    out = []
    for name, m in sorted(moments(df, system, unit, level, features, y).items()):

        def f(x, m=m):
            return _solved(m, float(np.exp(x[0])), float(np.exp(x[1])))["m2ll"] + 1e-3 * float(np.sum(np.maximum(0, np.abs(x) - 16) ** 2))

        grid = [np.array([a, b]) for a in (-6.0, -3.0, -1.0, 1.0) for b in (-6.0, -3.0, -1.0, 1.0)]
        best = minimise(f, min(grid, key=f))
        g, h = curvature(f, best)
        s = _solved(m, float(np.exp(best[0])), float(np.exp(best[1])))
        sd = float(np.sqrt(s["variance"]))
        out.append(
            MixedFit(name, "gaussian", ["(intercept)", *features], s["beta"], s["variance"] * s["inverse"], sd * float(np.exp(best[0] / 2)), sd * float(np.exp(best[1] / 2)), sd, -s["m2ll"] / 2, m.rows, m.units, m.levels, s["levels"], float(np.abs(g).max()), bool(np.linalg.eigvalsh(h).min() > 0))
        )
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0, by Stirling's series eight steps up."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    f = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / y - shift


def tweedie_series(y: np.ndarray, phi: float, power: float) -> np.ndarray:
    """The part of the log density of y > 0 that the mean does not enter: ln of the series over the number of jumps, less ln y.

    Terms rise to one greatest term and fall off; those within 37 of its logarithm are added, wherever it is.
    """
    a = (2 - power) / (power - 1)  # the jumps' shape
    log_z = a * np.log(y) - (1 + a) * np.log(phi) - a * np.log(power - 1) - np.log(2 - power)
    top = np.maximum(1.0, np.rint(y ** (2 - power) / (phi * (2 - power))))

    def term(j, z):
        return j * z - lgamma(j + 1) - lgamma(a * j)

    half = np.ceil(np.sqrt(2 * 37 * top / (1 + a))) + 12  # the curvature at the top is (1 + a) / top at least nearly
    out = np.full(len(y), -np.inf)
    order = np.argsort(half)
    for part in np.array_split(order, max(1, len(order) // 4096)):
        if not len(part):
            continue
        reach = half[part].max()
        while True:
            low = np.maximum(1.0, top[part] - reach)
            j = low[:, None] + np.arange(2 * reach + 1)
            terms = term(j, log_z[part][:, None])
            best = terms.max(1)
            if ((terms[:, -1] < best - 37) & ((low == 1) | (terms[:, 0] < best - 37))).all():
                break
            reach *= 2
        out[part] = best + np.log(np.exp(terms - best[:, None]).sum(1))
    return out - np.log(y)


def tweedie_log_density(y: np.ndarray, mean: np.ndarray, phi: float, power: float) -> np.ndarray:
    """ln density of Tweedie's family for 1 < power < 2: a mass at 0 and a compound of gamma jumps above."""
    out = -(mean ** (2 - power)) / ((2 - power) * phi)
    some = y > 0
    out[some] += y[some] * mean[some] ** (1 - power) / ((1 - power) * phi) + tweedie_series(y[some], phi, power)
    return out


@dataclass
class Block:
    """Units of one system: rows' y, offset, x (fixed effects by rows) and level, first row and number of rows of each unit, distinct y above 0 and their counts."""

    y: np.ndarray
    offset: np.ndarray
    x: np.ndarray
    level: np.ndarray
    n_levels: int
    first: np.ndarray
    size: np.ndarray
    above: np.ndarray
    times: np.ndarray


def _unit_pass(own: Block, theta: dict, series: float, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, modes) of a block for one candidate: value, slopes and curvature by (fixed effects, levels), rows and units.

    Newton steps begin at u. A unit's effect is a factor of its rows' means, so a step needs the unit's two sums only, unless a
    predictor comes near the bounds, where each row is bounded on its own.
    """
    power, phi, sd = theta["power"], theta["phi"], theta["sd_unit"]
    p, units = len(own.x), len(own.first)
    eta0 = theta["z"][:p] @ own.x + own.offset
    if own.n_levels:
        eta0 += theta["z"][p:][own.level]
    most = np.abs(eta0).max(initial=0)
    inner = np.clip(eta0, -60, 60)
    low, high = own.y * np.exp((1 - power) * inner), np.exp((2 - power) * inner)
    sum_low, sum_high = np.add.reduceat(low, own.first), np.add.reduceat(high, own.first)

    def bounded(u):
        eta = np.clip(eta0 + np.repeat(u, own.size), -60, 60)
        return own.y * np.exp((1 - power) * eta), np.exp((2 - power) * eta)

    for k in range(60):
        plain = most + np.abs(u).max(initial=0) < 60
        if plain:
            a, b = sum_low * np.exp((1 - power) * u), sum_high * np.exp((2 - power) * u)
        else:
            a, b = (np.add.reduceat(m, own.first) for m in bounded(u))
        slope = (a - b) / phi - u / sd**2
        bend = ((2 - power) * b + (power - 1) * a) / phi + 1 / sd**2
        step = np.clip(slope / bend, -1, 1)
        if k == 59 or np.abs(step).max(initial=0) < 1e-9:
            break
        u = u + step
    m1, m2 = (low * np.repeat(np.exp((1 - power) * u), own.size), high * np.repeat(np.exp((2 - power) * u), own.size)) if plain else bounded(u)
    d_eta, w = (m1 - m2) / phi, ((2 - power) * m2 + (power - 1) * m1) / phi
    ll = m1.sum() / ((1 - power) * phi) - m2.sum() / ((2 - power) * phi)
    value = ll + series - (u * u).sum() / (2 * sd**2) - 0.5 * np.log(bend * sd**2).sum()
    wx = w * own.x
    cell = np.repeat(np.arange(units), own.size) * own.n_levels + own.level
    sums = np.concatenate([np.stack([np.add.reduceat(r, own.first) for r in wx], axis=1), np.bincount(cell, w, units * own.n_levels).reshape(units, -1)], axis=1)
    by_level = lambda v: np.bincount(own.level, v, own.n_levels)
    cross = np.stack([by_level(r) for r in wx])
    curve = np.block([[wx @ own.x.T, cross], [cross.T, np.diag(by_level(w))]]) - (sums / bend[:, None]).T @ sums
    return np.r_[value, own.x @ d_eta, by_level(d_eta), curve.ravel(), len(own.y), units], u


#: Rows of a block of units: so many that its columns stay close to the processor.
BLOCK = 1 << 13


def _packed(units: DataFrame, p: int) -> DataFrame:
    """_s, sizes and body of units (_s, rows): one row for about BLOCK rows of a system's units; body is their y, o, t and x, column by column, as bytes."""

    def run(batches):
        for b in batches:
            system = np.array(b.column(0).to_pylist(), object)
            counts = pa.compute.list_value_length(b.column(1)).to_numpy()
            flat = b.column(1).flatten()
            x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), p)
            cells = np.concatenate([np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in ("y", "o", "t")]).astype(float), x.T])
            owner = np.repeat(np.arange(len(counts)), counts)
            for s in set(system):
                mine = np.flatnonzero(system == s)
                for part in np.split(mine, np.flatnonzero(np.diff(np.cumsum(counts[mine]) // BLOCK)) + 1):
                    at = np.isin(owner, part)
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([counts[part].astype(np.int64).tobytes()], pa.binary()), pa.array([cells[:, at].tobytes()], pa.binary())], ["_s", "sizes", "body"])

    return units.mapInArrow(run, "_s string, sizes binary, body binary")


def _block(sizes: bytes, body: bytes, p: int, n_levels: int) -> Block:
    cells = np.frombuffer(body, np.float64).reshape(3 + p, -1)
    size = np.frombuffer(sizes, np.int64)
    y = cells[0]
    above, times = np.unique(y[y > 0], return_counts=True)
    return Block(y, cells[1], cells[3:], cells[2].astype(np.int64), n_levels, np.r_[0, np.cumsum(size)[:-1]], size, above, times)


def _sum_pass(blocks: DataFrame, candidates: dict[str, list[dict]], n_levels: int, q: int) -> dict[str, list[np.ndarray]]:
    """_unit_pass() of all candidates of all systems over all units: one job. A task's sums of a system are one row, and these are added up.

    Candidates lie close together, so that each begins at the modes of the one before. Their series goes by distinct y.
    """
    size = 1 + q + q * q + 2

    def rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["_s", "v"])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for s, sizes, body in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if s not in candidates:
                    continue
                own = _block(sizes.as_buffer(), body.as_buffer(), q - n_levels, n_levels)
                known: dict[tuple[float, float], float] = {}
                u = np.zeros(len(own.first))
                sums = total.setdefault(s, np.zeros((len(candidates[s]), size)))
                for i, theta in enumerate(candidates[s]):
                    key = theta["phi"], theta["power"]
                    if key not in known:
                        known[key] = float(tweedie_series(own.above, *key) @ own.times)
                    part, u = _unit_pass(own, theta, known[key], u)
                    sums[i] += part
        yield rows(total)

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for s, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(v.as_buffer(), np.float64)
        yield rows(total)

    schema = "_s string, v binary"
    out = {s: np.zeros((len(c), size)) for s, c in candidates.items()}
    for s, v in blocks.mapInArrow(run, schema).repartition("_s").mapInArrow(add, schema).collect():
        out[s] += np.frombuffer(v, np.float64).reshape(-1, size)
    return {s: list(v) for s, v in out.items()}


def _read(v: np.ndarray, z: np.ndarray, sd_level: float, p: int) -> dict:
    """A candidate's Laplace log likelihood at its (fixed effects, levels) z, the step to their joint mode, and the curvature there."""
    q = len(z)
    slope = v[1 : 1 + q].copy()
    curve = v[1 + q : 1 + q + q * q].reshape(q, q).copy()
    level = z[p:]
    slope[p:] -= level / sd_level**2
    curve[p:, p:] += np.eye(q - p) / sd_level**2
    value = v[0] - level @ level / (2 * sd_level**2) - 0.5 * np.linalg.slogdet(sd_level**2 * curve[p:, p:])[1]
    step = np.linalg.solve(curve + 1e-12 * np.trace(curve) / q * np.eye(q), slope)
    inner = np.linalg.solve(curve[p:, p:], slope[p:])
    return {"value": value, "step": step, "decrement": float(slope @ step), "inner": inner, "inner_gain": 0.5 * float(slope[p:] @ inner), "curve": curve, "rows": round(v[-2]), "units": round(v[-1])}


def _theta(psi: np.ndarray, z: np.ndarray) -> dict:
    return {"phi": float(np.exp(psi[0])), "power": float(1 + 1 / (1 + np.exp(-psi[1]))), "sd_unit": float(np.exp(psi[2])), "sd_level": float(np.exp(psi[3])), "z": z}


def tweedie(df: DataFrame, system: str, unit: str, level: str, features: list[str], y: str, offset: str | None = None, rounds: int = 25, most_levels: int = 366) -> list[MixedFit]:
    """Tweedie regressions (log link, offset) with random intercepts of unit and level, one for each system, fitted at once.

    Variances, dispersion and power maximise Laplace's likelihood by Newton steps from central differences; fixed effects are at
    the joint mode with the random ones at each of those, then take two steps along the slope of the likelihood itself. Incomplete
    rows, and those with y below 0, are left out. A unit's rows are one array, as a unit has few rows for each level. df is read
    three times, so it should be written out (checkpointed) if it is dear.
    """
    own = complete(df, system, unit, level, y, features, offset).where("_y >= 0")
    levels = _levels(own, "_t", most_levels)
    number = F.array_position(F.array(*map(F.lit, levels)), F.col("_t")).cast("int") - 1 if levels else F.lit(0)
    row = F.struct(F.col("_y").alias("y"), F.col("_o").alias("o"), number.alias("t"), F.array(F.lit(1.0), *(F.col(f"_x{i}") for i in range(len(features)))).alias("x"))
    start = own.groupBy("_s").agg(F.ln(F.sum("_y") / F.sum(F.exp("_o"))).alias("b"), F.avg("_y").alias("m"), F.count("*").alias("n")).orderBy("_s").collect()
    p, q = len(features) + 1, len(features) + 1 + len(levels)
    # so many tasks in each pass, whatever the size that the rows had before
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, sum(r["n"] for r in start) // (64 * BLOCK))
    units = own.repartition(tasks, "_s", "_u").groupBy("_s", "_u").agg(F.collect_list(row).alias("rows")).select("_s", "rows")
    blocks = checkpointed(_packed(units, p))
    state = {}
    for r in start:
        if r["b"] is None:
            raise ValueError(f"system {r['_s']} has no value above 0")
        z = np.zeros(q)
        z[0] = r["b"]
        state[r["_s"]] = {"z": z, "psi": np.array([0.5 * np.log(max(r["m"], 1e-3)), 0.0, -1.0, -1.0]), "best": -np.inf, "damp": 1.0, "done": False}

    def evaluate(asked: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> dict[str, list[dict]]:
        found = _sum_pass(blocks, {s: [_theta(psi, z) for psi, z in c] for s, c in asked.items()}, len(levels), q)
        return {s: [_read(v, z, float(np.exp(psi[3])), p) for v, (psi, z) in zip(found[s], asked[s], strict=True)] for s in asked}

    def settle(asked: dict[str, list[tuple[np.ndarray, np.ndarray]]], passes: int) -> tuple[dict, dict]:
        """Newton steps of each candidate's fixed effects and levels."""
        for _ in range(passes):
            got = evaluate(asked)
            asked = {s: [(psi, z + g["step"] * min(1.0, 2.0 / max(np.abs(g["step"]).max(), 1e-12))) for (psi, z), g in zip(c, got[s], strict=True)] for s, c in asked.items()}
        return asked, evaluate(asked)

    asked, _ = settle({s: [(v["psi"], v["z"])] for s, v in state.items()}, 6)
    for s in asked:
        state[s]["z"] = asked[s][0][1]
    h, dims = 0.05, 4
    plan = [np.zeros(dims)] + [sign * h * np.eye(dims)[i] for i in range(dims) for sign in (1, -1)]
    pairs = [(i, j) for i in range(dims) for j in range(i)]
    plan += [h * (np.eye(dims)[i] + np.eye(dims)[j]) for i, j in pairs]
    for _ in range(rounds):
        asked, got = settle({s: [(v["psi"] + e, v["z"]) for e in plan] for s, v in state.items() if not v["done"]}, 2)
        if not asked:
            break
        for s, read in got.items():
            v = state[s]
            f = np.array([g["value"] + 0.5 * g["decrement"] for g in read])
            if f[0] < v["best"] - 1e-7 * abs(v["best"]) and v["damp"] > 1e-3:
                v["damp"] /= 2
                v["psi"], v["z"] = v["from"] + v["damp"] * v["move"], v["from_z"]
                continue
            up, down = f[1 : 1 + 2 * dims : 2], f[2 : 2 + 2 * dims : 2]
            g = (up - down) / (2 * h)
            hess = np.diag((up - 2 * f[0] + down) / h**2)
            for (i, j), both in zip(pairs, f[1 + 2 * dims :], strict=True):
                hess[i, j] = hess[j, i] = (both - up[i] - up[j] + f[0]) / h**2
            values, vectors = np.linalg.eigh(-hess)
            move = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-3 * max(np.abs(values).max(), 1e-6)))
            move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-12))
            v |= {"best": float(f[0]), "g": g, "pd": bool(values.min() > 0), "from": v["psi"], "from_z": asked[s][0][1], "move": move, "damp": 1.0, "read": read[0]}
            v["z"] = asked[s][0][1]
            if float(np.abs(g @ move)) < 1e-5:
                v["done"] = True
            else:
                v["psi"] = v["psi"] + move
    for v in state.values():
        v["psi"] = v["from"]
    for _ in range(2):  # fixed effects by the slope of Laplace's likelihood, levels at their mode for each
        size = {s: np.sqrt(np.diag(np.linalg.inv(v["read"]["curve"]))[:p]) * 0.1 for s, v in state.items()}
        shift = lambda s, i, sign: np.r_[sign * size[s][i] * np.eye(p)[i], np.zeros(q - p)]
        asked = {s: [(v["psi"], v["z"])] + [(v["psi"], v["z"] + shift(s, i, sign)) for i in range(p) for sign in (1, -1)] for s, v in state.items()}
        for _ in range(2):
            got = evaluate(asked)
            asked = {s: [(psi, z + np.r_[np.zeros(p), g["inner"]]) for (psi, z), g in zip(c, got[s], strict=True)] for s, c in asked.items()}
        got = evaluate(asked)
        for s, v in state.items():
            f = np.array([g["value"] + g["inner_gain"] for g in got[s]])
            slope = (f[1::2] - f[2::2]) / (2 * size[s])
            curve = got[s][0]["curve"]
            inverse = np.linalg.inv(curve)[:p, :p]
            v |= {"read": got[s][0], "loglik": float(f[0]), "slope": float(np.sqrt(max(slope @ inverse @ slope, 0.0)))}
            v["z"] = asked[s][0][1] + np.r_[inverse @ slope, np.zeros(q - p)]
    _, last = settle_levels(evaluate, state, p)
    out = []
    for s, v in sorted(state.items()):
        t, read = _theta(v["psi"], v["z"]), last[s]
        covariance = np.linalg.inv(read["curve"])[:p, :p]
        left = float(max(np.abs(v["g"] @ v["move"]), v["slope"] ** 2))
        out.append(MixedFit(s, "tweedie", ["(intercept)", *features], v["z"][:p], covariance, t["sd_unit"], t["sd_level"], t["phi"], read["value"] + read["inner_gain"], read["rows"], read["units"], levels, v["z"][p:], left, v["pd"], t["power"]))
    return out


def settle_levels(evaluate, state: dict, p: int) -> tuple[dict, dict]:
    """The levels' effects at their mode for the final fixed effects, and the last reading of each system."""
    for _ in range(2):
        got = evaluate({s: [(v["psi"], v["z"])] for s, v in state.items()})
        for s, v in state.items():
            v["z"] = v["z"] + np.r_[np.zeros(p), got[s][0]["inner"]]
    got = evaluate({s: [(v["psi"], v["z"])] for s, v in state.items()})
    return state, {s: g[0] for s, g in got.items()}


def unit_effects(df: DataFrame, fit: MixedFit, system: str, unit: str, level: str, features: list[str], y: str) -> DataFrame:
    """system, unit, n and effect: the conditional mean of each unit's intercept in a Gaussian fit."""
    own = complete(df.where(F.col(system).cast("string") == fit.system), system, unit, level, y, features)
    fixed = F.lit(float(fit.estimate[0]))
    for b, i in zip(fit.estimate[1:], range(len(features)), strict=True):
        fixed = fixed + F.lit(float(b)) * F.col(f"_x{i}")
    shift = F.element_at(F.map_from_arrays(F.array(*map(F.lit, fit.levels)), F.array(*(F.lit(float(v)) for v in fit.level_effects))), F.col("_t"))
    ratio_unit = (fit.sd_unit / fit.scale) ** 2
    sums = own.groupBy(F.col("_s").alias("system"), F.col("_u").alias("unit")).agg(F.count("*").alias("n"), F.sum(F.col("_y") - fixed - shift).alias("r"))
    return sums.select("system", "unit", "n", (F.lit(ratio_unit) * F.col("r") / (1 + F.lit(ratio_unit) * F.col("n"))).alias("effect"))


def fixed_table(spark: SparkSession, fits: list[MixedFit]) -> DataFrame:
    """A row for each fixed effect: estimate, se, z, p and interval, with the system's variances, likelihood and validity."""
    rows = [
        (f.system, f.family, t, float(b), float(np.sqrt(v)) if v > 0 else None, f.sd_unit, f.sd_level, f.scale, f.power, float(f.loglik), float(2 * f.parameters - 2 * f.loglik), f.rows, f.units, f.valid)
        for f in fits
        for t, b, v in zip(f.names, f.estimate, np.diag(f.covariance), strict=True)
    ]
    own = spark.createDataFrame(rows, "system string, family string, term string, estimate double, se double, sd_unit double, sd_level double, scale double, power double, loglik double, aic double, n long, n_units long, valid boolean")
    z = ratio(F.col("estimate"), F.col("se"))
    return own.withColumns({"z": z, "p": normal_two_sided(z), "low": F.col("estimate") - 1.959963984540054 * F.col("se"), "high": F.col("estimate") + 1.959963984540054 * F.col("se")})
