"""Queries: screens of predictors by collinearity over seasons and by cross-validated drops of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import panel as P
from gridloom.operators import screens as V
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import panel, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_COLUMNS = ["x1", "x2", "x3", "x4", "pixels"]
_BLOCKS = {"prices": ["x2_z", "x3_z"], "amounts": ["x1_z"], "balance": ["x5_z"]}


def _rank(c: str) -> str:
    return f"(rank() OVER (PARTITION BY season ORDER BY round({c}, 12)) + (count(*) OVER (PARTITION BY season, round({c}, 12)) - 1) / 2.0)"


_PAIR_SQL = "\nUNION ALL ".join(
    f"SELECT season, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS pearson, round(corr(r_{a}, r_{b}), 6) AS spearman FROM r GROUP BY season"
    for i, a in enumerate(_COLUMNS)
    for b in _COLUMNS[i + 1 :]
)


@query("season_correlations", sql("panel", f""", r AS (SELECT CAST(season AS VARCHAR) AS season, {", ".join(_COLUMNS)}, {", ".join(f"{_rank(c)} AS r_{c}" for c in _COLUMNS)} FROM panel)
{_PAIR_SQL}"""))
def season_correlations(spark, sf):
    """The matrices that season_screen works on."""
    found = V.matrices(panel(spark, sf), _COLUMNS, "season")
    pairs = [(i, j) for i in range(len(_COLUMNS)) for j in range(i + 1, len(_COLUMNS))]
    rows = [(g, _COLUMNS[i], _COLUMNS[j], m.rows, float(m.pearson[i, j]), float(m.spearman[i, j])) for g, m in found.items() for i, j in pairs]
    return rounded(spark.createDataFrame(rows, "season string, a string, b string, n long, pearson double, spearman double"))


@query("season_screen")
def season_screen(spark, sf):
    """Steps of a screen over all seasons: two near copies and a sum are in the core, a further copy is offered."""
    x = {c: F.col(c).cast("double") for c in ("x1", "x2", "x3", "x4", "x5", "pixels")}
    own = panel(spark, sf).withColumns({**x, "copy": x["x1"] + 0.01 * x["pixels"], "sum": x["x2"] * 100 + x["x3"] * 100, "late": -x["x4"]})
    domain = {"x1": "amount", "copy": "amount", "x4": "amount", "late": "amount", "pixels": "amount", "x2": "rate", "x3": "rate", "sum": "rate", "x5": "unit"}
    _, steps = V.within_limits(own, "season", ["copy", "x1", "x2", "x3", "sum", "pixels"], ["x5", "late", "x4"], domain=domain, minimum={"amount": 1, "rate": 1}, priority={"x1": 2, "copy": 1, "sum": 0, "x2": 1, "x3": 1, "pixels": 2})
    out = spark.createDataFrame([tuple(vars(s).values()) for s in steps], "step int, action string, variable string, accepted boolean, size int, variables string, vif double, rho double, condition double")
    return rounded(out)


def _rows(spark, sf) -> DataFrame:
    own = P.zscore(panel(spark, sf), [], ["x1", "x2", "x3", "x5"], population=True)
    return own.withColumn("fold", (F.col("year") % 3).cast("long"))


def _candidates() -> dict[str, list[str]]:
    return V.without_blocks([c for b in _BLOCKS.values() for c in b], _BLOCKS)


@query("zero_component_screen")
def zero_component_screen(spark, sf):
    """Logistic chances of a fire, with all predictors and without a block each, by season and out of fold."""
    return rounded(V.ranked(V.screened(_rows(spark, sf), "occurrence", _candidates(), "fire_count", "pixels", ["season"], "fold"), ["season"], -F.col("log_p")))


@query("count_component_screen")
def count_component_screen(spark, sf):
    """NB1 rates likewise."""
    return rounded(V.ranked(V.screened(_rows(spark, sf), "nb1", _candidates(), "fire_count", "pixels", ["season"], "fold"), ["season"], -F.col("log_p")))
