"""Trailing and shrunk covariances, one row per (window, refit) over the whole roster.

A period is one wide row (roster series as columns), so no pair of series is ever emitted as a row or joined. Sums of
products run over blocks of the calendar; a refit reads two of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.operators.returns import calendar
from tidepanel.operators.universe import Roster, roster_position
from tidepanel.session import materialize

MIN_ROWS = 12


def wide_returns(returns: DataFrame, roster: Roster) -> DataFrame:
    """``(period, r_0 .. r_{n-1})`` in roster order."""
    cells = [F.expr(f"max(ret) FILTER (WHERE i = {i})").alias(f"r_{i}") for i in range(roster.n)]
    return returns.withColumn("i", roster_position(roster)).groupBy("period").agg(*cells)


def pair(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def _products(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """What is summed per calendar row: 1, presence, x, x x', (x^2)(x^2)', (x^2) x'."""
    rows, n = x.shape
    outer = lambda p, r: (p[:, :, None] * r[:, None, :]).reshape(rows, n * n)
    return np.hstack([np.ones((rows, 1)), there, x, outer(x, x), outer(x * x, x * x), outer(x * x, x)])


def running_sums(returns: DataFrame, roster: Roster, cal: DataFrame, block: int) -> DataFrame:
    """``(cal_idx, before, upto, onward)``: sums of the products over the rows of the same block before a row, up to it, and from it on.

    The calendar is cut into blocks of ``block`` rows, one group each. A span of at most ``block`` rows lies in one block or in two neighbours, so its
    sums are the end of one block plus the start of the next, or a difference inside one block: no long running sum is ever
    subtracted from another. Returns are taken from their overall mean first.
    """
    n, names = roster.n, [f"r_{i}" for i in range(roster.n)]
    wide = wide_returns(returns, roster).join(F.broadcast(cal.select("period", "cal_idx")), "period")
    centre = wide.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([centre[c] or 0.0 for c in names])

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cal_idx")
        r = rows[names].to_numpy(dtype=float)
        there = ~np.isnan(r)
        f = _products(np.where(there, r - shift, 0.0), there)
        upto = f.cumsum(axis=0)
        onward = f[::-1].cumsum(axis=0)[::-1]
        return pd.DataFrame({"cal_idx": rows["cal_idx"].to_numpy(), "before": list(np.vstack([np.zeros((1, f.shape[1])), upto[:-1]])),
                             "upto": list(upto), "onward": list(onward)})

    blocks = wide.withColumn("block", F.expr(f"(cal_idx - 1) div {block}"))
    return blocks.groupBy("block").applyInPandas(sums, "cal_idx bigint, before array<double>, upto array<double>, onward array<double>")


def refit_spans(months: DataFrame, trailing: int, inside_window: bool = False) -> DataFrame:
    """First and last calendar row that each refit sees: the ``trailing`` rows strictly before it.

    ``inside_window`` forbids history from before the window (the first refits then have none).
    """
    first = F.min("cal_idx").over(Window.partitionBy("window_id")) if inside_window else F.lit(1)
    return (months.withColumn("earliest", first).where("is_refit").where("cal_idx > earliest")
            .select("window_id", "refit_no", F.greatest(F.col("cal_idx") - trailing, F.col("earliest")).cast("bigint").alias("lo"), (F.col("cal_idx") - 1).cast("bigint").alias("hi")))


def refit_moments(returns: DataFrame, months: DataFrame, roster: Roster, trailing: int, inside_window: bool = False,
                  cal: DataFrame | None = None, available: dict[int, int] | None = None) -> DataFrame:
    """Population covariances and the fourth-moment sum ``q`` of the demeaned rows, per refit; 0 for series that aren't available.

    A refit is two look-ups in the running sums, however long its history and however many refits overlap. ``available`` is the bitmask of the series
    that count, per window (all, if not given). Refits with fewer than ``MIN_ROWS`` rows or with a hole in an available series are left out.
    """
    n = roster.n
    sums = materialize(running_sums(returns, roster, calendar(returns) if cal is None else cal, trailing))
    spans = refit_spans(months, trailing, inside_window)
    if available is None:
        spans = spans.withColumn("avail", F.lit((1 << n) - 1).cast("bigint"))
    else:
        kept = spans.sparkSession.createDataFrame([(w, a) for w, a in available.items() if a], "window_id int, avail bigint")
        spans = spans.join(F.broadcast(kept), "window_id")  # a row per window
    looked = (spans.join(sums.select(F.col("cal_idx").alias("lo"), "before", "onward"), "lo")
              .join(sums.select(F.col("cal_idx").alias("hi"), "upto"), "hi")
              .withColumn("same", F.expr(f"(lo - 1) div {trailing} = (hi - 1) div {trailing}"))
              .select("window_id", "refit_no", "avail", "upto", F.when(F.col("same"), F.transform("before", lambda x: -x)).otherwise(F.col("onward")).alias("other")))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            f = np.stack(batch["upto"].to_numpy()) + np.stack(batch["other"].to_numpy())
            t, counts, s = f[:, 0], f[:, 1:n + 1], f[:, n + 1:2 * n + 1]
            xx, four, three = (f[:, 2 * n + 1 + k * n * n:2 * n + 1 + (k + 1) * n * n].reshape(-1, n, n) for k in range(3))
            on = (batch["avail"].to_numpy()[:, None] >> np.arange(n) & 1).astype(float)
            ok = (t >= MIN_ROWS) & ((counts == t[:, None]) | (on == 0)).all(axis=1)
            t = np.maximum(t, 1.0)
            m, square = s / t[:, None], np.einsum("bii->bi", xx)
            both = on[:, :, None] * on[:, None, :]
            cov = (xx - t[:, None, None] * m[:, :, None] * m[:, None, :]) / t[:, None, None] * both
            # (x_i - m_i)^2 (x_j - m_j)^2, multiplied out; terms that only swap i and j are taken twice
            mi, mj, si = m[:, :, None], m[:, None, :], s[:, :, None]
            q = four - 4 * mj * three + 2 * mj**2 * square[:, :, None] + 4 * mi * mj * xx - 4 * mi * mj**2 * si + t[:, None, None] * mi**2 * mj**2
            out = pd.DataFrame({"window_id": batch["window_id"], "refit_no": batch["refit_no"], "avail": batch["avail"], "n_rows": t.astype(np.int64),
                                "q": (q * both).sum(axis=(1, 2)), **{pair(i, j): cov[:, i, j] for i, j in pairs}})
            yield out[ok]

    schema = "window_id int, refit_no int, avail bigint, n_rows bigint, q double, " + ", ".join(f"{pair(i, j)} double" for i, j in pairs)
    return looked.mapInPandas(moments, schema)


def shrink(moments: DataFrame, roster: Roster, mode: str = "lw") -> DataFrame:
    """``(window_id, refit_no, n_rows, delta, cov ARRAY(n*n), vol ARRAY(n))``.

    ``lw`` shrinks towards the scaled identity; ``none`` keeps the sample covariance. The
    distance to the target and the mean outer-product error need only ||S||^2, the trace and q.
    """
    n = roster.n
    trace = " + ".join(pair(i, i) for i in range(n))
    frob = " + ".join(f"{1 if i == j else 2} * {pair(i, j)} * {pair(i, j)}" for i in range(n) for j in range(i, n))
    df = moments.selectExpr("*", "double(bit_count(avail)) AS n", f"{frob} AS frob", "double(n_rows) AS t").selectExpr("*", f"({trace}) / n AS mu")
    df = df.selectExpr("*", "(frob - n * mu * mu) / n AS d2")
    df = df.selectExpr("*", "least((q - t * frob) / (t * t * n), d2) AS b2")
    delta = "least(greatest(CASE WHEN d2 > 0 THEN b2 / d2 ELSE 0D END, 0D), 1D)" if mode == "lw" else "0D"
    df = df.selectExpr("*", f"{delta} AS delta")

    def entry(i: int, j: int) -> str:
        if mode == "none":
            return f"{pair(i, j)} * t / (t - 1)"
        return f"(1 - delta) * {pair(i, j)}" + (" + delta * mu" if i == j else "")

    cov = ", ".join(entry(i, j) for i in range(n) for j in range(n))
    df = df.selectExpr("window_id", "refit_no", "n_rows", "delta", f"array({cov}) AS cov")
    vol = ", ".join(f"sqrt(greatest(cov[{i * n + i}], 1e-12D))" for i in range(n))
    return df.selectExpr("*", f"array({vol}) AS vol")


def refit_covariance(returns: DataFrame, months: DataFrame, roster: Roster,
                     trailing: int = 36, mode: str = "lw", inside_window: bool = False,
                     cal: DataFrame | None = None, available: dict[int, int] | None = None) -> DataFrame:
    return shrink(refit_moments(returns, months, roster, trailing, inside_window, cal, available), roster, mode)


def long_entries(cov: DataFrame, roster: Roster) -> DataFrame:
    """``(window_id, refit_no, i, j, c)`` with i <= j, by name, for display and checks."""
    n = roster.n
    cells = F.array(*[F.struct(F.lit(roster.names[i]).alias("i"), F.lit(roster.names[j]).alias("j"),
                               F.col("cov")[i * n + j].alias("c"))
                      for i in range(n) for j in range(i, n)])
    return cov.select("window_id", "refit_no", F.explode(cells).alias("e")).select("window_id", "refit_no", "e.*")
