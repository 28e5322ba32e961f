"""Backtests of every portfolio x scheme x window as one job.

Each month rebalances to a target, so the holding that drifted into month t depends on month
t-1's target and returns only. The *market* table carries, per (window, scheme, month), the
coefficients of this month and of the month before; a trial-month is then a row-local
expression over the market row and the portfolio's weights.

Portfolios are dealt into slots by a hash of their mask, and every slot of a window gets its own
copy of the window's market rows: both sides are laid out by (window, slot) while they are still
small, at any size by the same plan. Month expansion, drawdown windows and metric aggregates keep
that layout, so the large trial-month table is never shuffled and no window meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.functions.scalar import clip, safe_div, zero_if_null
from tidepanel.operators import signals as sg
from tidepanel.operators.covariance import refit_covariance
from tidepanel.operators.returns import calendar
from tidepanel.operators.schemes import Scheme
from tidepanel.operators.solvers import solver_weights
from tidepanel.operators.universe import Roster, availability, combination_count, portfolio_space, roster_position, window_months
from tidepanel.operators.weights import equal_weight, inverse_risk, weight_columns
from tidepanel.session import materialize

ROWS_PER_PARTITION = 500_000
PARTS_PER_TASK_SLOT = 2  # slots are dealt by hash: some spare ones even the load
TRIAL_KEYS = ["window_id", "scheme", "mask"]
LAID_OUT = [*TRIAL_KEYS, "slot"]  # group by these to keep the layout
# This month's and (suffix 1) last month's coefficients and returns, one column per series each.
MARKET_COLUMNS = ("u", "s", "h", "r", "u1", "s1", "r1")


@dataclass(frozen=True)
class TrialSettings:
    cap: float = 0.35
    cost_bps: float = 10.0
    lev_rate: float = 0.0
    trailing: int = 36
    shrink: str = "lw"
    cadence: str = "A"
    erc_cap_mode: str = "capped"
    min_sleeves: int = 5
    max_sleeves: int = 8
    # True: covariances see no history from before the window.
    history_inside_window: bool = False
    # True: overlay schemes earn nothing until a refit has a covariance; False: they start equal-weighted.
    overlays_wait_for_covariance: bool = False

    @property
    def cost(self) -> float:
        return self.cost_bps / 10000.0


def window_history(returns: DataFrame, months: DataFrame, rows: int, cal: DataFrame) -> DataFrame:
    """Returns of each window and of up to ``rows`` calendar rows before it, keyed by window."""
    spans = months.groupBy("window_id").agg(F.min("cal_idx").alias("lo"), F.max("cal_idx").alias("hi"))
    periods = (spans.withColumn("cal_idx", F.explode(F.sequence(
        F.greatest(F.col("lo") - rows, F.lit(1)), F.col("hi")))).join(F.broadcast(cal.select("period", "cal_idx")), "cal_idx"))
    return returns.join(F.broadcast(periods.select("window_id", "period")), "period")


def macro_table(returns: DataFrame, roster: Roster, schemes: Sequence[Scheme]) -> DataFrame:
    """Signals of the inflation and equity proxies: ``(period, key, value)`` over the whole history.

    The proxy is the first of the roster's candidates that exists in the panel.
    """
    spark = returns.sparkSession
    candidates = [*roster.inflation_proxies, *roster.equity_proxies]
    present = {r.entity for r in returns.where(F.col("entity").isin(candidates)).select("entity").distinct().collect()}
    infl = next((x for x in roster.inflation_proxies if x in present), None)
    eq = next((x for x in roster.equity_proxies if x in present), None)
    keys = ["entity"]
    wanted = []
    for s in schemes:
        if infl and ("infl_regime" in (s.gate_signal, s.scale_signal)):
            wanted.append((infl, "infl", s.infl_lookback))
        if eq and s.infl_confirm:
            wanted.append((eq, "eq", s.eq_confirm_lookback))
        if eq and s.scale_signal == "eq_mom":
            wanted.append((eq, "eq", s.scale_lookback))
        if eq and s.scale_signal == "eq_vol":
            wanted.append((eq, "vol", s.scale_lookback))
    entries = []
    for entity, kind, lookback in dict.fromkeys(wanted):
        value = (sg.realised_volatility(keys, lookback) if kind == "vol"
                 else zero_if_null(sg.momentum(keys, lookback)))
        entries.append((entity, f"{kind}:{lookback}", value))
    if not entries:
        return spark.createDataFrame([], "period date, key string, value double")
    df = returns.where(F.col("entity").isin([e for e, _, _ in entries]))
    for i, (_, _, value) in enumerate(entries):
        df = df.withColumn(f"v_{i}", value)
    rows = F.array(*[F.struct(F.lit(entity).alias("of"), F.lit(key).alias("key"), F.col(f"v_{i}").alias("value"))
                     for i, (entity, key, _) in enumerate(entries)])
    return (df.select("entity", "period", F.explode(rows).alias("e"))
            .where("entity = e.of").select("period", "e.key", "e.value"))


def config_frame(spark: SparkSession, schemes: Sequence[Scheme]) -> DataFrame:
    rows = []
    for s in schemes:
        scale_key = {"infl_regime": f"infl:{s.infl_lookback}", "eq_mom": f"eq:{s.scale_lookback}",
                     "eq_vol": f"vol:{s.scale_lookback}"}.get(s.scale_signal)
        infl_key = f"infl:{s.infl_lookback}" if s.gate_signal == "infl_regime" else None
        confirm_key = f"eq:{s.eq_confirm_lookback}" if s.infl_confirm == "eq_neg" else None
        rows.append((s.name, s.base, s.gate_mode, s.gate_signal, s.signal.key, s.momentum.key, infl_key,
                     confirm_key, s.scale_signal, scale_key, s.w_overlay, s.w_hedge, s.w_hedge_bd, s.w_long_bd,
                     s.short_name, s.w_short, s.scale_k, s.scale_floor, s.scale_ceil, s.scale_target_vol,
                     s.split_gross, s.flavor))
    return spark.createDataFrame(rows, (
        "scheme string, base string, gate_mode string, gate_signal string, sig_key string, mom_key string, "
        "infl_key string, confirm_key string, scale_signal string, scale_key string, w_overlay double, "
        "w_hedge double, w_hedge_bd double, w_long_bd double, short_name string, w_short double, scale_k double, "
        "scale_floor double, scale_ceil double, scale_target_vol double, split_gross boolean, flavor boolean"))


def coefficients(history: DataFrame, macro: DataFrame, roster: Roster, schemes: Sequence[Scheme]) -> DataFrame:
    """Per (window, scheme, period, entity): ``u`` and ``s`` with position = base weight * u + s,
    and ``h`` the notional per unit of base weight that funding is charged on."""
    spark = history.sparkSession
    config = config_frame(spark, schemes)
    specs = dict.fromkeys(x for s in schemes for x in (s.signal, s.momentum))
    keys = ["window_id", "entity"]
    table = sg.signal_table(history, keys, list(specs))
    is_eq = F.col("entity").isin(list(roster.equity))
    is_bond = F.col("entity").isin(list(roster.bonds))

    df = (table.join(F.broadcast(config), "sig_key")
          .join(table.select(*keys, "period", F.col("sig_key").alias("mom_key"), F.col("sig").alias("mom")),
                [*keys, "period", "mom_key"]))
    for key, out in (("infl_key", "infl"), ("confirm_key", "confirm"), ("scale_key", "scale_value")):
        side = macro.select("period", F.col("key").alias(key), F.col("value").alias(out))
        df = df.join(F.broadcast(side), ["period", key], "left")

    mode, infl_gate = F.col("gate_mode"), F.col("gate_signal") == "infl_regime"
    sign = sg.direction(F.col("mom"))
    # A momentum gate reads the sign of the trailing return, the other gates are signs already.
    gd = sg.direction(F.col("sig"))
    rising = zero_if_null(F.col("infl")) > 0
    confirmed = F.col("confirm").isNull() | (F.col("confirm") < 0)

    gate = (F.when((mode == "sign") & F.col("mom").isNotNull(), sign)
            .when(mode == "sign", 1.0)
            .when((mode == "cash") & is_eq, F.when(gd > 0, 1.0).otherwise(0.0))
            .when((mode == "short") & is_eq, F.when(gd != 0, gd).otherwise(1.0))
            .otherwise(1.0))
    by_inflation = (F.when(is_eq & rising & confirmed, -F.col("w_hedge")).otherwise(0.0)
                    + F.when(is_bond & rising & confirmed, -F.col("w_hedge_bd")).otherwise(0.0)
                    + F.when(is_bond & ~rising & confirmed, F.col("w_long_bd")).otherwise(0.0))
    by_signal = (F.when(is_eq & (gd < 0), -F.col("w_hedge")).otherwise(0.0)
                 + F.when(is_bond & (gd < 0), -F.col("w_hedge_bd")).otherwise(0.0))
    overlay = F.when(mode == "overlay", F.when(infl_gate, by_inflation).otherwise(by_signal)).otherwise(0.0)

    value, lo, hi = F.col("scale_value"), F.col("scale_floor"), F.col("scale_ceil")
    kind = F.col("scale_signal")
    scale = (F.when(value.isNull(), 1.0)
             .when(kind == "infl_regime", F.when(value > 0, lo).otherwise(hi))
             .when(kind == "eq_mom", clip(1 + F.col("scale_k") * value, lo, hi))
             .when(kind == "eq_vol", clip(
                 F.when(value > 1e-6, safe_div(F.col("scale_target_vol"), value)).otherwise(1.0), lo, hi))
             .otherwise(1.0))
    fixed = F.when((F.col("short_name") != "") & (F.col("entity") == F.col("short_name")), -F.col("w_short")).otherwise(0.0)

    df = (df.withColumn("gate", gate).withColumn("overlay", overlay).withColumn("scale", scale)
          .withColumn("u", F.col("scale") * (F.col("gate") + F.col("overlay") + F.col("w_overlay") * sign))
          .withColumn("s", F.col("scale") * fixed))
    h = F.when(F.col("split_gross"), F.abs("gate") + F.abs("overlay")).otherwise(F.abs("u"))
    return df.select(*keys, "period", "scheme", "base", "flavor", "u", "s", h.alias("h"))


def market(returns: DataFrame, months: DataFrame, roster: Roster, schemes: Sequence[Scheme],
           has_covariance: DataFrame | None = None, cal: DataFrame | None = None) -> DataFrame:
    """One row per (window, scheme, month) with this and last month's coefficients of every series."""
    longest = max([sg.HISTORY_ROWS, *(s.lookback for s in schemes)])
    sleeves = returns.where(F.col("entity").isin(list(roster.names)))
    history = window_history(sleeves, months, longest, calendar(returns) if cal is None else cal)
    coef = coefficients(history, macro_table(returns, roster, schemes), roster, schemes)
    coef = coef.join(F.broadcast(months), ["window_id", "period"])
    coef = coef.join(sleeves.withColumnRenamed("ret", "r"), ["period", "entity"])
    if has_covariance is not None:
        first = has_covariance.groupBy("window_id").agg(F.min("refit_no").alias("first_refit"))
        live = F.col("flavor") & (F.coalesce("first_refit", F.lit(1 << 30)) > F.col("refit_no"))
        coef = coef.join(F.broadcast(first), "window_id", "left")
        for c in ("u", "s", "h"):
            coef = coef.withColumn(c, F.when(live, 0.0).otherwise(F.col(c)))
    series = Window.partitionBy("window_id", "scheme", "entity").orderBy("period")
    lagged = lambda c: zero_if_null(F.lag(c).over(series))
    coef = (coef.withColumn("u1", lagged("u")).withColumn("s1", lagged("s")).withColumn("r1", lagged("r"))
            .withColumn("i", roster_position(roster)))
    cells = [F.expr(f"coalesce(max({c}) FILTER (WHERE i = {i}), 0D)").alias(f"{c}_{i}")
             for c in MARKET_COLUMNS for i in range(roster.n)]
    return coef.groupBy("window_id", "scheme", "base", "period", "m_idx", "refit_no", "is_refit").agg(*cells)


def trial_month_expressions(roster: Roster, fixed_legs: bool) -> dict[str, str]:
    """Growth of the old book, gross return, turnover and notional of one trial-month, as SQL text.

    ``b_i`` is this refit's weight, ``bp_i`` the one in force a month earlier; members are summed
    term by term so that the whole row stays in generated code.
    """
    n = range(roster.n)
    member = "double(shiftright(mask, {i}) & 1)"

    def leg(weight: str, u: str, s: str, i: int) -> str:
        text = f"{weight}_{i} * {u}_{i}"
        return f"({text} + {member.format(i=i)} * {s}_{i})" if fixed_legs else f"({text})"

    now = [leg("b", "u", "s", i) for i in n]
    then = [leg("bp", "u1", "s1", i) for i in n]
    drift = "CASE WHEN growth > 1e-6D THEN (1D + r1_{i}) / growth ELSE 1D END"
    return {
        "growth": "1D + " + " + ".join(f"{then[i]} * r1_{i}" for i in n),
        "gross": " + ".join(f"{now[i]} * r_{i}" for i in n),
        "turnover": " + ".join(f"abs({now[i]} - {then[i]} * {drift.format(i=i)})" for i in n),
        "notional": " + ".join(f"abs({now[i]})" if fixed_legs else f"b_{i} * h_{i}" for i in n),
    }


def run_months(weighted: DataFrame, roster: Roster, settings: TrialSettings, fixed_legs: bool,
               keep: Sequence[str]) -> DataFrame:
    e = trial_month_expressions(roster, fixed_legs)
    df = weighted.withColumn("growth", F.expr(e["growth"]))
    df = df.select(*keep, *[F.expr(e[c]).alias(c) for c in ("gross", "turnover", "notional")], "flavor_funding")
    funding = F.greatest(F.col("notional") - 1.0, F.lit(0.0)) * F.lit(settings.lev_rate / 12.0)
    net = F.col("gross") - F.col("turnover") * F.lit(settings.cost) - F.col("flavor_funding") * funding
    return df.select(*keep, "gross", net.alias("net"), "turnover", "notional")


def weights_in_one_row(weights: DataFrame, roster: Roster, bases: Sequence[str]) -> DataFrame:
    """Per portfolio an array of its weights, by base and then refit, so that a month picks its own by position."""
    entry = F.struct(F.array_position(F.array(*[F.lit(b) for b in bases]), F.col("base")).alias("base_no"), "refit_no", *weight_columns(roster))
    return weights.groupBy("window_id", "slot", "mask", "n_sleeves").agg(F.array_sort(F.collect_list(entry)).alias("refits"))


def pick_weights(joined: DataFrame, roster: Roster, bases: Sequence[str]) -> DataFrame:
    """``b_i`` of the month's refit and ``bp_i``, the weights in force a month earlier."""
    base_no = F.array_position(F.array(*[F.lit(b) for b in bases]), F.col("base"))
    at = ((base_no - 1) * F.expr(f"size(refits) div {len(bases)}") + F.col("refit_no")).cast("int")
    joined = joined.withColumn("now", F.element_at("refits", at))
    joined = joined.withColumn("then", F.when(~F.col("is_refit"), F.col("now")).when(F.col("refit_no") > 1, F.element_at("refits", at - 1)))
    picked = [f"coalesce({x}.b_{i}, 0D) AS {y}_{i}" for x, y in (("now", "b"), ("then", "bp")) for i in range(roster.n)]
    return joined.drop("refits").selectExpr("*", *picked).drop("now", "then")


def refit_weights(combos: DataFrame, cov: DataFrame, months: DataFrame, roster: Roster,
                  bases: Sequence[str], settings: TrialSettings, partitions: int) -> DataFrame:
    """Base weights per (window, portfolio, refit), laid out by (window, mask).

    A refit without a covariance falls back to equal weight.
    """
    parts = []
    for base, power in (("invvol", 1), ("invvar", 2)):
        if base in bases:
            parts.append(inverse_risk(combos, cov, roster, power, settings.cap, base))
    iterative = [b for b in bases if b in ("erc", "minvar")]
    if iterative:
        parts.append(solver_weights(combos, cov, roster, iterative, settings.cap, settings.erc_cap_mode, partitions))
    refits = months.groupBy("window_id").agg(F.collect_set("refit_no").alias("refits"))
    missing = (refits.join(cov.groupBy("window_id").agg(F.collect_set("refit_no").alias("solved")), "window_id", "left")
               .select("window_id", F.explode(F.array_except(
                   "refits", F.coalesce("solved", F.array().cast("array<int>")))).alias("refit_no")))
    ew = equal_weight(combos, roster).join(F.broadcast(missing), "window_id")
    ew = ew.withColumn("base", F.explode(F.array(*[F.lit(b) for b in bases])))
    columns = ["window_id", "mask", "n_sleeves", "refit_no", "base", *weight_columns(roster)]
    out = ew.select(*columns)
    for part in parts:
        out = out.unionByName(part.select(*columns))
    return out


@dataclass
class TrialPlan:
    """Everything a search shares: materialised inputs and the lazily planned trial-months."""
    returns: DataFrame
    months: DataFrame
    cov: DataFrame | None
    roster: Roster
    settings: TrialSettings
    available: dict[int, int]
    branches: list[DataFrame]
    combos: DataFrame
    weights: DataFrame | None


def plan_trials(returns: DataFrame, windows: DataFrame, roster: Roster, schemes: Sequence[Scheme],
                settings: TrialSettings, context: DataFrame | None = None,
                only: DataFrame | None = None, available: dict[int, int] | None = None,
                common: bool = False, also: DataFrame | None = None) -> TrialPlan:
    """Plan all trial-months of the windows.

    ``returns`` is a materialised panel without nulls. ``context`` holds period-level columns
    (references, season) that ride along with the market rows. ``only`` restricts the trials to
    given (window_id, scheme, mask) rows; one with a series that is incomplete in its window has no
    data there and is left out. ``common`` keeps a series only if it is complete in every window, ``also`` only
    if it is complete in those windows (``window_id``, ``start_d``, ``end_d``) too.
    """
    spark = returns.sparkSession
    cal = materialize(calendar(returns))
    months = materialize(window_months(returns, windows, settings.cadence, cal))
    found = availability(returns, months, roster)
    if available is None:
        available = dict(found)
        if common and found:
            shared = (1 << roster.n) - 1
            for mask in found.values():
                shared &= mask
            available = {w: shared for w in found}
    if also is not None:
        more = availability(returns, window_months(returns, also, settings.cadence, cal), roster)
        shared = (1 << roster.n) - 1 if more else 0
        for mask in more.values():
            shared &= mask
        available = {w: mask & shared for w, mask in available.items()}
    needs_cov = any(s.base != "ew" for s in schemes) or settings.overlays_wait_for_covariance
    cov = materialize(refit_covariance(
        returns, months, roster, settings.trailing, settings.shrink, settings.history_inside_window, cal, available)) if needs_cov else None

    counts = {w: combination_count(roster, settings.min_sleeves, settings.max_sleeves, a) for w, a in available.items()}
    n_windows = max(len(available), 1)
    rows = sum(counts.values()) * len(schemes) * months.count() / n_windows if only is None else 0
    partitions = PARTS_PER_TASK_SLOT * max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_PARTITION))
    slots = math.ceil(partitions / n_windows)

    if only is not None:
        held = spark.createDataFrame(list(found.items()), "window_id int, found bigint")
        only = only.join(F.broadcast(held), "window_id").where(F.col("mask").bitwiseAND(F.bitwise_not("found")) == 0).drop("found")
        combos = only.select("window_id", "mask").distinct().withColumn("n_sleeves", F.bit_count("mask"))
    else:
        combos = portfolio_space(spark, roster, settings.min_sleeves, settings.max_sleeves, available)
    slot = F.pmod(F.xxhash64("mask"), F.lit(slots)).cast("int")
    combos = combos.withColumn("window_id", F.col("window_id").cast("int")).withColumn("slot", slot).repartition(partitions, "window_id", "slot")

    wait = cov if settings.overlays_wait_for_covariance else None
    mk = materialize(market(returns, months, roster, schemes, wait, cal))
    # Files carry no "not null": say it again, so that the trial-month code needs no null checks.
    numbers = [f"{c}_{i}" for c in MARKET_COLUMNS for i in range(roster.n)]
    mk = mk.selectExpr(*[c for c in mk.columns if c not in numbers], *[f"coalesce({c}, 0D) AS {c}" for c in numbers])
    if context is not None:
        mk = mk.join(F.broadcast(context), "period", "left")
    flavors = [s.name for s in schemes if s.flavor]
    mk = mk.withColumn("flavor_funding", F.col("scheme").isin(flavors).cast("double") if flavors else F.lit(0.0))
    extra = [c for c in context.columns if c != "period"] if context is not None else []
    keep = [*LAID_OUT, "n_sleeves", "period", "m_idx", *extra]

    fixed = [s.name for s in schemes if s.short_name]
    groups = [
        ("ew", [s.name for s in schemes if s.base == "ew" and not s.short_name], False),
        ("ew", [s.name for s in schemes if s.base == "ew" and s.short_name], True),
        ("cov", [s.name for s in schemes if s.base != "ew" and not s.short_name], False),
        ("cov", [s.name for s in schemes if s.base != "ew" and s.short_name], True),
    ]
    solved = weights = None
    if any(s.base != "ew" for s in schemes):
        bases = list(dict.fromkeys(s.base for s in schemes if s.base != "ew"))
        weights = materialize(refit_weights(combos, cov, months, roster, bases, settings, partitions))
        solved = weights_in_one_row(weights.withColumn("slot", slot).repartition(partitions, "window_id", "slot"), roster, bases)
    if only is not None:
        chosen = only.select(*TRIAL_KEYS).distinct().withColumn("window_id", F.col("window_id").cast("int"))
    branches = []
    for kind, names, legs in groups:
        if not names:
            continue
        drop = [] if legs else [f"{c}_{i}" for c in ("s", "s1") for i in range(roster.n)]
        part = mk.where(F.col("scheme").isin(names)).drop(*drop).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        held = equal_weight(combos, roster) if kind == "ew" else solved
        if only is None:
            weighted = held.join(part.repartition(partitions, "window_id", "slot").hint("shuffle_hash"), ["window_id", "slot"])
        else:  # few chosen trials: each meets the months of its own scheme only
            held = held.join(chosen.where(F.col("scheme").isin(names)), ["window_id", "mask"])
            weighted = held.join(part.hint("shuffle_hash"), ["window_id", "scheme", "slot"])
        if kind == "ew":
            weighted = weighted.selectExpr("*", *[f"b_{i} AS bp_{i}" for i in range(roster.n)])
        else:
            weighted = pick_weights(weighted, roster, bases)
        branches.append(run_months(weighted, roster, settings, legs, keep))
    return TrialPlan(returns, months, cov, roster, settings, available, branches, combos, weights)


def trial_months(plan: TrialPlan) -> DataFrame:
    out = plan.branches[0]
    for branch in plan.branches[1:]:
        out = out.unionByName(branch)
    return out.drop("slot")
