"""The backtest grid in SQL: one row per (window, scheme, portfolio, month, series).

Written the long way round (explicit drifted holdings per series) so that it checks the
row-local form the Spark side uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidepanel.operators.schemes import Scheme
from tidepanel.operators.signals import SignalSpec
from tidepanel.operators.scoring import SCORES
from tidepanel.operators.trials import TrialSettings
from tidepanel.operators.universe import Roster
from tidepanel.plans import fixtures as fx
from tidepanel.plans.oracle import q
from tidepanel.plans.regime_queries import CONTEXT

CTE = tuple[str, str]
HISTORY = 72
BY_K = "PARTITION BY k ORDER BY period"


def windows_cte(spans: Sequence[tuple[str, str]]) -> CTE:
    rows = ", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(spans))
    return ("win", f"SELECT window_id::INTEGER AS window_id, start_d, end_d FROM (VALUES {rows}) v(window_id, start_d, end_d)")


def roster_cte(roster: Roster) -> CTE:
    rows = ", ".join(f"({i}, '{x}', {str(x in roster.equity).lower()}, {str(x in roster.bonds).lower()})"
                     for i, x in enumerate(roster.names))
    return ("ros", f"SELECT * FROM (VALUES {rows}) v(i, entity, is_eq, is_bd)")


def months_ctes(win: CTE | None = None) -> list[CTE]:
    return [*([win] if win else []),
            ("rcal", "SELECT period, row_number() OVER (ORDER BY period) AS idx FROM (SELECT DISTINCT period FROM ret)"),
            ("wm", "SELECT window_id, period, idx, row_number() OVER (PARTITION BY window_id ORDER BY period) - 1 AS m, "
             "dense_rank() OVER (PARTITION BY window_id ORDER BY year(period)) AS refit_no FROM win JOIN rcal ON period BETWEEN start_d AND end_d"),
            ("rf", "SELECT window_id, refit_no, min(idx) AS ridx FROM wm GROUP BY 1, 2")]


def availability_ctes(common: bool, also: tuple[str, str] | None = None) -> list[CTE]:
    per = ("SELECT window_id, entity FROM wm JOIN ret USING (period) JOIN ros USING (entity) GROUP BY 1, 2 "
           "HAVING count(ret) = (SELECT count(*) FROM wm w WHERE w.window_id = wm.window_id)")
    out = [("av", per)]
    if common:
        out.append(("ok", "SELECT w.window_id, entity FROM (SELECT DISTINCT window_id FROM wm) w, "
                          "(SELECT entity FROM av GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT window_id) FROM wm))"))
    elif also:
        span = f"period BETWEEN DATE '{also[0]}' AND DATE '{also[1]}'"
        out.append(("ok", f"SELECT av.* FROM av WHERE entity IN (SELECT entity FROM ret WHERE {span} GROUP BY 1 "
                          f"HAVING count(ret) = (SELECT count(*) FROM rcal WHERE {span}))"))
    else:
        out.append(("ok", "SELECT * FROM av"))
    return out


def combos_ctes(roster: Roster, lo: int, hi: int) -> list[CTE]:
    eq, bd = roster.mask(roster.equity), roster.mask(roster.bonds)
    return [("avm", "SELECT window_id, CAST(sum(1 << i) AS BIGINT) AS a FROM ok JOIN ros USING (entity) GROUP BY 1"),
            ("combos", f"SELECT window_id, range AS mask, bit_count(range) AS n_sleeves FROM range(1, {1 << roster.n}) JOIN avm "
             f"ON (range & a) = range WHERE (range & {eq}) <> 0 AND (range & {bd}) <> 0 AND bit_count(range) BETWEEN {lo} AND {hi}"),
            ("mem", "SELECT window_id, mask, n_sleeves, i, entity, is_eq, is_bd FROM combos JOIN ros ON (mask >> i) & 1 = 1")]


def covariance_ctes(trailing: int, mode: str = "lw") -> list[CTE]:
    """``sij`` (population), ``cv`` (final covariance, both orders) and ``vol``."""
    return [
        ("x0", f"SELECT rf.window_id, rf.refit_no, c.period, ros.i, ret.ret FROM rf JOIN rcal c ON c.idx BETWEEN ridx - {trailing} AND ridx - 1 "
         "JOIN ok ON ok.window_id = rf.window_id JOIN ros ON ros.entity = ok.entity LEFT JOIN ret ON ret.period = c.period AND ret.entity = ros.entity"),
        ("xg", "SELECT window_id, refit_no, count(DISTINCT period) AS t FROM x0 GROUP BY 1, 2 HAVING count(DISTINCT period) >= 12 AND count(*) = count(ret)"),
        ("x", "SELECT window_id, refit_no, t, period, i, ret - avg(ret) OVER (PARTITION BY window_id, refit_no, i) AS d FROM x0 JOIN xg USING (window_id, refit_no)"),
        ("sij", "SELECT a.window_id, a.refit_no, a.t, a.i AS i, b.i AS j, avg(a.d * b.d) AS s FROM x a JOIN x b USING (window_id, refit_no, period) GROUP BY 1, 2, 3, 4, 5"),
        ("qq", "SELECT window_id, refit_no, sum(n2 * n2) AS q FROM (SELECT window_id, refit_no, period, sum(d * d) AS n2 FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2"),
        ("sh", "SELECT window_id, refit_no, t, n, mu, frob, d2, least((q - t * frob) / (t * t * n), d2) AS b2 FROM (SELECT window_id, refit_no, t, "
         "count(*) FILTER (i = j) AS n, avg(s) FILTER (i = j) AS mu, sum(s * s) AS frob, "
         "(sum(s * s) - count(*) FILTER (i = j) * avg(s) FILTER (i = j) * avg(s) FILTER (i = j)) / count(*) FILTER (i = j) AS d2 FROM sij GROUP BY 1, 2, 3) JOIN qq USING (window_id, refit_no)"),
        ("dl", f"SELECT window_id, refit_no, t, mu, {'least(greatest(CASE WHEN d2 > 0 THEN b2 / d2 ELSE 0.0 END, 0.0), 1.0)' if mode == 'lw' else '0.0'} AS delta FROM sh"),
        ("cv", "SELECT window_id, refit_no, t, delta, i, j, " + (
            "(1 - delta) * s + CASE WHEN i = j THEN delta * mu ELSE 0 END" if mode == "lw" else "s * t / (t - 1)")
         + " AS c FROM sij JOIN dl USING (window_id, refit_no, t)"),
        ("vol", "SELECT window_id, refit_no, i, sqrt(greatest(c, 1e-12)) AS v FROM cv WHERE i = j"),
    ]


def capped_ctes(source: str, group: str, cap: float, out: str, tie: str = "i") -> list[CTE]:
    """Clip and spread the excess over the free members, in closed form: w + d, cut at the cap. ``source`` has ``w0``."""
    part = f"PARTITION BY {group}"
    down = f"{part} ORDER BY w DESC, {tie}"
    return [
        (f"{out}_0", f"SELECT *, w0 / sum(w0) OVER ({part}) AS w, count(*) OVER ({part}) AS sz FROM {source}"),
        (f"{out}_1", f"SELECT *, row_number() OVER ({down}) - 1 AS k, sum(w) OVER ({down} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {out}_0"),
        (f"{out}_2", f"SELECT *, (1.0 - k * {cap} - rest) / (sz - k) AS d FROM {out}_1"),
        (f"{out}_3", f"SELECT * EXCLUDE (w, d), CASE WHEN sz * {cap} < 1.0 THEN 1.0 / sz ELSE least({cap}, w + greatest(coalesce("
         f"arg_min(d, k) FILTER (w + d <= {cap} + 1e-12) OVER ({part}), 0.0), 0.0)) END AS w FROM {out}_2"),
        (out, f"SELECT * EXCLUDE (w), w / sum(w) OVER ({part}) AS w FROM {out}_3"),
    ]


def weights_ctes(bases: Sequence[str], cap: float) -> list[CTE]:
    """``bw``: (window_id, mask, refit_no, base, i, b)."""
    ew = "SELECT m.window_id, mask, rf.refit_no, '{b}' AS base, i, 1.0 / n_sleeves AS b FROM mem m JOIN rf ON rf.window_id = m.window_id"
    parts, ctes = [], []
    for base in bases:
        if base == "ew":
            parts.append(ew.format(b="ew"))
            continue
        power = {"invvol": 1, "invvar": 2}[base]
        ctes.append((f"raw_{base}", f"SELECT m.window_id, mask, refit_no, m.i, 1.0 / pow(v, {power}) AS w0 FROM mem m JOIN vol ON vol.window_id = m.window_id AND vol.i = m.i"))
        ctes += capped_ctes(f"raw_{base}", "window_id, mask, refit_no", cap, f"cap_{base}")
        parts.append(f"SELECT window_id, mask, refit_no, '{base}' AS base, i, w AS b FROM cap_{base}")
        parts.append(ew.format(b=base) + " WHERE NOT EXISTS (SELECT 1 FROM xg WHERE xg.window_id = rf.window_id AND xg.refit_no = rf.refit_no)")
    return [*ctes, ("bw", " UNION ALL ".join(parts))]


def _before(n: int) -> str:
    return f"OVER ({BY_K} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 ELSE 0.0 END"


def _momentum(n: int, frame: str) -> str:
    return f"CASE WHEN count(ret) {frame} = {n} THEN product(1 + ret) {frame} - 1 END"


def signals_ctes(specs: Sequence[SignalSpec]) -> tuple[list[CTE], dict[str, str]]:
    """``sg``: one column per signal; returns the column of each signal key."""
    ctes: list[CTE] = [
        ("w0", f"SELECT window_id, greatest(min(idx) - {HISTORY}, 1) AS lo, max(idx) AS hi FROM wm GROUP BY 1"),
        ("hs", "SELECT w0.window_id || '|' || ret.entity AS k, w0.window_id, ret.entity, ret.period, ret.ret FROM w0 JOIN rcal ON idx BETWEEN lo AND hi JOIN ret USING (period) JOIN ros USING (entity)"),
        ("h0", f"SELECT *, row_number() OVER ({BY_K}) - 1 AS t, product(1 + ret) OVER ({BY_K} ROWS UNBOUNDED PRECEDING) AS lvl FROM hs"),
        ("h1", f"SELECT *, lag(lvl) OVER ({BY_K}) AS lvl1, CASE WHEN t >= 6 THEN stddev_pop(ret) {_before(6)} * sqrt(12.0) ELSE 0.0 END AS rv FROM h0"),
        ("h2", f"SELECT *, lag(rv) OVER ({BY_K}) AS rv1, median(rv) {_before(60)} AS med, CASE WHEN t >= 6 THEN (lvl1 - max(lvl) {_before(6)}) / max(lvl) {_before(6)} END AS dd FROM h1"),
    ]
    columns, joins, exprs = {}, [], []
    for n, spec in enumerate(specs):
        col, p = f"s{n}", spec.params
        columns[spec.key] = col
        ma = lambda length: f"avg(lvl) {_before(length)}"
        if spec.kind == "none":
            exprs.append(f"0.0 AS {col}")
        elif spec.kind == "mom":
            exprs.append(f"{_momentum(p[0], _before(p[0]))} AS {col}")
        elif spec.kind == "ma":
            exprs.append(f"CASE WHEN t >= {p[0]} THEN {_sign(f'(lvl1 - {ma(p[0])})')} ELSE 0.0 END AS {col}")
        elif spec.kind == "dma":
            exprs.append(f"CASE WHEN t >= {p[1]} THEN {_sign(f'({ma(p[0])} - {ma(p[1])})')} ELSE 0.0 END AS {col}")
        elif spec.kind == "vol":
            exprs.append(f"CASE WHEN t >= {p[1]} THEN {_sign('(med - rv1)')} ELSE 0.0 END AS {col}")
        elif spec.kind == "eq_dd":
            exprs.append(f"CASE WHEN dd < -{p[1]} THEN -1.0 WHEN dd > -{p[2]} THEN 1.0 ELSE 0.0 END AS {col}")
        else:
            if spec.kind == "asym_ma":
                source = f"SELECT k, period, t, t >= {p[1]} AND lvl1 < {ma(p[0])} AS x, t >= {p[1]} AND lvl1 > {ma(p[1])} AS e FROM h2"
            elif spec.kind == "dd_stop":
                source = f"SELECT k, period, t, coalesce(dd < -{p[1]}, false) AS x, coalesce(dd > -{p[2]}, false) AS e FROM h2"
            else:
                source = f"SELECT k, period, t, t >= {p[1]} AND rv1 > {p[2]} * med AS x, t >= {p[1]} AND rv1 < {p[3]} * med AS e FROM h2"
            ctes.append((f"tr{n}", source))
            ctes.append((f"wk{n}", f"SELECT k, t, period, CASE WHEN x THEN -1.0 ELSE 1.0 END AS s FROM tr{n} WHERE t = 0 UNION ALL SELECT n.k, n.t, n.period, "
                         f"CASE WHEN w.s > 0 AND n.x THEN -1.0 WHEN w.s < 0 AND n.e THEN 1.0 ELSE w.s END FROM wk{n} w JOIN tr{n} n ON n.k = w.k AND n.t = w.t + 1"))
            exprs.append(f"wk{n}.s AS {col}")
            joins.append(f"JOIN wk{n} ON wk{n}.k = h2.k AND wk{n}.period = h2.period")
    if joins:
        head = [e for e in exprs if not e.startswith("wk")]
        ctes.append(("h3", f"SELECT *, {', '.join(head)} FROM h2" if head else "SELECT * FROM h2"))
        walked = [e for e in exprs if e.startswith("wk")]
        ctes.append(("sg", f"SELECT h3.*, {', '.join(walked)} FROM h3 " + " ".join(j.replace("h2.", "h3.") for j in joins)))
    else:
        ctes.append(("sg", f"SELECT *, {', '.join(exprs)} FROM h2"))
    return ctes, columns


def macro_cte(roster: Roster) -> CTE:
    infl, eq = "Brand#9", "Brand#1"
    frame = lambda n: f"OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    mom = lambda n: f"coalesce({_momentum(n, frame(n))}, 0.0)"
    vol = f"coalesce(CASE WHEN count(ret) {frame(6)} = 6 THEN stddev_samp(ret) {frame(6)} END, 0.0) * sqrt(12.0)"
    return ("mac", f"SELECT period, max(CASE WHEN entity = '{infl}' THEN i12 END) AS infl, max(CASE WHEN entity = '{eq}' THEN m3 END) AS eq3, "
            f"max(CASE WHEN entity = '{eq}' THEN m6 END) AS eq6, max(CASE WHEN entity = '{eq}' THEN v6 END) AS vol6 FROM (SELECT period, entity, {mom(12)} AS i12, "
            f"{mom(3)} AS m3, {mom(6)} AS m6, {vol} AS v6 FROM ret WHERE entity IN ('{infl}', '{eq}')) GROUP BY 1")


def coefficient(s: Scheme, columns: dict[str, str]) -> str:
    sig, mom = columns[s.signal.key], columns[s.momentum.key]
    gd, sgn = _sign(sig), _sign(mom)
    gate, overlay, scale = "1.0", "0.0", "1.0"
    if s.gate_mode == "sign":
        gate = f"CASE WHEN {mom} IS NULL THEN 1.0 ELSE {sgn} END"
    elif s.gate_mode == "cash":
        gate = f"CASE WHEN is_eq AND NOT ({gd} > 0) THEN 0.0 ELSE 1.0 END"
    elif s.gate_mode == "short":
        gate = f"CASE WHEN is_eq AND {gd} <> 0 THEN {gd} ELSE 1.0 END"
    elif s.gate_mode == "overlay" and s.gate_signal == "infl_regime":
        ok = f"eq{s.eq_confirm_lookback} < 0" if s.infl_confirm else "true"
        overlay = (f"CASE WHEN {ok} AND infl > 0 THEN (CASE WHEN is_eq THEN -{s.w_hedge} WHEN is_bd THEN -{s.w_hedge_bd} ELSE 0.0 END) "
                   f"WHEN {ok} AND is_bd THEN {s.w_long_bd} ELSE 0.0 END")
    elif s.gate_mode == "overlay":
        overlay = f"CASE WHEN {gd} < 0 AND is_eq THEN -{s.w_hedge} WHEN {gd} < 0 AND is_bd THEN -{s.w_hedge_bd} ELSE 0.0 END"
    if s.scale_signal == "infl_regime":
        scale = f"CASE WHEN infl > 0 THEN {s.scale_floor} ELSE {s.scale_ceil} END"
    elif s.scale_signal == "eq_mom":
        scale = f"least(greatest(1 + {s.scale_k} * eq{s.scale_lookback}, {s.scale_floor}), {s.scale_ceil})"
    elif s.scale_signal == "eq_vol":
        scale = f"least(greatest(CASE WHEN vol6 > 1e-6 THEN {s.scale_target_vol} / vol6 ELSE 1.0 END, {s.scale_floor}), {s.scale_ceil})"
    long_short = f"{s.w_overlay} * {sgn}" if s.w_overlay else "0.0"
    short = f"CASE WHEN sg.entity = '{s.short_name}' THEN -{s.w_short} ELSE 0.0 END" if s.short_name else "0.0"
    return (f"SELECT sg.window_id, sg.period, m, refit_no, sg.entity, i, '{s.name}' AS scheme, '{s.base}' AS base, CAST({gate} AS DOUBLE) AS g, CAST({overlay} AS DOUBLE) AS o, "
            f"CAST({scale} AS DOUBLE) AS sc, CAST({long_short} AS DOUBLE) AS ls, CAST({short} AS DOUBLE) AS sh, {str(s.split_gross).lower()} AS split, {str(s.flavor).lower()} AS flavor, ret "
            "FROM sg JOIN ros USING (entity) JOIN wm USING (window_id, period) LEFT JOIN mac ON mac.period = sg.period")


def trial_ctes(spans, roster: Roster, schemes: Sequence[Scheme], settings: TrialSettings, common: bool = False,
               win: CTE | None = None, only: str | None = None, also: tuple[str, str] | None = None) -> list[CTE]:
    """CTEs up to ``tm``: gross, net, turnover and notional per trial-month."""
    specs = list(dict.fromkeys(x for s in schemes for x in (s.signal, s.momentum)))
    sig, columns = signals_ctes(specs)
    bases = list(dict.fromkeys(s.base for s in schemes))
    restrict = f" SEMI JOIN {only} z ON z.window_id = c.window_id AND z.scheme = c.scheme AND z.mask = b.mask" if only else ""
    cost, lev = settings.cost, settings.lev_rate
    return [
        roster_cte(roster), *months_ctes(win or windows_cte(spans)), *availability_ctes(common, also),
        *combos_ctes(roster, settings.min_sleeves, settings.max_sleeves),
        *covariance_ctes(settings.trailing, settings.shrink),
        *weights_ctes(bases, settings.cap), *sig, macro_cte(roster),
        ("coef", " UNION ALL ".join(coefficient(s, columns) for s in schemes)),
        ("pos", "SELECT c.window_id, c.scheme, b.mask, c.period, c.m, c.entity, c.ret, c.flavor, c.sc * (b.b * (c.g + c.o + c.ls) + c.sh) AS w, "
         "CASE WHEN c.split THEN abs(b.b * c.g + c.sh) + abs(b.b * c.o) ELSE abs(c.sc * (b.b * (c.g + c.o + c.ls) + c.sh)) END AS nt "
         f"FROM coef c JOIN bw b ON b.window_id = c.window_id AND b.base = c.base AND b.refit_no = c.refit_no AND b.i = c.i{restrict}"),
        ("gr", "SELECT window_id, scheme, mask, period, m, flavor, sum(w * ret) AS g, sum(nt) AS nt FROM pos GROUP BY 1, 2, 3, 4, 5, 6"),
        ("held", "SELECT p.*, CASE WHEN 1 + g > 1e-6 THEN w * (1 + ret) / (1 + g) ELSE w END AS e FROM pos p JOIN gr USING (window_id, scheme, mask, period)"),
        ("tn", "SELECT window_id, scheme, mask, period, sum(abs(w - prev)) AS turnover FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY window_id, scheme, mask, entity ORDER BY period), 0) AS prev FROM held) GROUP BY 1, 2, 3, 4"),
        ("tm", f"SELECT gr.window_id, gr.scheme, gr.mask, gr.period, bit_count(gr.mask)::INTEGER AS n_sleeves, g AS gross, turnover, nt AS notional, "
         f"g - turnover * {cost} - CASE WHEN flavor THEN greatest(nt - 1, 0) * {lev} / 12 ELSE 0 END AS net FROM gr JOIN tn USING (window_id, scheme, mask, period)"),
    ]


def _side(test: str) -> str:
    f = f"FILTER (eq_ref {test} 0)"
    return (f"coalesce(CASE WHEN count(*) {f} >= 3 AND var_samp(net) {f} > 0 THEN covar_samp(net, eq_ref) {f} / nullif(var_samp(eq_ref) {f}, 0) END, 0.0)")


DN = "FILTER (eq_ref < 0)"


def metric_ctes(source: str = "tm", out: str = "met") -> list[CTE]:
    """Metrics per trial; needs the context CTE ``ctx``."""
    part = "PARTITION BY window_id, scheme, mask ORDER BY period"
    season = lambda s: f"avg(net) FILTER (season = '{s}')"
    return [
        (f"{out}_w", f"SELECT t.*, eq_ref, bd_ref, both_down, season, product(1 + net) OVER ({part}) AS wl FROM {source} t LEFT JOIN ctx USING (period)"),
        (f"{out}_d", f"SELECT *, wl / max(wl) OVER ({part}) - 1 AS dd FROM {out}_w"),
        (out, f"""SELECT window_id, scheme, mask, any_value(n_sleeves) AS n_sleeves, count(net) AS n_months, avg(net) * 12 AS ann_return_net, stddev_samp(net) * sqrt(12.0) AS ann_vol,
 CASE WHEN count(net) >= 2 THEN coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12.0), 0.0) ELSE 0.0 END AS sharpe_net, avg(gross) * 12 AS ann_return_gross,
 avg(turnover) * 12 AS ann_turnover, min(dd) AS max_drawdown,
 coalesce(covar_samp(net, eq_ref) / nullif(stddev_samp(net) * stddev_samp(eq_ref), 0), 0.0) AS corr_eq, count(net) FILTER (both_down) AS n_both_down,
 coalesce(avg(net) FILTER (both_down) * 12, 0.0) AS both_down_annualized,
 coalesce(covar_samp(net, eq_ref) FILTER (both_down) / nullif(stddev_samp(net) FILTER (both_down) * stddev_samp(eq_ref) FILTER (both_down), 0), 0.0) AS corr_eq_bothdown,
 {_side('>')} AS upside_beta, {_side('<')} AS downside_beta, {_side('>')} - {_side('<')} AS updown_beta_diff,
 coalesce(CASE WHEN count(*) {DN} >= 3 THEN covar_samp(net, eq_ref) {DN} / nullif(stddev_samp(net) {DN} * stddev_samp(eq_ref) {DN}, 0) END, 0.0) AS downside_corr_eq,
 {season('GrowthUp InfUp')} AS "season_GrowthUp_InfUp", {season('GrowthUp InfDown')} AS "season_GrowthUp_InfDown",
 {season('GrowthDown InfUp')} AS "season_GrowthDown_InfUp", {season('GrowthDown InfDown')} AS "season_GrowthDown_InfDown",
 arg_max(notional, period) AS gross_notional_last FROM {out}_d GROUP BY 1, 2, 3"""),
    ]


def div_ctes(schemes: Sequence[Scheme]) -> list[CTE]:
    """``dr``: diversification ratio at the last refit with a covariance, for the covariance schemes."""
    names = {s.base: s.name for s in schemes if not s.flavor and not s.gate_mode}
    label = "CASE b.base " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    return [("lastr", "SELECT window_id, max(refit_no) AS refit_no FROM xg GROUP BY 1"),
            ("lw", f"SELECT b.window_id, {label} AS scheme, b.mask, b.i, b.b, b.refit_no FROM bw b JOIN lastr USING (window_id, refit_no) WHERE {label} IS NOT NULL"),
            ("num", "SELECT lw.window_id, scheme, mask, sum(b * v) AS wv FROM lw JOIN vol ON vol.window_id = lw.window_id AND vol.refit_no = lw.refit_no AND vol.i = lw.i GROUP BY 1, 2, 3"),
            ("den", "SELECT x.window_id, x.scheme, x.mask, sum(x.b * y.b * c.c) AS wsw FROM lw x JOIN lw y USING (window_id, scheme, mask) JOIN cv c ON c.window_id = x.window_id AND c.refit_no = x.refit_no AND c.i = x.i AND c.j = y.i GROUP BY 1, 2, 3"),
            ("dr", "SELECT window_id, scheme, mask, wv / sqrt(greatest(wsw, 1e-30)) AS div_ratio FROM num JOIN den USING (window_id, scheme, mask)"),
            ("metd", "SELECT met.*, div_ratio FROM met LEFT JOIN dr USING (window_id, scheme, mask)")]


def score_ctes(mode: str, source: str, out: str = "sco", group: str = "window_id") -> list[CTE]:
    """Adds ``resilience_score`` and ``rank`` within ``group``."""
    value = lambda t: f"CASE WHEN round({t.lstrip('-')}, 8) = 0 THEN 0.0 ELSE {'-' if t.startswith('-') else ''}round({t.lstrip('-')}, 8) END"
    terms = list(SCORES[mode].items())
    vals = ", ".join(f"{value(t)} AS v{k}" for k, (t, _) in enumerate(terms))
    ranks = ", ".join(f"CASE WHEN v{k} IS NOT NULL THEN (rank() OVER (PARTITION BY {group} ORDER BY v{k}) + (count(*) OVER (PARTITION BY {group}, v{k}) - 1) / 2.0) "
                      f"/ count(v{k}) OVER (PARTITION BY {group}) END AS p{k}" for k in range(len(terms)))
    total = " + ".join(f"{w} * p{k}" for k, (_, w) in enumerate(terms))
    return [(f"{out}_v", f"SELECT *, {vals} FROM {source}"), (f"{out}_p", f"SELECT *, {ranks} FROM {out}_v"),
            (f"{out}_s", f"SELECT *, coalesce(100 * ({total}), 0.0) AS resilience_score FROM {out}_p"),
            (out, f"SELECT *, rank() OVER (PARTITION BY {group} ORDER BY CASE WHEN round(resilience_score, 8) = 0 THEN 0.0 ELSE round(resilience_score, 8) END DESC) AS rank FROM {out}_s")]


def search_ctes(spans, schemes, mode: str, settings: TrialSettings = fx.SETTINGS, common: bool = False, win: CTE | None = None,
                also: tuple[str, str] | None = None) -> list[CTE]:
    return [*CONTEXT, *trial_ctes(spans, fx.ROSTER, schemes, settings, common, win, also=also), *metric_ctes(), *div_ctes(schemes),
            *score_ctes(mode, "metd")]


def pick(columns: Sequence[str], plain: Sequence[str] = (), digits: int = 6) -> str:
    return ", ".join([*plain, *[f'{q(c, digits)} AS "{c}"' for c in columns]])
