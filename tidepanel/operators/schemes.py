"""Weighting and overlay schemes as configuration rows.

A scheme is a base (how the long weights are set at each refit) and a rule that turns the
signals of a month into one coefficient per series. Nothing in a row depends on a portfolio,
so the coefficients are worked out once per (window, scheme, month, series).
"""

from __future__ import annotations

from dataclasses import dataclass

from tidepanel.operators.signals import SignalSpec


@dataclass(frozen=True)
class Scheme:
    name: str
    base: str = "ew"
    lookback: int = 12
    gate_mode: str = ""              # "", cash, short, overlay, sign
    gate_signal: str = "tsmom"
    w_overlay: float = 0.0
    w_hedge: float = 0.0
    w_hedge_bd: float = 0.0
    w_long_bd: float = 0.0
    short_name: str = ""
    w_short: float = 0.0
    infl_lookback: int = 12
    infl_confirm: str = ""
    eq_confirm_lookback: int = 3
    scale_signal: str = ""
    scale_k: float = 2.0
    scale_lookback: int = 3
    scale_floor: float = 0.3
    scale_ceil: float = 1.5
    scale_target_vol: float = 0.12
    fast: int = 3
    slow: int = 10
    fast_exit: int = 3
    slow_entry: int = 12
    dd_window: int = 6
    dd_exit: float = 0.10
    dd_entry: float = 0.03
    vol_window: int = 6
    vol_median: int = 60
    vol_hi_mult: float = 1.0
    vol_lo_mult: float = 0.85
    flavor: bool = True

    @property
    def momentum(self) -> SignalSpec:
        return SignalSpec("mom", (self.lookback,))

    @property
    def signal(self) -> SignalSpec:
        """Gate signal; an unknown name falls back to momentum."""
        specs = {
            "infl_regime": ("none", ()),
            "ma": ("ma", (self.lookback,)),
            "dma": ("dma", (self.fast, self.slow)),
            "vol": ("vol", (self.vol_window, self.vol_median)),
            "asym_ma": ("asym_ma", (self.fast_exit, self.slow_entry)),
            "dd_stop": ("dd_stop", (self.dd_window, self.dd_exit, self.dd_entry)),
            "eq_dd": ("eq_dd", (self.dd_window, self.dd_exit, self.dd_entry)),
            "asym_vol": ("asym_vol", (self.vol_window, self.vol_median, self.vol_hi_mult, self.vol_lo_mult)),
        }
        if not self.gate_mode:
            return SignalSpec("none")
        kind, params = specs.get(self.gate_signal, ("mom", (self.lookback,)))
        return SignalSpec(kind, params)

    @property
    def split_gross(self) -> bool:
        """Long base and overlay are two notionals: funding is charged on both."""
        return self.gate_mode == "overlay" and max(self.w_hedge, self.w_hedge_bd, self.w_long_bd) > 0


COVARIANCE_SCHEMES = (
    Scheme("EW", flavor=False),
    Scheme("InvVol", base="invvol", flavor=False),
    Scheme("InvVar", base="invvar", flavor=False),
    Scheme("ERC", base="erc", flavor=False),
    Scheme("MinVar", base="minvar", flavor=False),
)
MOMENTUM_SCHEME = Scheme("LS-TSMOM", gate_mode="sign", flavor=False)


def _short(name: str, signal: str = "tsmom", **knobs) -> Scheme:
    return Scheme(name, gate_mode="short", gate_signal=signal, **knobs)


def _hedge(name: str, signal: str, **knobs) -> Scheme:
    return Scheme(name, gate_mode="overlay", gate_signal=signal, **knobs)


def overlay_schemes(short_name: str) -> tuple[Scheme, ...]:
    """The 44 overlay presets. ``short_name`` is the series of the structural short."""
    return (
        Scheme("TrendGate", base="minvar", gate_mode="cash"),
        Scheme("RP-LS-Overlay", base="minvar", w_overlay=0.3),
        Scheme("StructShort", base="minvar", short_name=short_name, w_short=0.3),
        Scheme("TG-LS-Overlay", base="minvar", gate_mode="cash", w_overlay=0.2),
        _short("TG-Short", base="minvar"),
        _short("TG-Short-LS", base="minvar", w_overlay=0.2),
        _short("TG-Short-6m", base="minvar", lookback=6),
        _short("EW-Short"),
        _short("EW-Short-LS", w_overlay=0.2),
        _short("EW-Short-6m", lookback=6),
        _short("EW-MA-Short", "ma", lookback=10),
        _short("EW-Vol-Short", "vol"),
        _short("EW-DMA-Short", "dma"),
        _short("EW-AsymMA-Short", "asym_ma"),
        _short("EW-DDStop-Short", "dd_stop"),
        _short("EW-AsymMA-Short-6", "asym_ma", slow_entry=6),
        _short("EW-AsymMA-Short-9", "asym_ma", slow_entry=9),
        _short("EW-AsymMA-Tight", "asym_ma", slow_entry=6, fast_exit=2),
        _short("EW-AsymVol-Short", "asym_vol"),
        _hedge("EW-Hedge-DMA-1", "dma", w_hedge=1.0),
        _hedge("EW-Hedge-DMA", "dma", w_hedge=1.5),
        _hedge("EW-Hedge-DMA-2", "dma", w_hedge=2.0),
        _hedge("EW-Hedge-MA", "ma", w_hedge=1.5),
        _hedge("EW-Hedge-DD", "dd_stop", w_hedge=1.5),
        _hedge("EW-Hedge-Dur", "dma", w_hedge=1.5, w_hedge_bd=1.5),
        _hedge("EW-Hedge-Dur-MA", "ma", w_hedge=1.5, w_hedge_bd=1.5),
        _hedge("EW-Hedge-Dur-DD", "eq_dd", w_hedge=1.5, w_hedge_bd=1.5),
        _hedge("EW-Hedge-Dur-2", "dma", w_hedge=1.5, w_hedge_bd=2.0),
        _hedge("EW-Hedge-Dur-DD2", "eq_dd", w_hedge=1.5, w_hedge_bd=2.0),
        _hedge("EW-Infl-Dur", "infl_regime", w_hedge_bd=1.5),
        _hedge("EW-Infl-DurL", "infl_regime", w_hedge_bd=1.5, w_long_bd=1.5),
        _hedge("EW-Infl-Both", "infl_regime", w_hedge=1.5, w_hedge_bd=1.5),
        _hedge("EW-Infl-BothL", "infl_regime", w_hedge=1.5, w_hedge_bd=1.5, w_long_bd=1.5),
        _hedge("EW-Infl-DurL2", "infl_regime", w_hedge_bd=1.5, w_long_bd=2.0),
        _hedge("EW-InflC-Both", "infl_regime", w_hedge=1.5, w_hedge_bd=1.5, infl_confirm="eq_neg"),
        _hedge("EW-InflC-BothL", "infl_regime", w_hedge=1.5, w_hedge_bd=1.5, w_long_bd=1.5, infl_confirm="eq_neg"),
        _hedge("EW-InflC-Dur", "infl_regime", w_hedge_bd=1.5, infl_confirm="eq_neg"),
        _hedge("EW-InflC-DurL", "infl_regime", w_hedge_bd=1.5, w_long_bd=1.5, infl_confirm="eq_neg"),
        _hedge("EW-InflC-Both6", "infl_regime", w_hedge=1.5, w_hedge_bd=1.5, infl_confirm="eq_neg",
               eq_confirm_lookback=6),
        Scheme("EW-Scale-Mom", scale_signal="eq_mom"),
        Scheme("EW-Scale-Mom6", scale_signal="eq_mom", scale_lookback=6),
        Scheme("EW-Scale-Vol", scale_signal="eq_vol", scale_lookback=6),
        Scheme("EW-Scale-MomL", scale_signal="eq_mom", scale_k=3.0, scale_ceil=2.0),
        Scheme("EW-Scale-Infl", scale_signal="infl_regime", scale_floor=0.4, scale_ceil=1.3),
    )


def all_schemes(short_name: str) -> tuple[Scheme, ...]:
    """The 50 schemes in their fixed order."""
    return (*COVARIANCE_SCHEMES, MOMENTUM_SCHEME, *overlay_schemes(short_name))
