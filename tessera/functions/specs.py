"""The formula operators: arity, parameters with defaults and ranges, and what kind of plan stage each needs."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Kinds of stages. elem: a projection; time: a window over an asset's bars; cross: a window over a bar's assets; cum: a
#: running window; rec: a recurrence, computed for many assets at once in a grouped map.
ELEM, TIME, CROSS, CUM, REC = "elem", "time", "cross", "cum", "rec"


@dataclass(frozen=True)
class Spec:
    name: str
    arity: int
    kind: str
    category: str
    params: tuple[tuple[str, float, float, float], ...] = ()  # name, default, least, most
    alias_of: str | None = None

    @property
    def defaults(self) -> dict[str, float]:
        return {p[0]: p[1] for p in self.params}


def _window(default: float, least: float = 2, most: float = 250) -> tuple[tuple[str, float, float, float], ...]:
    return (("window", default, least, most),)


def _specs() -> dict[str, Spec]:
    out: dict[str, Spec] = {}

    def add(category: str, kind: str, arity: int, names: str, params: tuple = (), **aliases: str) -> None:
        for n in names.split():
            out[n] = Spec(n, arity, kind, category, params)
        for a, n in aliases.items():
            out[a] = Spec(a, arity, kind, category, params, n)

    exponent = (("exponent", 2.0, 0.0, 10.0),)
    add("arithmetic", ELEM, 2, "Add Sub Mul Div Pow Max Min", Max2="Max", Min2="Min")
    add("arithmetic", ELEM, 1, "Neg Abs Sign Log Sqrt Square Exp Tanh Inv")
    add("arithmetic", ELEM, 1, "SignedPower Power", exponent)
    add("arithmetic", ELEM, 1, "Clip", (("lower", -3.0, -10.0, 10.0), ("upper", 3.0, -10.0, 10.0)))
    add("statistical", TIME, 1, "Mean Std Var Median Sum Prod TsMax TsMin TsArgMax TsArgMin TsRank CountNaN CountNotNaN", _window(10), Med="Median", Product="Prod")
    add("statistical", TIME, 1, "Skew Kurt", _window(20))
    add("statistical", TIME, 1, "Quantile", (*_window(10), ("q", 0.5, 0.0, 1.0)))
    add("timeseries", TIME, 1, "Delta Delay Return LogReturn", _window(1, 1, 60))
    add("timeseries", TIME, 2, "Corr Cov Beta Resid", _window(10))
    add("timeseries", TIME, 1, "WMA Decay", _window(10), TsDecay="Decay")
    add("timeseries", CUM, 1, "CumSum CumProd CumMax CumMin")
    add("smoothing", REC, 1, "EMA DEMA KAMA", _window(10))
    add("smoothing", TIME, 1, "SMA HMA", _window(10))
    add("cross_sectional", CROSS, 1, "CsRank CsZScore CsDemean CsScale", Scale="CsScale", CsNeutralize="CsDemean")
    add("cross_sectional", CROSS, 1, "CsQuantile", (("n_bins", 5.0, 2.0, 20.0),))
    add("regression", TIME, 1, "TsLinReg TsLinRegSlope TsLinRegIntercept TsLinRegResid Rsquare", _window(20), Slope="TsLinRegSlope", Resi="TsLinRegResid")
    add("logical", ELEM, 3, "IfElse")
    add("logical", ELEM, 2, "Greater GreaterEqual Less LessEqual Equal Ne And Or", Eq="Equal")
    add("logical", ELEM, 1, "Not")
    return out


SPECS: dict[str, Spec] = _specs()
#: Operators whose array-kernel semantics differ from the tree's; mode="kernel" selects them.
KERNEL_DIFFERS = frozenset(
    "Div Inv Pow Max Min Max2 Min2 Skew Kurt Sum Prod Product TsRank Return LogReturn Corr Beta WMA Decay TsDecay CumMax CumMin EMA DEMA SMA KAMA HMA "
    "CsRank CsZScore CsScale Scale CsQuantile IfElse Greater GreaterEqual Less LessEqual Equal Eq Ne And Or Not".split()
)


@dataclass
class Registry:
    """Built-in operators and a session's own: functions of columns that take the place of a built-in's emitter."""

    own: dict[str, tuple[Spec, object]] = field(default_factory=dict)

    def register(self, name: str, arity: int, function, params: tuple = ()) -> Spec:
        """``function(*columns, **params) -> Column``; it then parses and runs in formulas like any other."""
        if name in SPECS:
            raise ValueError(f"{name} is built in")
        spec = Spec(name, arity, ELEM, "custom", params)
        self.own[name] = (spec, function)
        return spec

    def spec(self, name: str) -> Spec | None:
        return SPECS.get(name) or (self.own[name][0] if name in self.own else None)

    def names(self) -> list[str]:
        return sorted({*SPECS, *self.own})
