"""Probability, odds and scoring as SQL expressions: each function takes and returns SQL text, so Catalyst sees plain expressions.

Values follow double arithmetic; null stays null unless a rule says otherwise. Fixed constants are those of the rules.
"""

from __future__ import annotations

EPS = "1e-9"


def clamp(x: str, low: str, high: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END)"


def clamp_probability(p: str, eps: str = EPS) -> str:
    """Missing is a half; the rest lies in [eps, 1 - eps]."""
    return f"least(greatest(coalesce({p}, 0.5e0), {eps}), 1e0 - {eps})"


def logit(p: str) -> str:
    c = clamp_probability(p)
    return f"ln({c} / (1e0 - {c}))"


def sigmoid(x: str) -> str:
    return f"(CASE WHEN {x} >= 0e0 THEN 1e0 / (1e0 + exp(-({x}))) ELSE exp({x}) / (1e0 + exp({x})) END)"


def js_round(x: str) -> str:
    """Halves go towards plus infinity."""
    return f"CAST(floor({x} + 0.5e0) AS BIGINT)"


def safe_div(a: str, b: str, otherwise: str = "NULL") -> str:
    return f"(CASE WHEN {b} = 0e0 OR {b} IS NULL THEN {otherwise} ELSE {a} / {b} END)"


def american(decimal: str) -> str:
    return f"(CASE WHEN {decimal} <= 1e0 THEN NULL WHEN {decimal} >= 2e0 THEN {js_round(f'({decimal} - 1e0) * 100e0')} ELSE {js_round(f'-100e0 / nullif({decimal} - 1e0, 0e0)')} END)"


def shrink(raw: str, n: str, prior: str, weight: str) -> str:
    return f"(({raw}) * ({n}) + ({prior}) * ({weight})) / (({n}) + ({weight}))"


def erf(x: str) -> str:
    """Abramowitz and Stegun 7.1.26; exactly 0 at 0."""
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs({x})))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    return f"(CASE WHEN {x} = 0e0 THEN 0e0 ELSE sign({x}) * (1e0 - ({poly}) * exp(-({x}) * ({x}))) END)"


def normal_cdf(z: str) -> str:
    return f"(0.5e0 * (1e0 + {erf(f'(({z}) / sqrt(2e0))')}))"


#: Coefficients of Acklam's approximation of the normal quantile.
_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0)


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"({coefficients[0]!r}e0)" if "e" not in repr(coefficients[0]) else f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}{'' if 'e' in repr(c) else 'e0'}))"
    return out


def normal_quantile(p: str) -> str:
    c = f"least(greatest({p}, 1e-12), 1e0 - 1e-12)"
    q = f"sqrt(-2e0 * ln({c}))"
    u = f"sqrt(-2e0 * ln(1e0 - {c}))"
    h = f"({c} - 0.5e0)"
    r = f"({h} * {h})"
    low = f"{_poly(_C, q)} / ({_poly(_D, q)} * {q} + 1e0)"
    high = f"-({_poly(_C, u)}) / ({_poly(_D, u)} * {u} + 1e0)"
    mid = f"({_poly(_A, r)}) * {h} / ({_poly(_B, r)} * {r} + 1e0)"
    return f"(CASE WHEN {c} < 0.02425e0 THEN {low} WHEN {c} > 1e0 - 0.02425e0 THEN {high} ELSE {mid} END)"


def kelly_fraction(p: str, d: str) -> str:
    return f"greatest(0e0, (({d}) * ({p}) - 1e0) / nullif(({d}) - 1e0, 0e0))"


def smoothstep(x: str, low: float, high: float) -> str:
    t = f"least(greatest((({x}) - {low!r}e0) / {high - low!r}e0, 0e0), 1e0)"
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def risk_level(score: str) -> str:
    return f"(CASE WHEN {score} < 0.30e0 THEN 'low' WHEN {score} < 0.52e0 THEN 'medium' WHEN {score} < 0.74e0 THEN 'high' ELSE 'extreme' END)"


def confidence_label(c: str) -> str:
    return f"(CASE WHEN {c} < 0.30e0 THEN 'very low' WHEN {c} < 0.50e0 THEN 'low' WHEN {c} < 0.75e0 THEN 'medium' WHEN {c} < 0.88e0 THEN 'high' ELSE 'very high' END)"
