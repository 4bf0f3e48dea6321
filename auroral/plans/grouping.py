"""Interaction constraints: which features a tree model may combine, as the text of a list of index lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

#: Base parameters and state features, by physics.
PHYSICS = {
    "magnetic_field": ["BZ, nT (GSM)", "Scalar B, nT", "BX, nT (GSE, GSM)", "BY, nT (GSM)", "Vector B Magnitude,nT"],
    "plasma_bulk": ["SW Plasma Speed, km/s", "SW Proton Density, N/cm^3", "SW Plasma Temperature, K", "Plasma Beta"],
    "electromagnetic": ["E elecrtric field", "Flow pressure"],
    "composition": ["Alpha/Prot. ratio"],
    "flow_geometry": ["SW Plasma flow long. angle", "SW Plasma flow lat. angle"],
    "magnetic_geometry": ["Lat. Angle of B (GSE)", "Long. Angle of B (GSE)"],
    "mach_numbers": ["Alfen mach number", "Magnetosonic Much num."],
    "solar_activity": ["Lyman_alpha", "R (Sunspot No.)"],
    "temporal": ["YEAR", "DOY", "Hour"],
    "magnetospheric_state": ["energy_loading_state", "beta_regime_state", "magnetotail_loading_state", "coupling_efficiency_state", "circulation_state", "temporal_coherence_state", "recovery_state"],
}
#: Processes of the magnetosphere.
MAGNETOSPHERIC = {
    "energy_budget": ["energy_loading_state", "coupling_efficiency_state"],
    "plasma_regime": ["beta_regime_state", "circulation_state"],
    "temporal_dynamics": ["magnetotail_loading_state", "temporal_coherence_state"],
    "historical_context": ["recovery_state"],
    "magnetic_coupling": ["BZ, nT (GSM)", "Scalar B, nT", "BY, nT (GSM)", "energy_loading_state", "coupling_efficiency_state", "magnetotail_loading_state"],
    "plasma_coupling": ["SW Plasma Speed, km/s", "SW Proton Density, N/cm^3", "SW Plasma Temperature, K", "Plasma Beta", "Flow pressure", "beta_regime_state", "circulation_state", "temporal_coherence_state"],
}
#: Marks that feature engineering leaves in names.
ENGINEERING = {
    "topological": ["_jump_mag", "_path_eff", "_turn_var"],
    "signal_processing": ["_max_jump", "_jump_conc", "_trend_str"],
    "convolution": ["conv_"],
    "lag_history": ["_lag_"],
    "rolling_stats": ["_std_", "_rolling_median_", "_cdf_wass_trend_"],
}
#: The two domains that the hybrid strategy crosses with the states.
HYBRID = {
    "magnetic": ["BZ, nT (GSM)", "Scalar B, nT", "BX, nT (GSE, GSM)", "BY, nT (GSM)", "Vector B Magnitude,nT", "E elecrtric field"],
    "plasma": ["SW Plasma Speed, km/s", "SW Proton Density, N/cm^3", "SW Plasma Temperature, K", "Plasma Beta", "Flow pressure", "Alpha/Prot. ratio"],
}
#: Base parameters, each a group of its own.
PARAMETERS = [
    "BZ, nT (GSM)", "Scalar B, nT", "BX, nT (GSE, GSM)", "BY, nT (GSM)", "Vector B Magnitude,nT", "SW Plasma Speed, km/s", "SW Proton Density, N/cm^3", "SW Plasma Temperature, K",
    "Plasma Beta", "E elecrtric field", "Flow pressure", "Alpha/Prot. ratio", "SW Plasma flow long. angle", "SW Plasma flow lat. angle", "Lat. Angle of B (GSE)", "Long. Angle of B (GSE)",
    "Alfen mach number", "Magnetosonic Much num.", "Lyman_alpha", "R (Sunspot No.)", "YEAR", "DOY", "Hour",
]
STATES = PHYSICS["magnetospheric_state"]


def _has(feature: str, part: str) -> bool:
    """Names may have lost their dots, as Spark reads those as paths."""
    return part in feature or part.replace(".", "") in feature


def _containing(features: Sequence[str], part: str) -> list[int]:
    return [i for i, f in enumerate(features) if _has(f, part)]


def _by_parts(features: Sequence[str], groups: Iterable[Sequence[str]]) -> list[list[int]]:
    """A feature is listed once for each part that it contains, part by part."""
    return [[i for part in parts for i in _containing(features, part)] for parts in groups]


def _by_any(features: Sequence[str], parts: Sequence[str]) -> list[int]:
    return [i for i, f in enumerate(features) if any(_has(f, p) for p in parts)]


def _engineering(features: Sequence[str]) -> list[list[int]]:
    states = [i for i, f in enumerate(features) if f in STATES]
    derived = {i for parts in ENGINEERING.values() for i in _by_any(features, parts)} | set(states)
    raw = [i for i in range(len(features)) if i not in derived]
    return [group + raw for group in [*(_by_any(features, parts) for parts in ENGINEERING.values()), states] if len(group) > 1]


def _hybrid(features: Sequence[str]) -> list[list[int]]:
    magnetic, plasma = _by_any(features, HYBRID["magnetic"]), _by_any(features, HYBRID["plasma"])
    states = [i for i, f in enumerate(features) if f in STATES]
    crossed = [group + states for group in (magnetic, plasma) if group and states]
    return [magnetic, plasma, states, *crossed]


STRATEGIES = {
    "physics": lambda f: _by_parts(f, PHYSICS.values()),
    "magnetospheric": lambda f: _by_parts(f, MAGNETOSPHERIC.values()),
    "engineering": _engineering,
    "hybrid": _hybrid,
    "parameter_only": lambda f: _by_parts(f, [(p,) for p in (*PARAMETERS, *STATES)]),
}


def interaction_constraints(features: Sequence[str], strategy: str = "physics") -> str | None:
    """Groups of more than one feature, as text; None without any. ValueError for an unknown strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    groups = [g for g in STRATEGIES[strategy](features) if len(g) > 1]
    return str(groups) if groups else None


def all_constraints(features: Sequence[str]) -> dict[str, str | None]:
    return {name: interaction_constraints(features, name) for name in STRATEGIES}
