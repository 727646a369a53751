"""Surrogates by name."""

from __future__ import annotations

from .base import RandomSurrogate, Surrogate
from .ensembles import DropoutSurrogate, EnsembleSurrogate, MeanVarianceSurrogate, RegressorSurrogate
from .forest import ForestSurrogate
from .linear import GaussianProcessSurrogate
from .network import DropoutNetwork, EnsembleNetwork, MeanVarianceNetwork, NetworkSurrogate

CONFIDENCE = {
    None: RegressorSurrogate,
    "none": RegressorSurrogate,
    "ensemble": EnsembleSurrogate,
    "mve": MeanVarianceSurrogate,
    "twooutput": MeanVarianceSurrogate,
    "dropout": DropoutSurrogate,
}
NETWORKS = {
    None: NetworkSurrogate,
    "none": NetworkSurrogate,
    "ensemble": EnsembleNetwork,
    "mve": MeanVarianceNetwork,
    "twooutput": MeanVarianceNetwork,
    "dropout": DropoutNetwork,
}


def make_surrogate(name: str = "rf", conf_method: str | None = None, **options) -> Surrogate:
    """rf, gp, nn or network (with a confidence method), or random; nn takes Spark ML regressors, network trains a feed-forward net."""
    if name == "rf":
        return ForestSurrogate(**options)
    if name == "gp":
        return GaussianProcessSurrogate(**options)
    if name == "random":
        return RandomSurrogate(**options)
    if name in ("nn", "network"):
        if conf_method not in CONFIDENCE:
            raise ValueError(f"unknown confidence method {conf_method!r}")
        return (CONFIDENCE if name == "nn" else NETWORKS)[conf_method](**options)
    raise ValueError(f"unknown model {name!r}")
