"""Feature table to segments, validation table, profile and alerts, one setting per population."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tamiz.operators import cluster, validate, wards
from tamiz.operators.profile import alert_thresholds, cluster_profile
from tamiz.operators.reduce import Components, pca_fit, pca_scores
from tamiz.operators.transform import boxcox_apply, boxcox_fit
from tamiz.plans import associates, populations
from tamiz.session import cut_lineage


@dataclass(frozen=True)
class Model:
    """What one population is clustered on, and how."""

    binary: tuple[str, ...]
    continuous: tuple[str, ...]
    components: int
    method: str
    k: int
    micro: bool

    @property
    def columns(self) -> tuple[str, ...]:
        return self.binary + self.continuous


_FLAGS = (*populations.INDUSTRY_FLAGS, *populations.STATE_FLAGS)
_MERGED = (*populations.BALANCE, "num_transa", *[c for c in populations.FLOW_COLUMNS if not c.startswith("CDT_")])


# Tier flows that are not modelled.
_NOT_MODELLED = ("jurisdiccion_0_Ingreso", "jurisdiccion_3_Egreso", "jurisdiccion_3_Ingreso", "jurisdiccion_6_Ingreso")
_CLIENT_COLUMNS = tuple(c for c in _MERGED if c not in _NOT_MODELLED)

# Columns, components, method and number of segments of each population.
MODELS = {
    "departments": Model((), ("rate22", "rate23", "rate24"), 2, "hierarchical", 5, False),
    "associates": Model(
        tuple(associates.SHORT_NAMES.values()), associates.CONTINUOUS, 10, "hierarchical", 5, False
    ),
    "persona_natural": Model(_FLAGS, _CLIENT_COLUMNS, 13, "hierarchical", 6, True),
    "persona_juridica": Model(_FLAGS, _CLIENT_COLUMNS, 14, "hierarchical", 6, False),
    "bajo_monto": Model(
        (), ("num_transa", "Ahorro_Egreso", "Ahorro_Ingreso", "Virtual_Egreso", "Virtual_Ingreso"), 2, "clara", 4, True
    ),
}


@dataclass(frozen=True)
class Reduced:
    """Scores of every client and what produced them."""

    scores: DataFrame
    exponents: DataFrame
    components: Components


def reduce_features(features: DataFrame, id_col: str, model: Model) -> Reduced:
    """Box-Cox on the continuous columns, then standardised components of all columns."""
    known = features.select(id_col, *model.columns)
    exponents = boxcox_fit(known, model.continuous)
    transformed = boxcox_apply(known, exponents)
    fit = pca_fit(transformed, model.columns, model.components)
    return Reduced(pca_scores(transformed, fit, [id_col]), exponents, fit)


def cluster_centres(centres: DataFrame, method: str, k: int) -> DataFrame:
    """``center_id, cluster`` by the chosen method."""
    if method == "hierarchical":
        return cluster.ward(centres, "center_id", "center", k)
    if method == "kmeans":
        return cluster.kmeans(centres, "center_id", "center", k)
    if method == "pam":
        return cluster.pam(centres, "center_id", "center", k)[0]
    if method == "clara":
        return cluster.clara(centres, "center_id", "center", k)[0].select("center_id", "cluster")
    raise ValueError(f"unknown method {method}")


def segment_scores(scores: DataFrame, id_col: str, model: Model, micro_k: int = 3000, starts: int = 25) -> DataFrame:
    """``id, cluster`` of every row: by the centres of a compressed population, else by Ward's tree of all rows."""
    if model.micro:
        centres, assigned = cluster.micro_cluster(scores, id_col, k=micro_k, starts=starts)
        return cluster.inherit_labels(assigned, cluster_centres(centres, model.method, model.k))
    if model.method != "hierarchical":
        raise ValueError(f"{model.method} on every row")
    return wards.ward_rows(scores, id_col, "scores", model.k)


def segment(features: DataFrame, id_col: str, model: Model, micro_k: int = 3000, starts: int = 25) -> DataFrame:
    """The feature table with a ``cluster`` for every row."""
    stored = cut_lineage(features)
    reduced = reduce_features(stored, id_col, model)
    labels = segment_scores(reduced.scores, id_col, model, micro_k, starts)
    return stored.join(labels.select(id_col, "cluster"), id_col)


def compare_methods(
    centres: DataFrame,
    methods: Sequence[str] = validate.METHODS,
    ks: Sequence[int] = validate.K_RANGE,
    replicates: int = 100,
) -> DataFrame:
    """Internal indices and bootstrap stability of every method and number of clusters."""
    labels = cut_lineage(validate.cluster_grid(centres, "center_id", "center", methods, ks))
    indices = validate.validation_grid(centres, "center_id", "center", labels)
    overlaps = validate.bootstrap_overlaps(centres, "center_id", "center", labels, methods, ks, replicates)
    stability = validate.stability_summary(validate.stability_by_cluster(overlaps))
    return validate.summary_table(indices, stability)


def segment_reports(segmented: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Profile and alert thresholds of a segmented table."""
    groups = range(1, model.k + 1)
    profile = cluster_profile(segmented, "cluster", groups, model.binary, model.continuous)
    return profile, alert_thresholds(segmented, "cluster", groups, model.continuous)


def department_levels(rates: DataFrame, years: Sequence[int] = (2022, 2023, 2024)) -> DataFrame:
    """Departments with cluster and ordinal level, from logged yearly rates."""
    from tamiz.operators.cluster import ordinal_levels
    from tamiz.plans.departments import log_rates

    model = MODELS["departments"]
    stored = cut_lineage(rates)
    logged = log_rates(stored, years)
    names = [f"rate{y % 100:02d}" for y in years]
    fit = pca_fit(logged, names, model.components)
    scores = pca_scores(logged, fit, ["departamento"])
    labels = segment_scores(scores, "departamento", model)
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0.0)))
    levelled = stored.join(labels.select("departamento", "cluster"), "departamento").withColumn(
        "mean_rate", total / len(names)
    )
    return ordinal_levels(levelled, "cluster", "mean_rate")
