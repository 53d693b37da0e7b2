"""Processors whose models or auxiliary data aren't public parts of this engine: a place to plug a model in, and a clear error.

``apply_model`` runs any function of a batch of band columns on the executors,
so a coefficient file or a network that a user has can be used at scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: name -> what it needs
NEEDS = {
    "stamps_export": "an external time-series tool", "eap_phase_correction": "antenna pattern files", "smac_op": "atmospheric coefficient files",
    "aatsr_sst": "sea surface temperature coefficient files", "c2rcc_msi": "trained networks", "c2rcc_olci": "trained networks", "biophysical": "trained networks", "cloud_prob": "trained networks",
    "sm_dielectric_modeling": "soil maps and inversion tables", "wind_field_estimation": "a geophysical model function",
}


def apply_model(df: DataFrame, bands: Sequence[str], model: Callable[[pd.DataFrame], pd.Series], out: str) -> DataFrame:
    """``out`` (double) from a function of the bands of a batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: model(pdf[list(bands)]).astype(float)})

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*(f for f in df.schema if f.name != out), T.StructField(out, T.DoubleType())]))


def processor(name: str, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> Callable[[DataFrame, Sequence[str], str], DataFrame]:
    """A named processor with a user's model; without one the error says what is needed."""
    if name not in NEEDS:
        raise ValueError(f"no such processor: {name}")
    if model is None:
        raise NotImplementedError(f"{name} needs {NEEDS[name]}; give a model to run it")
    return lambda df, bands, out: apply_model(df, bands, model, out)
