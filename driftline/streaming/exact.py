"""Exact streaming: one machine in the state store, so results equal the sequential program's.

All rows carry one key, as sequential rules demand; rows are put in the order of id within a micro-batch. With
`key` every key has a machine of its own, and keys run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.novelty import State, initial_state
from ..schema import OUTPUT, Params

STATE = T.StructType([T.StructField("blob", T.BinaryType())])


def detect(stream: DataFrame, model: DataFrame, p: Params, id_col: str = "id", val_col: str = "val", key: str | None = None) -> DataFrame:
    """Rows of schema.OUTPUT (with the key first, if there is one); sinks are filters on `kind`."""
    import numpy as np

    blob = initial_state(model, p).dump()

    def run(k, frames, state):
        machine = State.load(state.get[0]) if state.exists else State.load(blob)
        parts = [f for f in frames if len(f)]
        rows = []
        if parts:
            pdf = pd.concat(parts).sort_values("_id", kind="stable")
            rows = list(machine.step(np.array(pdf["_val"].tolist(), float).reshape(len(pdf), -1), pdf["_id"].to_numpy()))
        state.update((machine.dump(),))
        out = pd.DataFrame(rows, columns=[f.name for f in OUTPUT.fields])
        out["cluster_id"] = out["cluster_id"].astype("Int64")
        if key is not None:
            out.insert(0, key, k[0])
        yield out

    group = F.col(key) if key is not None else F.lit(0)
    picked = stream.select(group.alias("_g"), F.col(id_col).cast("long").alias("_id"), F.col(val_col).cast("array<double>").alias("_val"))
    schema = T.StructType([*([stream.schema[key]] if key is not None else []), *OUTPUT.fields])
    return picked.groupBy("_g").applyInPandasWithState(run, schema, STATE, "append", "NoTimeout")
