"""The transition functions of the batch operators over streams, with their state kept as JSON."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirlog.operators.stateful import fold
from weirlog.operators.transitions import Machine
from weirlog.shipping import ship


def plain(row: dict) -> dict:
    """A row of a pandas frame with its nulls and numbers as Python has them."""
    out = {}
    for k, v in row.items():
        v = v.item() if hasattr(v, "item") else v
        out[k] = None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v
    return out


def run(rows: DataFrame, machine: Machine, key: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """Outputs for each key's rows, in order within a micro-batch and across batches. Whole doubles become integers."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*key, *carry]), machine.output])
    names = [*key, *carry, *(part.split()[0] for part in machine.output.split(", "))]

    def work(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else copy.deepcopy(machine.start)
        batch = [plain(r) for f in frames for r in f.to_dict("records")]
        batch.sort(key=lambda r: tuple(r[c] for c in order))
        now, out = fold(machine, batch, now)
        state.update((json.dumps(now),))
        yield pd.DataFrame([{**{c: r[c] for c in [*key, *carry]}, **e} for r, e in out], columns=names)

    return rows.groupBy(*key).applyInPandasWithState(work, schema, "state string", "append", GroupStateTimeout.NoTimeout)
