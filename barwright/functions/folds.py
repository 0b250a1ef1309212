"""Order-dependent folds for latches that no window expresses."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, finish: Callable,
                schema: str) -> DataFrame:
    """Fold the rows of each key in order, streaming over sorted partitions: memory holds one batch and one key's state.

    ``step(state, row) -> output rows``; ``finish(state, key) -> output rows`` when the key ends.
    """
    columns = [f.split()[0] for f in schema.split(",")]
    names = df.columns

    def run(batches: Iterator):
        import pandas as pd
        state, current = None, None
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False, name=None):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != current:
                    if current is not None:
                        out.extend(finish(state, current))
                    state, current = start(), key
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=columns)
        if current is not None:
            yield pd.DataFrame(finish(state, current), columns=columns)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
