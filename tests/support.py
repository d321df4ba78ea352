"""What several test modules use."""

import os

import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in order, whatever the engine's types for nulls and numbers."""

    def cell(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return str([cell(y) for y in x])
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "~"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return f"{float(x):.9g}" if isinstance(x, (int, float, np.number)) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None))
