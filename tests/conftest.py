import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lehrplan.session import local_session
    return local_session(8, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def scores(spark):
    """Four classes of six samples with measures of different scale, spread and sign."""
    draw = np.random.default_rng(271828)
    n = 24
    measures = {"edge-density": draw.beta(2, 5, n), "color-variance": draw.gamma(3, 40, n),
                "object-count": draw.exponential(12, n), "wavelet-energy": draw.normal(-4, 9, n)}
    frame = np.column_stack(list(measures.values()))
    rows = [(i, "wxyz"[i // 6], *map(float, frame[i])) for i in range(n)]
    return table(spark, rows, ["index", "class", *measures])


def table(spark, rows, names):
    kinds = {"index": "long", "class": "string"}
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds.get(n, 'double')}"
                                                 for n in names))


def ranking(df):
    """Indices in rank order."""
    return [r["index"] for r in sorted(df.collect(), key=lambda r: r["position"])]
