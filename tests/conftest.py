import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from vectide.session import local

    session = local(8, "6g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """A table of vectors from rows of numbers."""

    def make(x, start=0, **columns):
        rows = [(start + k, [float(v) for v in row], *(c[k] for c in columns.values())) for k, row in enumerate(x)]
        kinds = "".join(f", {name} long" for name in columns)
        return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{kinds}")

    return make
