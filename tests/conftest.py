import os
import sys
from pathlib import Path

# One thread for each process of numpy: Spark runs as many tasks as there are cores.
for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(name, "1")

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusmill.functions.identity import with_identity  # noqa: E402
from corpusmill.schema import conform  # noqa: E402
from corpusmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "2"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_corpus(spark):
    """Corpus rows from (name, description, instructions, source[, category]) in arrival order."""

    def build(rows, ordered=False):
        filled = [(i, *row, *([""] if len(row) == 4 else [])) for i, row in enumerate(rows)]
        schema = "ord long, name string, description string, instructions string, source string, category string"
        frame = with_identity(spark.createDataFrame(filled, schema))
        return conform(frame).join(frame.select("id", "ord"), "id") if ordered else conform(frame)

    return build
