import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from emberline.session import get_spark

    found = get_spark("tests", 4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def compare(spark_df, rows, columns):
    """Sorted text rows of both sides."""
    text = lambda r: tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
    return sorted(text([row[c] for c in columns]) for row in spark_df.collect()), sorted(text(r) for r in rows)
