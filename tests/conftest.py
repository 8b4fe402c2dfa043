import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session("tests", **{
        "spark__master": "local[4]",
        "spark__sql__shuffle__partitions": "4",
        "spark__default__parallelism": "4",
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark__driver__memory": "4g",
    })
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def plan(capsys):
    """The physical plan of a DataFrame as text."""

    def explain(df, mode="simple"):
        capsys.readouterr()
        df.explain(mode)
        return capsys.readouterr().out

    return explain


def rows(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
