import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderflow import session  # noqa: E402
from orderflow.operators.clean import clean as clean_rows  # noqa: E402
from orderflow.schema import DEFAULT_SCHEMA  # noqa: E402
from orderflow.session import Stage  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.build(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


# Five order lines: a loss, a break-even, a short postal code and a missing one; tests derive
# broken variants from them.
ROWS = [
    (1, "T-7001", "3/14/2015", "3/19/2015", "Standard Class", "K-31", "Ines Duarte", "Consumer",
     "70112", "New Orleans", "Louisiana", "United States", "South", "TEC-PH-1", "Technology",
     "Phones", "Slate Phone", 899.5, 1, 0.1, -45.2),
    (2, "T-7001", "3/14/2015", "3/19/2015", "Standard Class", "K-31", "Ines Duarte", "Consumer",
     "70112", "New Orleans", "Louisiana", "United States", "South", "OFF-PA-4", "Office Supplies",
     "Paper", "Lined Pad", 18.9, 3, 0.0, 0.0),
    (3, "T-7040", "10/2/2016", "10/2/2016", "Same Day", "K-08", "Otto Brandt", "Corporate",
     "2139", "Cambridge", "Massachusetts", "United States", "East", "OFF-PA-4", "Office Supplies",
     "Paper", "Lined Pad", 31.5, 5, 0.2, 6.3),
    (4, "T-7055", "1/25/2017", "1/27/2017", "First Class", "K-08", "Otto Brandt", "Corporate",
     "60614", "Chicago", "Illinois", "United States", "Central", "FUR-CH-2", "Furniture",
     "Chairs", "Desk Stool", 240.0, 2, 0.3, 12.75),
    (5, "T-7090", "5/30/2017", "6/4/2017", "Second Class", "K-77", "Pia Lund", "Home Office",
     None, "Boise", "Idaho", "United States", "West", "TEC-AC-9", "Technology",
     "Accessories", "Track Ball", 64.99, 1, 0.0, 19.5),
]


def make(spark, rows):
    return spark.createDataFrame(rows, DEFAULT_SCHEMA.struct().simpleString())


def changed(row_index, **values):
    """The five rows with some values of one row replaced."""
    names = DEFAULT_SCHEMA.names
    rows = [list(r) for r in ROWS]
    for name, value in values.items():
        rows[row_index][names.index(name)] = value
    return [tuple(r) for r in rows]


@pytest.fixture
def raw(spark):
    return make(spark, ROWS)


@pytest.fixture
def cleaned(raw):
    return clean_rows(raw)


@pytest.fixture
def stage(spark):
    stage = Stage(spark)
    yield stage
    stage.clear()
