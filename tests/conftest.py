import pytest
from pyspark.sql import SparkSession

from relquery.session import Session


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def db(spark):
    """Three people; scores of the first alone; scores by category; a profile each."""
    make = spark.createDataFrame
    people = [(1, "Alice", "alice@example.com", "A"), (2, "Bob", "bob@example.com", "B"), (3, "Charlie", "charlie@example.com", "A")]
    return Session(
        spark,
        {
            "people": make(people, "id long, name string, email string, category string").coalesce(1),
            "scores": make([(1, 1, 10), (2, 1, 50), (3, 1, 30)], "id long, person_id long, value long").coalesce(1),
            "category_scores": make([(1, 1, "A", 100), (2, 1, "A", 50), (3, 1, "B", 999)], "id long, person_id long, category string, value long").coalesce(1),
            "profiles": make([(1, 1, 10), (2, 2, 30), (3, 3, 20)], "id long, person_id long, rank long").coalesce(1),
        },
    )
