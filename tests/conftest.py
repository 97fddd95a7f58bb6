import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")),
    }
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TINY = [(0, "a.txt", "Python async event loop. Кіт café."), (1, "b.txt", "Python java event loop. Дім."), (2, "c.txt", "Python await. Кіт кіт."), (3, "empty.txt", "")]


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.createDataFrame(TINY, "doc_id long, path string, text string")


@pytest.fixture(scope="session")
def tiny_index(tiny):
    from loomtext.operators.index import build_index

    return build_index(tiny).written()


def texts(spark, *values):
    return spark.createDataFrame([(i, f"{i}.txt", v) for i, v in enumerate(values)], "doc_id long, path string, text string")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())
