import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "newsloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def at(second: int) -> datetime:
    return datetime(2024, 1, 1, 0, second // 60, second % 60)


@pytest.fixture(scope="session")
def make_log(spark):
    """Behaviors from (impression_id, user_id, article_id, second, read_time, scroll) rows."""

    def make(rows):
        return spark.createDataFrame(
            [(i, u, a, at(s), r, p) for i, u, a, s, r, p in rows],
            "impression_id long, user_id long, article_id long, impression_time timestamp_ntz, "
            "read_time double, scroll_percentage double",
        )

    return make


def lists(df, k=None):
    """{user: [articles in rank order]}"""
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r["user_id"], r["rank"])):
        out.setdefault(row["user_id"], []).append(row["article_id"])
    return out
