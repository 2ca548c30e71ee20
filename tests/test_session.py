from types import SimpleNamespace

import pytest
from helpers import rows

from panelspark import session


def fake(master, setting=None):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=master))


def test_work_dir():
    assert session.work_dir(fake("spark://host:7077", "s3a://shared/stages/")) == "s3a://shared/stages"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(fake("local-cluster[2,1,1024]"))
    local = SimpleNamespace(get=lambda key, default=None: "file:/warehouse" if key == "spark.sql.warehouse.dir" else default)
    for master in ("local", "local[2]"):
        assert session.work_dir(SimpleNamespace(conf=local, sparkContext=SimpleNamespace(master=master))) == "file:/warehouse/panelspark-stages"


def test_settle(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) AS nothing")
    staged = session.settle(df, "numbers")
    assert rows(staged) == rows(df)
    assert f"{session.work_dir(spark)}/numbers-" in staged.inputFiles()[0]
