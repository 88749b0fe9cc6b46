"""Manifest jobs fail closed; samples are whole and keyed; the command line lists the queries."""
import pytest
from pyspark.sql import functions as F

from meshloom.__main__ import main
from meshloom.operators import etl, samples

from .test_operators import cube


def test_backfill_is_all_or_nothing(spark):
    m = spark.createDataFrame([(1, 10.0, 2.0), (2, 10.0, 2.0), (3, 5.0, 2.0)], "case_id int, u_ref double, l_ref double")
    p = spark.createDataFrame([(1, 10.0, 1e-5), (3, 5.1, 1e-5)], "case_id int, u double, nu double")
    filled = etl.backfill_reynolds(m, p)
    assert abs(filled.where("case_id = 1").first().log10_re - 6.30103) < 1e-5
    with pytest.raises(etl.BackfillError) as e:
        etl.require_complete(filled)
    assert "no parameters: 1, first 2" in str(e.value) and "velocity differs: 1, first 3" in str(e.value)
    assert etl.require_complete(filled.where("case_id = 1")).columns == ["case_id", "u_ref", "l_ref", "log10_re"]


def test_sample_is_whole_and_keyed(spark):
    p = cube(spark, 120, 2)
    spec = samples.SampleSpec(n_context=40, n_tokens=(5, 3), k=4, n_query=60)
    a = samples.sample(p, spec, 1)
    ctx = a["context"].toPandas()
    assert ctx.groupby("case_id").size().to_dict() == {0: 40, 1: 40} and not ctx.duplicated(["case_id", "point_id"]).any()
    q = a["queries"].join(a["context"].where("masked"), ["case_id", "point_id"], "left_anti")
    assert q.count() == 0 and a["queries"].count() == 120
    again = samples.sample(p.orderBy(F.rand(3)), spec, 1)["queries"].orderBy("case_id", "slot").collect()
    assert again == a["queries"].orderBy("case_id", "slot").collect()
    assert a["tokens"].where("ref_id is null").count() == 0


def test_command_line(capsys):
    assert main(["list"]) == 0 and "rel_l2_by_case" in capsys.readouterr().out
