"""The grids of all lines: every supplier and every line counts, also where one supplier has most of them."""
import numpy as np
import pandas as pd
import pytest

from meshloom.queries import QUERIES


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    rng = np.random.default_rng(3)
    supplier = np.repeat([2, 77, 900], [130, 1203, 40])
    n = len(supplier)
    f = pd.DataFrame({"l_orderkey": rng.permutation(n), "l_partkey": 1, "l_suppkey": supplier, "l_linenumber": 1, "l_quantity": rng.integers(1, 51, n).astype(float), "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100})
    folder = tmp_path_factory.mktemp("lines")
    f.to_parquet(folder / "lineitem.parquet")
    f = f.sort_values(["l_suppkey", "l_orderkey"])
    i = f.groupby("l_suppkey").cumcount()
    return str(folder), f.assign(part=i // 500, ix=i % 10, iy=i // 10 % 10, iz=i // 100 % 5)


def test_every_line_of_every_supplier_is_a_cell(spark, lines):
    folder, f = lines
    got = QUERIES["vorticity_all"](spark, folder).toPandas()
    assert got.groupby(["case_id", "part"]).size().to_dict() == f.groupby(["l_suppkey", "part"]).size().to_dict()
    assert not got.duplicated(["case_id", "part", "ix", "iy", "iz"]).any()
    heights = QUERIES["mean_building_height_all"](spark, folder).toPandas()
    low = f[(f.iz == 0) & (f.l_quantity <= 20)]
    assert heights.set_index(["case_id", "part"]).n_columns.to_dict() == low.groupby(["l_suppkey", "part"]).size().to_dict()


def test_wall_distance_of_every_fluid_cell(spark, lines):
    folder, f = lines
    got = QUERIES["voxel_points_all"](spark, folder).toPandas().set_index(["case_id", "part", "ix", "iy", "iz"]).wall_dist
    want = {}
    for (case, part), g in f.groupby(["l_suppkey", "part"]):
        at = g[["ix", "iy", "iz"]].to_numpy() * 0.5
        fluid = (g.l_quantity > 20).to_numpy()
        for a, k in zip(at[fluid], g[["ix", "iy", "iz"]].to_numpy()[fluid]):
            d = min(np.sqrt(((at[~fluid] - a) ** 2).sum(1)).min(), a[2] + 0.5)
            want[case, part, *map(int, k)] = max(d - 0.25, 0) / 2
    assert len(got) == len(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
