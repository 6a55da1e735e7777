"""Sources: round trips through files, and what must be refused."""

import json
import os
import pickle

import numpy as np
import pytest

from fadeline.sources import cells, results

V = [3.0, 3.1, 3.2, 3.3, 3.4, 3.5]


def cell(n=6, **more):
    return {"cycle_data": [{"cycle_number": k + 1, "voltage_in_V": np.array(V), "current_in_A": V[::-1], "discharge_capacity_in_Ah": [x * (1 - 0.01 * k) for x in V]} for k in range(n)], **more}


def test_pickles_round_trip(spark, tmp_path):
    for name, data in (("MATR_b1c1.pkl", cell(cell_id="one")), ("sub/CALB_0-1.pkl", cell(3, nominal_capacity_in_Ah=4.0)), ("MATR_empty.pkl", {})):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(pickle.dumps(data))
    files = cells.find_files(spark, str(tmp_path))
    assert [r.name for r in files.collect()] == ["MATR_b1c1.pkl", "MATR_empty.pkl", "CALB_0-1.pkl"]
    assert [r.name for r in cells.chosen_files(files, "MATR", "empty").collect()] == ["MATR_b1c1.pkl"]
    own, others = cells.split_by_prefix(files, "MATR")
    assert own.count() == 2 and others.count() == 1
    table = cells.import_pickles(spark, str(tmp_path))
    got = {r.file: r for r in table.collect()}
    assert got["MATR_b1c1.pkl"].cell_id == "one" and got["CALB_0-1.pkl"].cell_id == "CALB_0-1" and got["CALB_0-1.pkl"].nominal_capacity_in_Ah == 4.0 and got["MATR_empty.pkl"].cycle_data == []
    cells.write_cells(table, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out"))[:1] == ["._SUCCESS.crc"] or "dataset=MATR" in os.listdir(tmp_path / "out")
    assert cells.read_cells(spark, str(tmp_path / "out")).count() == 3
    records = {r.file: r for r in cells.fixed_origin_records(table, 2, [1, 4, 9], 4).collect()}
    used = records["MATR_b1c1.pkl"]
    assert used.status == "used" and sorted(used.targets) == [1, 4] and used.n_features == 2
    assert records["MATR_empty.pkl"].status == "skipped" and "no label at cycle 2" in records["MATR_empty.pkl"].reason
    assert {r.horizon: r.n for r in cells.manifest_counts(cells.fixed_origin_records(table, 2, [1, 4], 4)).collect()} == {1: 2, 4: 1}


class Harm:
    def __reduce__(self):
        return os.system, ("true",)


def test_pickles_with_code_are_refused():
    with pytest.raises(pickle.UnpicklingError):
        cells.read_plain(pickle.dumps({"cycle_data": Harm()}))
    with pytest.raises(pickle.UnpicklingError):
        cells.read_plain(pickle.dumps([1]))


def test_metric_discovery(spark, tmp_path):
    for run, models in (("a", ("cpmlp", "persistence")), ("b", ("cpmlp",)), ("skip", ("cpmlp",))):
        folder = tmp_path / run
        folder.mkdir()
        lines = ["model,val_RMSE,val_MAE,val_MAPE_percent,val_R2,val_EOL_Error_cycles,RMSE,MAE,MAPE_percent,R2,EOL_Error_cycles"] + [f"{m},1,1,1,1,1,0.5,0.25,1,1,1" for m in models]
        (folder / results.METRIC_FILE).write_text("\n".join(lines) + "\n")
    (tmp_path / "a" / results.SIDECAR).write_text(json.dumps({"split_mode": "file-level", "horizon": 10}, indent=2))
    (tmp_path / "manifest.json").write_text(json.dumps([{"file": "x.pkl", "dataset": "MATR"}], indent=2))
    (tmp_path / "broken.json").write_text("{")
    rows = results.find_metrics(spark, [str(tmp_path)], exclude=f"{tmp_path}/skip")
    assert sorted((r.folder.rpartition("/")[2], r.model, r.RMSE) for r in rows.collect()) == [("a", "cpmlp", 0.5), ("a", "persistence", 0.5), ("b", "cpmlp", 0.5)]
    info = results.sidecars(spark, [str(tmp_path)], "split_mode string, horizon int")
    joined = {r.folder.rpartition("/")[2]: r.info for r in results.with_sidecars(rows, info).collect()}
    assert joined["a"].horizon == 10 and joined["b"] is None
    assert [tuple(r) for r in results.read_manifest(spark, str(tmp_path / "manifest.json")).collect()] == [("x.pkl", "MATR")]
    assert results.read_manifest(spark, str(tmp_path / "broken.json")).collect() == []
    done = results.completed(rows, ["folder"], ["cpmlp", "persistence"]).collect()
    assert [r.folder.rpartition("/")[2] for r in done] == ["a"]
    metric_file = str(tmp_path / "a" / results.METRIC_FILE)
    assert results.csv_columns(spark, metric_file)[0] == "model" and results.keyed_strings(spark, metric_file)["cpmlp"]["RMSE"] == "0.5"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "cpmlp_predictions.csv").write_text("sample_id,pred\n1,0.5\n")
    assert results.predictions(spark, f"{tmp_path}/p/*.csv").collect()[0].model == "cpmlp"
    assert results.keep_last(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, n int, v string"), "k", "n").collect()[0].v == "b"
