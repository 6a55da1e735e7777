"""What must not grow with the table: cells held as Python objects."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from fadeline.schemas import CELL_FILE
from fadeline.sources import cellsource


def curves(n, points):
    return [{"cycle_number": k, **{c: [float(k)] * points for c in cellsource.CURVES}} for k in range(n)]


def test_a_writer_holds_one_cell_of_its_batch_as_objects(tmp_path):
    rows = [{"file": f"c{k}.pkl", "cell_id": None, "nominal_capacity_in_Ah": 1.0 if k else None, "cycle_data": curves(40, 6)} for k in range(600)]
    rows[1]["cycle_data"] = None
    rows[2]["cycle_data"] = [{"cycle_number": None, "voltage_in_V": None, "current_in_A": [], "discharge_capacity_in_Ah": [1.0, None]}]
    batch = pa.RecordBatch.from_pylist(rows, to_arrow_schema(CELL_FILE))
    del rows
    tracemalloc.start()
    try:
        assert cellsource.CellWriter({"path": str(tmp_path)}).write(iter([batch])).files == 600
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 << 20  # all cells at once take over 30 MB
    read = lambda k: pickle.loads((tmp_path / f"c{k}.pkl").read_bytes())
    assert read(0).keys() == {"cycle_data"} and read(1) == {"nominal_capacity_in_Ah": 1.0, "cycle_data": []}
    assert [c["cycle_number"] for c in read(599)["cycle_data"]] == list(range(40)) and read(599)["cycle_data"][7]["current_in_A"].tolist() == [7.0] * 6
    odd = read(2)["cycle_data"][0]
    assert odd.keys() == {"current_in_A", "discharge_capacity_in_Ah"} and odd["current_in_A"].dtype == np.float32 and len(odd["current_in_A"]) == 0 and np.isnan(odd["discharge_capacity_in_Ah"][1])


def test_a_reader_counts_the_bytes_of_a_batch(tmp_path):
    batch = pa.RecordBatch.from_pylist([{"file": f"c{k}.pkl", "cycle_data": curves(4, 25_000 if k % 4 else 200_000)} for k in range(8)], to_arrow_schema(CELL_FILE))
    cellsource.CellWriter({"path": str(tmp_path)}).write(iter([batch]))
    reader = cellsource.CellReader({"path": str(tmp_path)})
    size = {f.name: f.stat().st_size for f in tmp_path.iterdir()}
    got = [b.column("file").to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert sum(got, []) == [f"c{k}.pkl" for k in range(8)]
    assert all(len(b) == 1 or sum(size[f] for f in b) <= cellsource.BATCH_BYTES for b in got)
