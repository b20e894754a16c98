"""The earliest of near lines stays, in whatever order a task reads them."""

import numpy as np
import pandas as pd
import pyarrow as pa

from barline.llm import lines


def test_rows_read_out_of_order():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 1 << 62, 9, dtype=np.uint64)
    rows = []
    for place in (7, 2, 9, 4):
        one = words.copy()
        one[5] = place
        rows.append((place, one.tobytes()))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], names=["place", "words"]) for part in (rows[:2], rows[2:])]
    for flush in (500_000, 18, 1):
        frames = [b.to_pandas() for b in lines._variants(4, flush)(iter(batches))]
        by = sorted((tuple(r) for f in frames for r in f.itertuples(index=False)), key=lambda r: r[0])
        pairs = pd.concat(lines._meet(4)(iter([pd.DataFrame(by, columns=["bucket", "keys", "places", "kinds"])])))
        assert (pairs["partner"] < pairs["place"]).all()
        assert set(pairs["place"]) == {4, 7, 9}  # 2, the earliest, is near to no earlier one
