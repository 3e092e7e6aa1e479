"""What an id costs to code and to read back, in gathers from a table as large as a predictor's: seconds depend on the machine."""

import time

import numpy as np

from ledgerkit.llm.range_coder import BLOCK, decode_segment, encode_segment

LANES, STEPS = 2048, BLOCK


def seconds(f, times):
    took = []
    for _ in range(times):
        at = time.process_time()
        f()
        took.append(time.process_time() - at)
    return min(took)


def test_an_id_costs_few_gathers():
    r = np.random.default_rng(5)
    ids = np.minimum(r.zipf(1.3, LANES * STEPS), 4000) + r.integers(0, 2, LANES * STEPS)
    table, at = np.zeros(LANES << 8, np.int32), [(np.arange(LANES) << 8) + r.integers(0, 256, LANES) for _ in range(64)]
    gather = seconds(lambda: [table.take(at[t % 64], mode="clip") for t in range(10 * STEPS)], 3) / 10
    data = encode_segment([1], [len(ids)], ids)
    assert (decode_segment(data)[2] == ids).all()
    coded, read = seconds(lambda: encode_segment([1], [len(ids)], ids), 2), seconds(lambda: decode_segment(data), 2)
    print(f"a gather {gather:.4f} s, coding {coded:.2f} s, reading {read:.2f} s: {(coded + read) / gather:.0f} gathers")
    assert coded + read < 230 * gather  # 165 when this was written; the coder before took 303
