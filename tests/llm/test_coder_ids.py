"""Round trips at the edges of the coder's tables: few and very many distinct ids, one id alone, repeats without end."""

import numpy as np
import pytest

from ledgerkit.llm import range_coder
from ledgerkit.llm.range_coder import MOST_IDS, decode_segment, encode_segment

R = np.random.default_rng(9)
CASES = {
    "one": np.array([65534]),
    "same": np.full(300_001, 7),
    "every id": R.permutation(MOST_IDS),
    "8192 ids": np.r_[np.arange(8192), R.integers(0, 8192, 100_000)],
    "8193 ids": np.r_[np.arange(8193), R.integers(0, 8193, 100_000)],
    "repeats": np.tile(R.integers(0, 50_000, 60), 3000),
}


@pytest.mark.parametrize("name", CASES)
def test_ids_come_back(name):
    ids = CASES[name]
    data = encode_segment([1], [len(ids)], ids)
    assert (decode_segment(data)[2] == ids).all()
    if name in ("same", "repeats"):
        assert len(data) < len(ids) / 2


def test_damage_stays_in_its_block():
    ids = np.minimum(R.zipf(1.3, 9 * 500 + 123), 3000)
    table = range_coder._Table.fitted(ids)
    words, counts = range_coder._encode_blocks(ids, 500, table)
    lengths = range_coder._lengths(len(ids), 500)
    for block in (0, 4, 9):
        bad = words.copy()
        bad[counts[:block].sum() + counts[block] // 2] ^= 0xFFFF
        wrong = np.flatnonzero(range_coder._decode_blocks(bad, counts, lengths, table) != ids) // 500
        assert set(wrong) == {block}
