"""What workers keep between tasks goes when a task of another stage begins, and comes back when it is asked for."""

import pyarrow as pa

from ledgerkit.llm import tokens, words


def batches():
    yield pa.RecordBatch.from_pydict({"k": [1, 2], "text": ["one two", None]})


def test_tables_go_and_come_back():
    before = tokens.encoder().ids(["one two three"])
    assert tokens._encoders
    assert sum(b.num_rows for b in words.chunks(batches(), 1, keep=True)) == 2 and tokens._encoders
    assert sum(b.num_rows for b in words.chunks(batches(), 1)) == 2 and not tokens._encoders
    assert tokens.encoder().ids(["one two three"]) == before
