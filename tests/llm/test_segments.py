"""A part's short rest joins the segment before it, and what is read back is the same."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerkit.llm import token_files, tokens
from ledgerkit.llm.range_coder import decode_segment


class _Part:
    def partitionId(self):
        return 0


@pytest.mark.parametrize("docs, sizes", [(0, []), (3, [30]), (10, [100]), (14, [140]), (15, [150]), (16, [100, 60]), (24, [100, 140]), (37, [100, 100, 100, 70])])
def test_rest(monkeypatch, docs, sizes):
    monkeypatch.setattr(token_files.TaskContext, "get", staticmethod(lambda: _Part()))
    texts = [" one" * 9] * docs  # nine ids and the end id
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(docs), pa.int64()), "text": pa.array(texts, pa.string())})
    got = [r for b in token_files._encode(tokens.TOKENIZER, 0, 100)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
    assert [(r["seg"], r["n_tokens"]) for r in got] == list(enumerate(sizes))
    back = [decode_segment(r["payload"]) for r in got]
    assert [d for ids, _, _ in back for d in ids] == list(range(docs))
    assert np.concatenate([np.zeros(0, "<u4"), *(x for _, _, x in back)]).tolist() == [i for t in texts for i in [*np.frombuffer(tokens.encoder().ids([t])[0], "<u4").tolist(), 0]]
