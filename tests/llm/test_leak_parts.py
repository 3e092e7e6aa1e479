"""What a document leaks doesn't depend on the other items of the benchmark, nor on the parts that it is read in."""

import random
import re

import numpy as np
import pytest

from ledgerkit.llm import decontaminate
from ledgerkit.llm.decontaminate import Index


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(ws, n=5):
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def parts(text):
    """Question and answer: last line, or last sentence of a single line."""
    lines = text.strip().split("\n")
    if len(lines) > 1 and " ".join(lines[:-1]).strip():
        return words("\n".join(lines[:-1])), words(lines[-1])
    body = text.strip()
    cut = body.rstrip(".").rfind(". ")
    return (words(body[: cut + 1]), words(body[cut + 1 :])) if cut >= 0 else ([], words(body))


def brute(docs, items):
    """Every passage against every item, with nothing of the operator's own."""
    out = []
    for doc_id, text in docs:
        ws = words(text)
        for item_id, item in items:
            whole = words(item)
            if not whole or not ws:
                continue
            stride = 16
            while stride < len(whole) * 5 // 4 + 1:
                stride *= 2
            passages = [ws[at : at + 2 * stride] for at in range(0, len(ws), stride)]
            q, a = parts(item) if len(whole) >= 5 else ([], [])

            def share(part, p):
                return len(grams(part) & grams(p, min(5, len(part)))) / len(grams(part)) if part else 0

            # An item of under five words is one shingle: it is only found where it is a whole passage.
            if any(len(grams(whole) & grams(p)) >= 0.8 * len(grams(whole)) for p in passages):
                out.append((doc_id, item_id))
            elif q and a and max(share(q, p) for p in passages) >= 0.8 and max(share(a, p) for p in passages) >= 0.8:
                out.append((doc_id, item_id))
    return sorted(out)


@pytest.fixture(scope="module")
def made():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(90)] + ["the", "of", "Is.", "a"]
    items = []
    for i in range(60):
        q, a = (" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 20, 60, 150]))) for _ in range(2))
        items.append((i, r.choice([f"{q}\n{a}", f"{q}. {a}.", q])))
    docs = []
    for d in range(80):
        ws = [r.choice(vocabulary) for _ in range(r.choice([0, 4, 40, 400]))]
        for _ in range(r.randrange(3)):
            put = words(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                put[r.randrange(len(put))] = "edited"
            at = r.randrange(len(ws) + 1)
            ws[at:at] = put
        docs.append((d, " ".join(ws)))
    return docs, items


def found(index, docs):
    return sorted((d, index.items[i][0]) for d, t in docs for i in index.leaks(t))


def test_leaks_equal_brute_force(made):
    docs, items = made
    want = brute(docs, items)
    assert len(want) > 30 and found(Index(items), docs) == want


def test_other_items_dont_matter(made):
    docs, items = made
    alone = [pair for item in items for pair in found(Index([item]), docs)]
    assert sorted(alone) == brute(docs, items)
    item = " ".join(f"v{i}" for i in range(20))
    spread = " ".join(w + (" x" * 3 if i % 5 == 4 else "") for i, w in enumerate(item.split()))
    long = " ".join(f"u{i}" for i in range(200))
    assert found(Index([(1, item)]), [(1, spread)]) == found(Index([(1, item), (2, long)]), [(1, spread)])


def test_parts_dont_matter(made, spark):
    docs, items = made
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(frame, bench).collect()))
    cut = sorted(map(tuple, decontaminate.leaks(frame, bench, part_bytes=3000).collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in cut] == brute(docs, items)
    assert np.allclose([x[2:] for x in whole], [x[2:] for x in cut])
