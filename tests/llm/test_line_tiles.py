"""Lines whose words are so frequent that every tile is dealt to hundreds of parts."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerkit.llm import line_dedup


def late(texts):
    """(document, line) of lines that an earlier line resembles."""
    seen, by, out = [], defaultdict(set), set()
    for d, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            s = frozenset(re.findall(r"\S+", line))
            near = {j for w in s for j in by[w]}
            if any(100 * len(s & seen[j]) >= 80 * len(s | seen[j]) for j in near):
                out.add((d, i))
            for w in s:
                by[w].add(len(seen))
            seen.append(s)
    return out


@pytest.mark.parametrize("hot", [1])
def test_salted_tiles_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "TILE_ROWS", 4)
    monkeypatch.setattr(line_dedup, "LEADERS", 2)
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]  # each in a quarter of all lines, so in over 513 parts
    lines = []
    for _ in range(1800):
        line = r.sample(words, 9)
        if lines and r.random() < 0.1:
            old = r.choice(lines)
            line = r.sample(old, 8) + [r.choice([w for w in words if w not in old])]
        lines.append(line)
    texts = ["\n".join(map(" ".join, lines[at : at + 12])) for at in range(0, 1800, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, i) for x in line_dedup.line_report(docs).collect() for i in x.removed}
    want = late(texts)
    assert len(want) > 150 and got == want


def test_key_of_a_part(spark):
    """A word is taken back from its tile whatever its sign and the number of parts."""
    words = [-1073754169, -1, -(2**31), 0, 7, 2**31 - 1]
    tiles = [(w, (w << 32) + part) for w in words for part in (0, 1, 511, 513, 2000, 2**31 - 1)]
    rows = spark.createDataFrame(tiles, "w long, tile long").select("w", F.shiftright("tile", 32).alias("h")).collect()
    assert all(x.w == x.h for x in rows)
