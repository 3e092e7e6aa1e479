"""Exact deduplication by deterministic block naming.

Every normalised text is cut into fixed-size byte blocks. Distinct blocks are sorted and numbered, so
a block becomes an integer, its rank among all; up to 64 adjacent integers make a run, distinct runs are sorted and numbered
again, and so on until one integer is left. Two texts of as many blocks have the same integer exactly
when they are equal: names stand for contents, not for hashes, so nothing can collide. A name depends on the
texts alone, not on how rows are partitioned.

Scale: text is shuffled after map-side combining to find the distinct blocks, and these once more to sort them. The
rounds after that move runs of integers, of which there are 64 times fewer each time. A block that a third of all rows share is
combined before the shuffle. Ranks come from counts by partition of the sort. Names are written out before use, so a lost executor can't change them.

Defined results: null text equals empty text; a null ``doc_id`` counts as larger than any other;
repeated rows form one group of which a single row stays; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import WS_PATTERN, discard, keyed, limited, materialise, sized_join

#: Bytes of a block.
BLOCK_BYTES = 4096
#: Adjacent names that are named together.
RUN = 64


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WS_PATTERN, " ")


def _blocks(text_bytes: F.Column, block_bytes: int) -> F.Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(text_bytes) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text_bytes, i * block_bytes + 1, F.lit(block_bytes)))


def _hashes(block: F.Column) -> tuple[F.Column, F.Column]:
    return F.xxhash64(block), F.xxhash64(block, F.lit(1))


def _ranked(distinct: DataFrame, cols: list[str], keep: list[str], what: str) -> DataFrame:
    """Columns ``keep`` of distinct rows with ``name``, the rank by ``cols``: places within the partitions of a sort, and the rows of those before."""
    numbered = materialise(distinct.orderBy(*cols).select(*keep, F.monotonically_increasing_id().alias("place")), what)
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for r in sorted(numbered.groupBy(part.alias("part")).count().collect()):  # a row for each partition of the sort
        offsets.append((r[0], before))
        before += r[1]
    offset = F.broadcast(distinct.sparkSession.createDataFrame(offsets, "part int, offset long"))
    return numbered.join(offset, part == F.col("part")).select(*keep, (F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("name"))


def identities(docs: DataFrame, key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, doc_id, sha, n_blocks, name. Equal (n_blocks, name) means equal text."""
    texts = docs.select(F.col(key).alias("k"), "doc_id", normalised().alias("norm"))
    blocks = _blocks(F.encode("norm", "UTF-8"), block_bytes)
    # The content leaves the scan once, for naming; two hashes find the name again. Blocks that share both are told apart by their content.
    pair = lambda b: F.struct(*[h.alias(n) for h, n in zip(_hashes(b), ("h1", "h2"))])
    skeleton = materialise(texts.select("k", "doc_id", F.sha2("norm", 256).alias("sha"), F.transform(blocks, pair).alias("hashes")), "dedup-skeleton")
    distinct = texts.select(F.explode(blocks).alias("block")).distinct().select("block", pair(F.col("block")).alias("h"))
    named = _ranked(distinct.select("block", "h.h1", "h.h2"), ["block"], ["h1", "h2"], "dedup-blocks")
    levels = skeleton.select("k", F.posexplode("hashes").alias("pos", "h")).select("k", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    clashes = named.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    if clashes.filter("n > 1").limit(1).count():
        clash = materialise(clashes.filter("n > 1").select("h1", "h2"), "dedup-clashes")
        content = texts.select("k", F.posexplode(blocks).alias("pos", "block")).select("k", "pos", "block", pair(F.col("block")).alias("h")).select("k", "pos", "block", "h.h1", "h.h2").join(clash, ["h1", "h2"], "left_semi")
        by_content = _ranked(distinct.select("block", "h.h1", "h.h2"), ["block"], ["block"], "dedup-contents")
        current = levels.join(named.join(clash, ["h1", "h2"], "left_anti"), ["h1", "h2"]).select("k", "pos", "name").unionByName(content.join(by_content, "block").select("k", "pos", "name"))
    else:
        current = levels.join(named, ["h1", "h2"]).select("k", "pos", "name")
    longest = skeleton.agg(F.max(F.size("hashes"))).first()[0] or 1
    sizes = skeleton.select("k", F.size("hashes").alias("n"))
    done = None
    width = F.col("n")
    if longest > 1:
        current = materialise(current.join(sizes, "k").select("k", "pos", "name", width.alias("n")), "dedup-level")
    else:
        current = current.select("k", "pos", "name", F.lit(1).alias("n"))
    used = []
    while True:
        ended = current.filter("n = 1").select("k", "name")
        done = ended if done is None else done.unionByName(ended)
        if longest <= 1:
            break
        runs = materialise(
            current.filter("n > 1")
            .groupBy("k", F.expr(f"pos div {RUN}").cast("int").alias("pos"), F.expr(f"(n + {RUN - 1}) div {RUN}").cast("int").alias("n"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("run")),
            "dedup-runs",
        )
        names = _ranked(runs.select("run").distinct(), ["run"], ["run"], "dedup-names")
        current = materialise(runs.join(names, "run").select("k", "pos", "name", "n"), "dedup-level")
        used.append(runs)
        longest = (longest + RUN - 1) // RUN
    discard(*used)
    return skeleton.select("k", "doc_id", "sha", F.size("hashes").alias("n_blocks")).join(done, "k")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """(decisions, keyed documents, name of their key). Decisions: k, doc_id, keep_k, keep_id, group_size, kept, text_sha256."""
    docs, key = keyed(docs)
    rows = materialise(identities(docs, key, block_bytes), "dedup-identities")
    groups = rows.groupBy("n_blocks", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("keep"), F.count("*").alias("group_size"))
    # Texts that occur once need no join; only members of larger groups meet their group.
    many = groups.filter("group_size > 1")
    joined = rows.join(limited(materialise(many, "dedup-groups")), ["n_blocks", "name"], "left")
    keep = F.coalesce(F.col("keep"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("k")))
    out = joined.select("k", "doc_id", keep["k"].alias("keep_k"), keep["doc_id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (keep["k"] == F.col("k")).alias("kept"), F.col("sha").alias("text_sha256"))
    return out, docs, key


def exact_dedup_report(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(docs, block_bytes)[0].select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, with all their columns."""
    columns = docs.columns
    decisions, docs, key = exact_groups(docs, block_bytes)
    dropped = decisions.filter(~F.col("kept")).select(F.col("k").alias(key))
    return sized_join(docs, dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
