"""Similarity join of documents on word shingles by T-occurrence search.

Two documents link when their sets of shingles have a Jaccard similarity of at least ``percent`` / 100. The result gives
each document the smallest id that links reach.

1. Documents with the same words are one node, the smallest id standing for them.
2. Shingles are counted over all nodes by the two-round exchange of ``anchors``; a node learns which of its shingles others
   have too. A node that links must share one of its rarest shingles, as many as may be missing plus one: its prefix.
   Nodes without a shared shingle there are done; the others are stored with their shared shingles.
3. Nodes that share a prefix shingle form blocks (connected components, so a block holds every link of its nodes). Blocks
   go to tasks; a block too large for a task is cut into chunks and is searched in two rounds. First each chunk by itself,
   beside a few pivots of the block that are in all chunks, so that a family of near copies hangs together already. Then
   pairs of chunks, without the pairs inside the largest component, whose members need no more links.
4. In a block, each node searches the inverted lists of its shingles for nodes that occur in at least T of them, T being
   the overlap that the sizes require: with DivideSkip, the long lists are set aside, the short ones are merged with a
   threshold lowered by their number, and the survivors are probed in the long lists by binary search. Nodes already
   reached by links are skipped, so only a spanning forest of the links leaves the task.
5. Connected components of those links.

Null or empty text, or text without a word, has an empty set and links with nothing, not even its like. Rows that share a
``doc_id`` are one document with several sets: each row gets its own count, and links of any of them join. A null
``doc_id`` is the smallest id. Other columns are ignored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybeam.llm.anchors import announcement, count_in_buckets, in_order, repeated
from tallybeam.llm.shared import GROUP_BYTES, NO_ID, PACKED, WordHashes, gram_hashes, id_or_least, id_or_null, in_groups, mixed, packed, stored, text_or_empty

SHINGLE = 5
PERCENT = 75
PORTION = 1 << 20
BLOCK_TOKENS = 3_000_000
PIVOTS = 16
SET_ASIDE = 12  # short lists must still share this many shingles, so that merging leaves few candidates

HASHES = WordHashes()
SHORT = 0xA0761D6478BD642F  # keeps sequences that are shorter than a shingle apart from shingles


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: lower() changes A-Z only, split() cuts at ASCII white space only


def shingle_sets(lists: list[list[bytes]], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each list of words."""
    hashes = HASHES.of([w for words in lists for w in words])
    grams = gram_hashes(hashes, size)
    out, at = [], 0
    for words in lists:
        n = len(words)
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        else:
            apart = np.uint64(SHORT * n % 2**64)
            out.append(mixed(gram_hashes(hashes[at : at + n], n) + apart) if n else np.zeros(0, np.uint64))
        at += n
    return out


def normal_digest(text: Column) -> Column:
    """Digest of the sequence of lower-cased words."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.sha2(F.btrim(F.regexp_replace(lower, "[ \\t-\\r]+", " ")), 256)


def least_overlap(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Smallest intersection with which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (sizes + size) // (100 + percent))


class Forest:
    """Union by smaller root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.up
        found = up[nodes]
        while True:
            above = up[found]
            if (above == found).all():
                break
            found = above
        up[nodes] = found
        return found

    def join(self, a: int, b: int) -> None:
        a, b = self.roots(np.array([a, b])).tolist()
        self.up[max(a, b)] = min(a, b)


def links_in_block(sets: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among nodes, given their shared shingles and full set sizes.

    With ``side``, only links between different sides are looked for.
    """
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(lengths)
    own = [np.sort(where[e - k : e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    # Inverted lists: nodes of each token, in order of the node.
    by_token = np.argsort(where, kind="stable")
    nodes = np.repeat(np.arange(n), lengths)[by_token]
    list_sizes = np.bincount(where, minlength=len(tokens))
    list_ends = np.cumsum(list_sizes)
    entries = where[by_token].astype(np.int64) * n + nodes  # all lists in one sorted array
    forest, found = Forest(n), []
    for x in range(n):
        size = int(sizes[x])
        smallest = -(-percent * size // 100)  # of any partner: the union is at least this set
        if len(own[x]) < smallest:
            continue
        mine = own[x][np.argsort(list_sizes[own[x]], kind="stable")].astype(np.int64)
        aside = max(0, smallest - SET_ASIDE)
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        merged = np.concatenate([nodes[list_ends[t] - list_sizes[t] : list_ends[t]] for t in short.tolist()])
        merged = merged[merged < x]
        if not len(merged):
            continue
        counts = np.bincount(merged, minlength=x)
        candidates = np.flatnonzero(counts >= smallest - aside)
        fits = (sizes[candidates] * 100 >= percent * size) & (sizes[candidates] * percent <= 100 * size)
        candidates = candidates[fits]
        if side is not None:
            candidates = candidates[side[candidates] != side[x]]
        # The likeliest first: once linked, all that hangs together with a partner is skipped.
        candidates = candidates[np.argsort(-counts[candidates], kind="stable")]
        needed = least_overlap(sizes[candidates], size, percent)
        long = np.sort(long)
        while len(candidates):
            apart = forest.roots(candidates) != forest.roots(np.array([x]))[0]
            candidates, needed = candidates[apart], needed[apart]
            for k, y in enumerate(candidates.tolist()):
                overlap = int(counts[y])
                if len(long):  # binary probes of the node in the lists set aside
                    probes = long * n + y
                    at = np.searchsorted(entries, probes)
                    overlap += int((entries[np.minimum(at, len(entries) - 1)] == probes).sum())
                if overlap >= needed[k]:
                    forest.join(x, y)
                    found.append((x, y))
                    candidates, needed = candidates[k + 1 :], needed[k + 1 :]
                    break
            else:
                break
    return found


def connected(edges: DataFrame, name: str) -> DataFrame:
    """``id, root`` for every id on an edge ``u, v``: the smallest id it hangs together with.

    Alternates large-star and small-star steps until nothing changes. A hub is one row on one side of each join, so Spark
    splits its other side.
    """
    edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


NODES = "id long, digest string, n long, prefix array<long>, shared array<long>"
LINKS = "u long, v long"


def _as_lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def shared_shingles(docs: DataFrame, nodes: DataFrame, size: int, percent: int, group_bytes: int) -> DataFrame:
    """Per row whose ``id`` is in ``nodes``: digest of its words, set size, prefix shingles that others have, all shingles that others have."""
    rows, groups = in_groups(docs, group_bytes)
    buckets = groups  # a bucket has about as many hashes as a group
    # Rows without an id are in any group.
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    at = F.when(F.col("id") == NO_ID, F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(own)
    wanted = nodes.withColumn("g", F.explode(at)).groupBy("g").agg(F.collect_list("id").alias("ids"))
    wanted = wanted.select("g", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "ids")

    def sets(table: pa.Table, ids: set[int]):
        for keys, texts in in_order(table, PORTION):
            own = [k for k, key in enumerate(keys) if key in ids]
            lists = [words_of(texts[k]) for k in own]
            digests = [hashlib.sha256(b" ".join(words)).hexdigest() for words in lists]
            yield from zip([keys[k] for k in own], digests, shingle_sets(lists, size), strict=True)

    def listed(side: pa.Table) -> set[int]:
        return {key for keys in side.column("ids").to_pylist() if keys for key in keys}

    def announce(table: pa.Table, side: pa.Table) -> pa.Table:
        hashes = [s for *_, s in sets(table, listed(side))]
        if not hashes:
            return packed([])
        return announcement(table.column("g")[0].as_py(), np.concatenate(hashes) >> np.uint64(20), buckets)[0]

    def select(table: pa.Table, side: pa.Table) -> pa.Table:
        found = list(sets(table, listed(side)))
        keys, digests, hashes = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        answers = side.filter(pc.is_valid(side.column("blob")))
        again, totals = repeated(np.concatenate([np.zeros(0, np.uint64), *hashes]) >> np.uint64(20), answers, buckets)
        prefixes, shared = [], []
        for s in hashes:
            short = s >> np.uint64(20)
            at = np.minimum(np.searchsorted(again, short), max(len(again) - 1, 0))
            known = again[at] == short if len(again) else np.zeros(len(s), bool)
            own = s[known]
            missing = len(s) - -(-percent * len(s) // 100)
            first = max(0, missing + 1 - (len(s) - len(own)))
            # Rarest first, and by hash among equals: the same order everywhere.
            order = np.lexsort((own, totals[at[known]])) if first else np.zeros(0, np.int64)
            prefixes.append(own[order[:first]])
            shared.append(own if first else own[:0])
        return pa.table({"id": pa.array(keys, pa.int64()), "digest": pa.array(digests, pa.string()), "n": pa.array([len(s) for s in hashes], pa.int64()),
                         "prefix": _as_lists(prefixes), "shared": _as_lists(shared)})

    announced = rows.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(announce, PACKED)
    answers = count_in_buckets(announced).select("g", "bucket", "blob", F.lit(None).cast("array<long>").alias("ids"))
    return rows.groupBy("g").cogroup(answers.unionByName(wanted).groupBy("g")).applyInArrow(select, NODES)


def first_round(members: DataFrame) -> DataFrame:
    """Members of blocks dealt to chunks, and a few of each large block, its pivots, to all of its chunks.

    The sets are part of the hash, since there may be many under one id: those of the rows without an id.
    """
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("id", "shared"), F.col("chunks")).cast("int"))
    order = F.xxhash64("id", F.lit(7))
    one = F.min_by(F.struct("chunks", "mine", "id", "n", "shared"), F.struct(order, "n")).alias("one")
    pivots = dealt.filter("chunks > 1").groupBy("block", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(one).select("block", "one.*")
    pivots = pivots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("other != mine")
    columns = ["block", "low", "high", "mine", "id", "n", "shared"]
    return dealt.withColumns({"low": F.col("mine"), "high": F.col("mine")}).select(columns).unionByName(
        pivots.withColumns({"low": F.col("other"), "high": F.col("other")}).select(columns)
    )


def second_round(members: DataFrame, roots: DataFrame, block_tokens: int) -> tuple[DataFrame, int]:
    """What the first round left in large blocks: pairs of chunks, but none of two chunks of the block's largest component.

    Members of one component need no link, so the largest component meets the other members only, and itself never. The
    number is that of all dealt shingles, copies included.
    """
    members = members.join(roots.distinct(), "id", "left").withColumn("root", F.coalesce("root", "id"))
    tokens = members.groupBy("block", "root").agg(F.sum(F.size("shared")).alias("tokens"))
    most = F.max(F.struct("tokens", "root")).alias("most")
    parts = tokens.groupBy("block").agg(most, (F.sum("tokens") - F.max("tokens")).alias("rest")).filter("rest > 0")
    count = lambda of: F.ceil(F.col(of) / F.lit(block_tokens)).cast("int")
    chunks = parts.select("block", F.col("most.root").alias("largest"), count("most.tokens").alias("large_chunks"), count("rest").alias("rest_chunks"))
    most, rest = F.col("most.tokens"), F.col("rest")
    total = parts.agg(F.sum(rest * (count("rest") + count("most.tokens")) + most * count("rest"))).first()[0] or 0
    dealt = members.join(chunks, "block")
    inside = F.col("root") == F.col("largest")
    key = F.xxhash64("id", "shared", F.lit(11))
    mine = F.when(inside, F.col("rest_chunks") + F.pmod(key, F.col("large_chunks"))).otherwise(F.pmod(key, F.col("rest_chunks")))
    others = F.when(inside, F.col("rest_chunks")).otherwise(F.col("rest_chunks") + F.col("large_chunks"))
    dealt = dealt.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others.cast("int") - 1)))
    dealt = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    return dealt.select("block", "low", "high", "mine", "id", "n", "shared"), total


def in_tasks(dealt: DataFrame, total: int, block_tokens: int) -> DataFrame:
    """Dealt rows with a task, of which there are as many as ``total`` shingles need."""
    tasks = max(1, -(-total // max(1, block_tokens // 4)))
    return dealt.withColumn("task", F.pmod(F.xxhash64("block", "low", "high"), F.lit(tasks)).cast("int"))


def links(nodes: DataFrame, percent: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``u, v``: links that hold all linked nodes together."""
    active = nodes.filter("size(prefix) > 0")
    postings = active.select("id", F.explode("prefix").alias("token"))
    least = postings.groupBy("token").agg(F.min("id").alias("least"), F.count("*").alias("many")).filter("many > 1")
    meets = postings.join(least, "token").select(F.col("id").alias("u"), F.col("least").alias("v"))
    blocks = connected(meets.distinct(), "block-edges")
    # Rows that share a doc_id are separate sets with one id; a pair of them needs no link.
    members = active.join(blocks, "id").select("id", "n", "shared", F.col("root").alias("block"))
    sizes = members.groupBy("block").agg(F.sum(F.size("shared")).alias("tokens"))
    chunks = F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("int")
    members = members.join(sizes.select("block", chunks.alias("chunks")), "block")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("low", "ascending"), ("high", "ascending"), ("n", "ascending"), ("id", "ascending")])
        keys = np.stack([table.column(c).to_numpy() for c in ("block", "low", "high")])
        begins = np.flatnonzero(np.r_[True, (np.diff(keys) != 0).any(0)])
        ids, n, mine = (table.column(c).to_numpy() for c in ("id", "n", "mine"))
        shared = table.column("shared").combine_chunks()
        flat, offsets = shared.values.to_numpy().view(np.uint64), shared.offsets.to_numpy()
        out = []
        for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True):
            sets = [flat[offsets[k] : offsets[k + 1]] for k in range(low, high)]
            side = None if keys[1, low] == keys[2, low] else mine[low:high]
            out += [(ids[low + a], ids[low + b]) for a, b in links_in_block(sets, n[low:high], percent, side)]
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def searched(dealt: DataFrame, total: int) -> DataFrame:
        return in_tasks(dealt, total, block_tokens).groupBy("task").applyInArrow(search, LINKS)

    total, most = sizes.agg(F.sum("tokens"), F.max("tokens")).first()
    found = searched(first_round(members), total or 0)
    if (most or 0) <= block_tokens:  # no block was cut, so the second round has no rows
        return found
    found = stored(found, "jaccard-first-links")
    large = members.filter("chunks > 1").drop("chunks")
    roots = connected(found.join(large.select(F.col("id").alias("u")).distinct(), "u", "left_semi"), "jaccard-first-roots")
    return found.unionByName(searched(*second_round(large, roots, block_tokens)))


def components(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, group_bytes: int = GROUP_BYTES, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``."""
    keyed = stored(docs.select(id_or_least().alias("id"), normal_digest(text_or_empty()).alias("digest")), "jaccard-digests")
    same = keyed.groupBy("digest").agg(F.min("id").alias("node"))
    keyed = stored(keyed.join(same, "digest").select("id", "node", "digest"), "jaccard-nodes")
    nodes = stored(shared_shingles(docs, keyed.select(F.col("node").alias("id")).distinct(), size, percent, group_bytes), "jaccard-sets")
    roots = connected(links(nodes, percent, block_tokens), "jaccard-links")
    # Copies take the count and the component of their node; a node outside all links is its own component.
    counts = nodes.select(F.col("id").alias("node"), "digest", "n").distinct()
    found = keyed.join(counts, ["node", "digest"]).join(roots.withColumnRenamed("id", "node"), "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("root", "node"))
    found = found.withColumn("component", component)
    return found.select(id_or_null("id").alias("doc_id"), F.col("n").alias("n_shingles"), id_or_null("component").alias("component_id"))
