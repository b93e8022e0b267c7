"""SimHash fingerprints of texts in DataFrame operations only.

A term is a word with the word after it; its weight is the characters of both. Each term is hashed to ``BITS`` bits and each
bit gains or loses the weight; the signs are the fingerprint. Sums of two bits share one 64-bit number, so a text takes half
as many sums as bits. A text's terms are exploded and summed in one stage, without an exchange.

``near_fingerprints`` finds all fingerprints within a Hamming radius with permuted block tables: the bits are cut into
``BLOCKS`` blocks, and a table for each block brings it to the front as its key. Fingerprints within the radius differ in few
bits of at least one block (``allowances``), so a query asks each table for all keys that near its own, and an equal join on
table and key meets them all; a pair is reported by the first table that it meets in. Keys have 18 bits at least, so
candidates stay few where the table is large, and rows of the index, of which there are most, have one row for each block.

Null text is empty text, which has the fingerprint of zeros, as has any text without a word. The next document is the next
row by ``doc_id`` and, among rows that share one, by text (where so many share one that they are cut into parts, by part
first); a null ``doc_id`` comes first; the last row is followed by the first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybeam.llm.shared import NO_ID, id_or_least, id_or_null, stored, text_or_empty

WORDS = 2  # 64-bit words of a fingerprint
BITS = 64 * WORDS
ROWS_PER_PART = 2000
RANGES = 64
RADIUS = 18  # nine of ten near copies, at a similarity of 0.75 by five-word shingles, are within it
BLOCKS = 7  # tables; more of them need fewer keys a query, of fewer bits and so with more candidates
LANES = 0x100000001
SPACE = " \t\n\x0b\x0c\r"


def _terms(text: Column) -> Column:
    return F.split(F.lower(F.btrim(text, F.lit(SPACE))), "[ \\t-\\r]+")


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``words`` (the fingerprint as 64-bit numbers) for rows of ``keys`` and ``text``; keys are unique.

    Where rows are partitioned by some of the keys, the sums need no exchange.
    """
    words = texts.select(*keys, _terms(F.col("text")).alias("terms"))
    terms = words.select(*keys, "terms", F.posexplode("terms").alias("pos", "term"))
    after = F.get("terms", F.col("pos") + 1)
    weight = (F.length("term") + F.coalesce(F.length(after), F.lit(0))).cast("long")
    hashes = [F.xxhash64("term", after, F.lit(seed)).alias(f"h{seed}") for seed in range(WORDS)]
    hashed = terms.select(*keys, weight.alias("weight"), *hashes)
    sums = [
        F.sum(F.col("weight") * F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(LANES))).alias(f"s{k}_{i}")
        for k in range(WORDS)
        for i in range(32)
    ]
    total = hashed.groupBy(*keys).agg(F.sum("weight").alias("weight"), *sums)

    def number(k: int) -> Column:
        bits = []
        for i in range(32):
            both = F.col(f"s{k}_{i}")
            low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32)
            for votes, at in ((low, i), (high, i + 32)):
                one = (1 << at) - (1 << 64 if at == 63 else 0)
                bits.append(F.when(votes * 2 > F.col("weight"), F.lit(one)).otherwise(F.lit(0)).cast("long"))
        return reduce(Column.bitwiseOR, bits)

    return total.select(*keys, F.array(*[number(k) for k in range(WORDS)]).alias("words"))


def as_text(words: Column) -> Column:
    """A fingerprint in hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(words[k]), 16, "0") for k in range(WORDS)]))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return reduce(Column.__add__, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WORDS)])


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def _block(words: list[Column], k: int, blocks: int) -> Column:
    """Bits of one block as a number; blocks have at most 32 bits."""
    low, high = BITS * k // blocks, BITS * (k + 1) // blocks
    parts, at = [], 0
    for w in range(WORDS):
        first, last = max(low, 64 * w) - 64 * w, min(high, 64 * w + 64) - 64 * w
        if first < last:
            part = F.shiftrightunsigned(words[w], first).bitwiseAND(F.lit((1 << (last - first)) - 1).cast("long"))
            parts.append(F.shiftleft(part, at))
            at += last - first
    return reduce(Column.bitwiseOR, parts)


def allowances(radius: int, blocks: int) -> list[int]:
    """In how many bits each block may differ, so that fingerprints within the radius stay within it in some block.

    Were each block beyond its allowance, the fingerprints would differ in more than ``radius`` bits. A block with a negative
    allowance needs no table.
    """
    least, more = divmod(radius, blocks)
    return [least - (k > more) for k in range(blocks)]


def _flips(bits: int, most: int) -> list[int]:
    """All patterns of up to ``most`` bits."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``query, found, distance`` of distinct fingerprints (arrays ``words``) within ``radius``, itself included.

    A fingerprint of the index has a row for each table and one of the queries a row for each key that it asks for. These
    rows are exchanged by table and key, which are one number.
    """
    blocks = max(4, min(BLOCKS, radius + 1))
    allowed = [(k, most) for k, most in enumerate(allowances(radius, blocks)) if most >= 0]
    sizes = [BITS * (k + 1) // blocks - BITS * k // blocks for k in range(blocks)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("words").distinct().select(*[F.get("words", k).alias(f"{name}{k}") for k in range(WORDS)])
        words = [F.col(f"{name}{k}") for k in range(WORDS)]
        fronts = F.array(*[_block(words, k, blocks).bitwiseOR(F.lit(k << 32).cast("long")) for k, _ in allowed])
        return rows.select(*words, F.explode(fronts).alias("near"))

    flips = ", ".join(f"array({', '.join(f'{x}L' for x in _flips(sizes[k], most))})" for k, most in allowed)
    asked = tables(queries, "q").withColumn("flip", F.explode(F.get(F.expr(f"array({flips})"), F.shiftright("near", 32).cast("int"))))
    asked = asked.withColumn("near", F.col("near").bitwiseXOR(F.col("flip"))).drop("flip")
    met = asked.join(tables(index, "f").hint("shuffle_hash"), "near")
    apart = [F.col(f"q{k}").bitwiseXOR(F.col(f"f{k}")) for k in range(WORDS)]
    met = met.withColumn("distance", reduce(Column.__add__, [F.bit_count(x) for x in apart])).filter(F.col("distance") <= radius)
    # A pair that meets in several tables is reported by the first of them.
    first = reduce(
        lambda others, one: F.when(F.bit_count(_block(apart, one[0], blocks)) <= one[1], F.lit(one[0])).otherwise(others),
        reversed(allowed),
        F.lit(-1),
    )
    met = met.filter(first == F.shiftright("near", 32))
    return met.select(*[F.array(*[F.col(f"{x}{k}") for k in range(WORDS)]).alias(name) for x, name in (("q", "query"), ("f", "found"))], "distance")


@contextmanager
def joined_by_first_block(spark: SparkSession) -> Iterator[None]:
    """Let a join use an exchange by one of its keys, which Spark else repeats by all of them. Joins by one key don't need it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_ranges(rows: DataFrame, ranges: int = RANGES) -> list[int]:
    """First ids of about ``ranges`` ranges that hold about as many rows each; an id that fills one is a range by itself."""
    ends = rows.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    limits = [min(int(v), 2**63 - 1) for v in ends]
    alone = {v for v, after in zip(limits, limits[1:], strict=False) if v == after}
    return sorted({NO_ID, NO_ID + 1, *limits, *(v + 1 for v in alone if v < 2**63 - 1)})


def with_next(docs: DataFrame, rows_per_part: int = ROWS_PER_PART) -> tuple[DataFrame, DataFrame]:
    """All rows but the last of each part, and those: ``part, place, id, text, next_part, next_place, next_text``.

    Ids are cut into a fixed number of ranges at their quantiles, and a range into parts of equal width; where a range is
    one id, which may be that of a third of all rows, parts are those of the texts' hash. A part's last row takes its next
    text from the first row of the next part that has rows; these ends alone are joined.
    """
    rows = docs.select(id_or_least().alias("id"), text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    limits = id_ranges(rows)
    at = F.lit(0)
    for k, limit in enumerate(limits[1:], 1):
        at = F.when(F.col("id") >= F.lit(limit), F.lit(k)).otherwise(at)
    rows = rows.withColumn("range", at)
    found = {r["range"]: r for r in rows.groupBy("range").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).collect()}
    begin, sizes = 0, []
    for k in range(len(limits)):
        low, high, n = (found[k]["low"], found[k]["high"], found[k]["n"]) if k in found else (0, 0, 0)
        parts = max(1, n // rows_per_part)
        sizes.append((k, begin, parts, low, min(max(1, -(-(high - low + 1) // parts)), 2**63 - 1), low == high))
        begin += parts
    # One row for each range, of which there is a fixed number.
    plan = docs.sparkSession.createDataFrame(sizes, "range int, begin long, parts long, low long, width long, alone boolean")
    rows = rows.join(F.broadcast(plan), "range")
    by_hash = F.floor((F.shiftrightunsigned("hash", 33) * F.col("parts")) / F.lit(2**31))
    by_id = F.floor((F.col("id").cast("double") - F.col("low").cast("double")) / F.col("width"))
    within = F.least(F.when(F.col("alone"), by_hash).otherwise(by_id).cast("long"), F.col("parts") - 1)
    rows = rows.select("id", "text", "hash", "range", (F.col("begin") + within).alias("part"))
    order = stored(rows.groupBy("range", "part").agg(F.count("*").alias("last")), "parts")
    firsts = {r["range"]: r["first"] for r in order.groupBy("range").agg(F.min("part").alias("first")).collect()}
    # A range's last part is followed by the first of the next range that has rows, the last of all by the first of all.
    after_range = [(k, min((f for r, f in firsts.items() if r > k), default=min(firsts.values()))) for k in firsts]
    after = docs.sparkSession.createDataFrame(after_range, "range int, after long")
    following = F.coalesce(F.lead("part").over(Window.partitionBy("range").orderBy("part")), F.col("after"))
    order = order.join(F.broadcast(after), "range").select("part", following.alias("following"))
    inside = Window.partitionBy("part").orderBy("id", "text")
    placed = rows.drop("range", "hash").withColumns({"place": F.row_number().over(inside).cast("long"), "next_text": F.lead("text").over(inside)})
    # Every row has a text, so only the last of a part has no next one.
    ends = placed.filter("next_text is null").drop("next_text").join(order.hint("merge"), "part")
    heads = placed.filter("place = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    ends = ends.join(heads.hint("merge"), "following").withColumns({"next_part": F.col("following"), "next_place": F.lit(1).cast("long")})
    others = placed.filter("next_text is not null").withColumns({"next_part": F.col("part"), "next_place": F.col("place") + 1})
    columns = ["part", "place", "id", "text", "next_part", "next_place", "next_text"]
    return others.select(*columns), ends.select(*columns)


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, queries: Column | None = None) -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the start of the next document's.

    Per document ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, and for rows
    that satisfy ``queries`` the number of distinct fingerprints within ``radius`` (``n_near``), the own one included.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    keep = F.length("text") - half
    edited = F.concat(F.substring("text", F.lit(1), keep), F.substring("next_text", F.lit(1), half))

    def of(rows: DataFrame) -> DataFrame:
        both = rows.select("part", "place", F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), edited.alias("text"))
        )).alias("one")).select("part", "place", "one.which", "one.text")
        prints = fingerprints(both, ["part", "place", "which"])
        own = F.max(F.when(F.col("which") == 0, F.col("words"))).alias("words")
        return prints.groupBy("part", "place").agg(own, F.max(F.when(F.col("which") == 1, F.col("words"))).alias("edited_words"))

    def facts(rows: DataFrame) -> DataFrame:
        return rows.select("part", "place", "id", "next_part", "next_place",
                           F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))

    inner, ends = with_next(docs)
    prints = of(inner).unionByName(of(ends))
    found = stored(prints.join(facts(inner).unionByName(facts(ends)).hint("merge"), ["part", "place"]), "fingerprints")
    after = found.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("words").alias("next_words"))
    # Fingerprints grow with the table, whatever their files' size says, so they are never broadcast.
    result = found.join(after.hint("merge"), ["next_part", "next_place"]).select(
        id_or_null("id").alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("words")).alias("fingerprint"), as_text(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
        likeness(F.col("words"), F.col("next_words")).alias("near_next"), "words",
    )
    if queries is not None:
        asked = found.withColumn("doc_id", id_or_null("id")).filter(queries)
        near = stored(near_fingerprints(asked, found, radius).groupBy("query").agg(F.count("*").alias("n_near")), "near")
        asks = F.coalesce(queries, F.lit(False))
        counted = result.filter(asks).join(near.withColumnRenamed("query", "words").hint("merge"), "words", "left")
        others = result.filter(~asks).withColumn("n_near", F.lit(None).cast("long"))
        result = counted.unionByName(others)
    return result.drop("words")
