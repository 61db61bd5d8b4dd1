"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, in a pseudorandom document order, are cut into blocks of ``block`` words. How many
blocks of a source each output shard gets is drawn: the counts are multinomial, given that they add
up to what the source's target needs. The draw is exact: half of n slots is a binomial number, which
is counted in the bits of n / 64 hashes, and halving again and again gives a count for each shard.
The counts make the slots; slots are mapped to blocks by a pseudorandom permutation of each source's
block indices (swap-or-not rounds), a second pass over the indices starting only after the first has
used all. Slots and document pieces meet in a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.llm.shared import cut

LANES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, rank, target. One row a source.

    Sources in code-point order, null last, get the weights in turn. Their shares of ``share`` times
    all words stop at ``most`` times the source's size; the excess goes to the others by weight. The
    stopped ones are those of the smallest ratio of room to weight, so one ordered pass finds them.
    """
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1)
    t = t.withColumn("weight", w).withColumn("room", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything) * share)
    up = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    stopped = F.col("room") / F.col("weight") <= F.col("level")
    # levels fall from the first source that does not stop; its level holds for all later ones
    t = t.withColumn("level", F.max(F.when(~stopped, F.col("level"))).over(everything))
    return t.select("source", "source_size", "rank", F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("room")), F.col("room")).alias("target"))


def permuted(df: DataFrame, index: str, n: str, key: list[str], seed: int, rounds: int = 12) -> DataFrame:
    """Replace column ``index`` (0 <= index < n) by its image under a permutation that depends on ``key``.

    Swap-or-not: each round pairs i with k - i (mod n) and a hash of the pair decides on the swap.
    """
    keys = ", ".join(key)
    other = f"pmod(pmod(xxhash64({seed}, r, {keys}), {n}) - x, {n})"
    swap = f"element_at(transform(array({other}), o -> if((xxhash64({seed + 1}, r, {keys}, greatest(x, o)) & 1L) = 1L, o, x)), 1)"
    image = f"aggregate(sequence(1, {rounds}), {index}, (x, r) -> {swap})"
    return df.withColumn(index, F.expr(f"coalesce({image}, 0L)"))  # never null: the join needs no null test that would repeat the rounds


def draws(plan: DataFrame, shards: int, seed: int, chunk: int = 1 << 14) -> DataFrame:
    """plan (rank, blocks, slots) -> rank, blocks, part, shard, lo, n: the multinomial source counts.

    A source's slots come in parts of ``chunk``, so that no row holds many bits; each part's are dealt to the
    shards (a power of two) by repeated halving, and the shard gets slots lo to lo + n - 1.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    parts = plan.where("slots > 0").select("rank", "blocks", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {chunk})")).alias("part"))
    parts = parts.withColumn("counts", F.expr(f"array(least(slots - part * {chunk}L, {chunk}L))"))
    for level in range(shards.bit_length() - 1):
        # bit_count of a hash is 64 fair draws; the last hash keeps only as many bits as are left
        bits = f"xxhash64({seed + 3}, rank, part, {level}, i, w)"
        half = f"aggregate(sequence(0L, n div 64), 0L, (got, w) -> got + bit_count(if(w < n div 64, {bits}, {bits} & if(n % 64 = 0, 0L, shiftrightunsigned(-1L, cast(64 - n % 64 as int))))))"
        split = f"transform(counts, (n, i) -> transform(array({half}), h -> array(h, n - h))[0])"
        parts = parts.withColumn("counts", F.expr(f"flatten({split})"))
    each = parts.select("rank", "blocks", "part", "counts", F.posexplode("counts").alias("shard", "n")).where("n > 0")
    lo = f"part * {chunk}L + aggregate(slice(counts, 1, shard), 0L, (a, x) -> a + x)"
    return each.select("rank", "blocks", "part", "shard", F.expr(lo).alias("lo"), "n")


def slots(plan: DataFrame, shards: int, seed: int, tasks: int) -> DataFrame:
    """plan (rank, blocks, slots) -> rank, slot, pass, shard, block: as many slots of each shard and source as were drawn."""
    drawn = draws(plan, shards, seed).repartition(tasks, "rank", "part", "shard")
    made = drawn.select("rank", "blocks", "shard", F.explode(F.expr("sequence(lo, lo + n - 1)")).alias("slot"))
    made = made.withColumn("pass", F.expr("slot div blocks")).withColumn("block", F.expr("slot % blocks"))
    return permuted(made, "block", "blocks", ["rank"], seed).drop("blocks")


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no hash, count by their entries."""
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    text = lambda c: F.to_json(F.struct(F.col(f"`{c}`")))
    return F.xxhash64(*[F.col(f"`{c}`") if k not in ("map", "struct", "array", "variant") else text(c) for c, k in kinds.items()])


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 64, seed: int = 5) -> dict[str, DataFrame]:
    """``rows``: doc_id, source, key, size, source_size, target, rank, lo (first word's place in its source).
    ``taken``: rank, lo, pass, shard, slot, first, last: the words [first, last) of a row that a slot takes.

    A null text has no words and is never taken; a null source is a source of its own. Rows are told
    apart by id and a hash of all columns; rows that repeat in all of them have a place each. Sources
    without words have no blocks. An empty table gives empty tables.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), row_key(docs).alias("key"))
    rows = cut(rows.withColumn("lane", F.expr(f"pmod(xxhash64({seed}, key, doc_id), {LANES})")), "mix-rows")
    starts = rows.groupBy("source", "lane").agg(F.sum("size").alias("n"))
    sizes = starts.groupBy("source").agg(F.sum("n").alias("source_size"))
    goal = cut(targets(sizes, weights, share, most), "mix-targets")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("lane"))
    starts = starts.select(F.col("source").alias("s"), F.col("lane").alias("l"), (upto - F.col("n")).alias("from"))
    order = Window.partitionBy("source", "lane").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(order)).join(starts, F.expr("source <=> s and lane = l")).drop("s", "l")
    placed = placed.join(goal.withColumnRenamed("source", "s"), F.expr("source <=> s"))
    placed = placed.select("doc_id", "source", "key", "size", "source_size", "target", "rank", F.expr("`from` + upto - size").alias("lo"))
    plan = goal.where("source_size > 0").select("rank", "target", "source_size", F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"))
    plan = plan.select("rank", "blocks", F.expr(f"least(cast(floor(blocks * {most}) as long), cast(round(target * blocks / source_size) as long))").alias("slots"))
    pieces = placed.where("size > 0").select("rank", "lo", "size", F.explode(F.expr(f"sequence(lo div {block}, (lo + size - 1) div {block})")).alias("block"))
    pieces = pieces.select("rank", "lo", "block", F.expr(f"greatest(0L, block * {block} - lo)").alias("first"), F.expr(f"least(size, (block + 1) * {block} - lo)").alias("last"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    # slots come from a table of a row a source, whose estimated size must not let them be broadcast
    taken = slots(plan, shards, seed, max(1, min(10_000, -(-total >> 17)))).hint("merge").join(pieces, ["rank", "block"])
    return {"rows": placed, "taken": taken}


def amounts(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken, in_shards: one row per row of ``docs``.

    taken is the sum of the words that the output shards take; in_shards (array of shard, words) says which.
    """
    m = mix(docs, **settings)
    got = m["taken"].groupBy("rank", "lo", "shard").agg(F.sum(F.expr("last - first")).alias("words"))
    got = got.groupBy("rank", "lo").agg(F.sum("words").alias("got"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("in_shards"))  # a shard each at most
    out = m["rows"].join(got.withColumnsRenamed({"rank": "r", "lo": "l"}), F.expr("rank = r and lo = l and size > 0"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), F.coalesce("in_shards", F.expr("cast(array() as array<struct<shard: int, words: bigint>>)")).alias("in_shards"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows of ``docs``' columns: one row for each pass that takes words of a document.

    Where a pass takes all words the text stays as it is, else the taken words are joined by blanks;
    an ``n_chars`` column is set anew. Documents of which nothing is taken are left out.
    """
    m = mix(docs, **settings)
    got = m["taken"].groupBy("rank", "lo", "pass").agg(F.sum(F.expr("last - first")).alias("got"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("parts"))
    place = m["rows"].where("size > 0").select("rank", "lo", "size", "key", F.col("doc_id").alias("_doc"))
    names = {c: f"__mix_{c}" for c in ("key", "doc", "size", "got", "parts")}  # docs may have columns of any other name
    got = got.join(place, ["rank", "lo"]).withColumnRenamed("_doc", "doc").select(*[F.col(c).alias(n) for c, n in names.items()])
    # rows that repeat in every column are one here; each of their places brings one back
    own = docs.withColumn("__mix_id", row_key(docs)).dropDuplicates(["doc_id", "__mix_id"])
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    cut_out = lambda w: F.flatten(F.transform("__mix_parts", lambda p: F.slice(w, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int"))))
    some = F.array_join(F.element_at(F.transform(F.array(words), cut_out), 1), " ")  # the words are found once a row
    out = own.join(got, F.expr("__mix_id = __mix_key and doc_id <=> __mix_doc"))
    out = out.withColumn("text", F.when(F.col("__mix_got") == F.col("__mix_size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
