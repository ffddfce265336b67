"""Sharding by balanced label propagation: documents of equal text are brought together in shards of even size.

Shards obey the law ``rows``: their numbers of documents differ by one at most. Documents that share their text are linked through it. They are
dealt to the shards in turn first. In each round a join gives every piece (the documents of a text in one shard, which only
count) the shard where most of its text lies; pieces elsewhere want to move there. Who wants to go from which shard to
which is summed, and quotas are cut until no shard would hold more than its capacity, counting what leaves it. Within its quota the moves of most
gain go first, and a piece may go in part. A shard that took less than half of what wanted to come is no goal in
later rounds, so a text larger than a shard fills one after the other. Each move adds to the links within shards, so rounds end.
Documents without a link cut no edge wherever they are: they fill the shards up to their exact capacity.

Only DataFrame functions are used. Running sums are taken over ranges of the order, so no shard's or text's documents
meet in one task; the driver sees sums for pairs of shards. Shard, slot and size are whole numbers; with the same rows in any order the result is
the same, up to rows that are equal in all.

Null text is empty: size 1, linked to other empty texts. Texts are told apart by 64 bits of hash and their length; if two ever fell
together they would only be kept together. Null ids and repeated rows are documents like others. An empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, remove

SHARDS, ROUNDS = 16, 12


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over earlier rows of equal ``by``; ``order`` has no ties. Reads a written table of ranges of the order.

    What is broadcast has a row for each range and each value of ``by`` in it; there are few such values.
    """
    parts = materialize(df.withColumn("amount", value).repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*by, "part").agg(F.sum("amount").alias("held"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*by, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("own", F.coalesce(F.sum("amount").over(own), F.lit(0)))
    return summed.join(F.broadcast(ahead), [*by, "part"]).withColumn(name, F.col("own") + F.col("ahead")).drop("own", "ahead", "part", "amount")


def quotas(wanted: dict[tuple[int, int], int], loads: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """What may move from shard to shard: at most what is wanted, and no shard ends above its capacity."""
    granted = dict(wanted)
    while True:
        change = [0] * len(loads)
        for (i, j), n in granted.items():
            change[i] -= n
            change[j] += n
        over = {j: loads[j] + change[j] - capacity[j] for j in range(len(loads)) if loads[j] + change[j] > capacity[j]}
        if not over:
            return granted
        for j, excess in over.items():
            coming = {i: n for (i, to), n in granted.items() if to == j and n}
            total = sum(coming.values())
            for i, n in coming.items():
                granted[i, j] = n - min(n, -(-excess * n // total))


def _looked_up(of: dict[tuple[int, int], int], shards: int) -> Column:
    """The number of a pair (shard, goal) of columns."""
    flat = [of.get((i, j), 0) for i in range(shards) for j in range(shards)]
    return F.element_at(F.array(*[F.lit(n).cast("long") for n in flat]), F.col("shard") * shards + F.col("goal") + 1)


def propagate(pieces: DataFrame, loads: list[int], capacity: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """``pieces(text, shard, n)`` after the moves, and the documents that each shard then holds."""
    shards, closed, loads = len(loads), set(), list(loads)
    for _ in range(rounds):
        goals = [s for s in range(shards) if s not in closed]
        if not goals:
            break
        weight = F.struct("n", F.xxhash64("text", "shard").alias("tie"))
        most = pieces.where(F.col("shard").isin(goals)).groupBy("text").agg(F.max(F.struct(weight.alias("weight"), F.col("shard").alias("goal"))).alias("most"))
        moves = pieces.join(most, "text").where(weight < F.col("most.weight"))
        moves = materialize(moves.select("text", "shard", F.col("most.goal").alias("goal"), "n", (F.col("n") - F.col("most.weight.n")).alias("gain")), "moves")
        wanted = {(r[0], r[1]): r[2] for r in moves.groupBy("shard", "goal").agg(F.sum("n")).collect()}  # at most the square of the shards
        granted = quotas(wanted, loads, capacity)
        if any(granted.values()):
            taken = moves.withColumn("taken", F.col("n"))
            if granted != wanted:
                left = _looked_up(granted, shards) - F.col("before")
                taken = running(moves, ["shard", "goal"], ["gain", "text"], F.col("n"), "before").withColumn("taken", F.greatest(F.lit(0), F.least("n", left)))
            legs = F.inline(F.array(F.struct("shard", (-F.col("taken")).alias("n")), F.struct(F.col("goal").alias("shard"), F.col("taken").alias("n"))))
            changed = pieces.unionByName(taken.where("taken > 0").select("text", legs))
            new = materialize(changed.groupBy("text", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "pieces")
            remove(pieces)
            pieces = new
        remove(moves)
        for (i, j), n in granted.items():
            loads[i] -= n
            loads[j] += n
        come = lambda of: {j: sum(n for (_, to), n in of.items() if to == j) for _, j in wanted}
        asked, came = come(wanted), come(granted)
        full = {j for j in asked if 2 * came[j] < asked[j]}
        if not full and granted == wanted or not wanted:
            break  # nobody wants more
        closed |= full
    return pieces, loads


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    rows = docs.select("doc_id", (size + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, size).alias("text"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # the numbers stand in the table
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    linked = materialize(running(texts.where("n > 1"), [], ["text"], F.col("n"), "start"), "texts")
    total, members = rows.count(), linked.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    even = lambda n: [n // shards + (s < n % shards) for s in range(shards)]
    capacity, loads = even(total), even(members)
    turn = F.explode(F.sequence(F.lit(0), F.least("n", F.lit(shards)).cast("int") - 1)).alias("turn")
    dealt = linked.select("text", "start", "n", turn).select(
        "text", ((F.col("start") + F.col("turn")) % shards).cast("int").alias("shard"), (F.floor(F.col("n") / shards) + (F.col("turn") < F.col("n") % shards).cast("long")).alias("n")
    )
    pieces, loads = propagate(materialize(dealt, "pieces"), loads, capacity, rounds)

    # a text's pieces lie one after the other over its documents, a shard's pieces over its first slots
    placed = running(pieces, ["shard"], ["text"], F.col("n"), "first")
    up_to = F.sum("n").over(Window.partitionBy("text").orderBy("shard"))  # ``shards`` rows at most
    spans = placed.withColumn("up_to", up_to).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("up_to", "shard", (F.col("first") - F.col("up_to") + F.col("n")).alias("shift")))).alias("spans"))
    homes = materialize(linked.join(spans, "text").select("text", "start", "spans"), "homes")
    known = rows.join(homes, "text", "left").withColumn("single", F.col("start").isNull())
    listed = running(known, [], ["single", "text", "doc_id", "row"], F.lit(1).cast("long"), "place")
    at = F.col("place") - F.coalesce("start", F.lit(members))
    span = F.get(F.filter("spans", lambda s: s["up_to"] > F.col("at")), F.lit(0))
    ends, most = [], 0
    for s in range(shards):
        most += capacity[s] - loads[s]
        ends.append(most)
    fill = F.array(*[F.struct(F.lit(e).cast("long").alias("up_to"), F.lit(s).alias("shard"), F.lit(capacity[s] - e).cast("long").alias("shift")) for s, e in enumerate(ends)])
    home = F.when(F.col("single"), F.get(F.filter(fill, lambda s: s["up_to"] > F.col("at")), F.lit(0))).otherwise(span)
    put = listed.withColumn("at", at).withColumn("home", home)
    return put.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "home.shard", (F.col("at") + F.col("home.shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
