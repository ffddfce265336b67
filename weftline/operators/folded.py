"""Figures of a fold without its edges, which have the square of a person's repositories.

Repositories of the same people are twins: they have the same neighbours, each other apart, with the same weights. So twins of equal copies are a class with a
number of members, and degrees, components and labels are told from classes. A label's score at a repository is the sum over its people of how many of theirs have
it, less what it adds itself, so labels are counted by person and only the two best of a class are ever looked at: one of them is not the repository's own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import tiles as T
from weftline.operators.filters import restrict, rows_of
from weftline.operators.graph import BLOCK, LINKS, MOST, component_labels, removed, stats_row, written


def twins(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, second, n, copies, people): repositories of ``nodes`` with equal people and equally many rows; ``id`` and ``second`` are the two smallest of ``n``.

    People of one repository make no edge and are left out, and so is who has no other people.
    """
    copies = nodes.groupBy("id").agg(rows_of(nodes).cast("long").alias("copies"))
    inside = restrict(links, copies.select("id"), "repo_id").where("owner_login IS NOT NULL").select("repo_id", "owner_login").distinct()
    spread = inside.groupBy("owner_login").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    people = restrict(inside, spread.select("owner_login"), "owner_login").groupBy(F.col("repo_id").alias("id")).agg(F.array_sort(F.collect_list("owner_login")).alias("people"))
    alike = Window.partitionBy("people", "copies").orderBy("id")
    ranked = people.join(copies, "id").select("id", "people", "copies", F.row_number().over(alike).alias("r"), F.lead("id").over(alike).alias("next"))
    ends = ranked.where("r = 1 OR next IS NULL").groupBy("people", "copies")  # the last's rank is their number
    found = ends.agg(F.min("id").alias("id"), F.min_by("next", "r").alias("second"), F.max("r").cast("long").alias("n"))
    return found.select("id", "second", "n", "copies", "people")


def best_labels(rows: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, met, top): of ``rows(id, owner_login)`` the two labels of greatest score with these, structs (s, label) with the score's negative, and the sum of ``m`` of all labels met.

    ``labels(owner_login, label, v, m)`` have one row for each login and label, and one ``m`` a label; scores sum ``v`` over shared logins. Ids and labels are dealt into blocks; a pair of blocks
    is a task, which sums scores a piece at a time and gives out two labels an id. Both are read twice, so tables are best.
    """
    spark = rows.sparkSession
    T.ship(spark)
    count = lambda df, name: df.groupBy("owner_login").agg(F.count(F.lit(1)).alias(name))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pairs, n, m = count(rows, "a").join(count(labels, "b"), "owner_login").agg(whole(F.expr("double(a) * b")), whole("a"), whole("b")).head()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs) >> 14)
    blocks = max(min(math.ceil(math.sqrt(max(pairs / block**2, tasks, 1))), MOST), math.ceil(max(n, m) / LINKS))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("own")
    entries = lambda text: F.collect_list(F.expr(f"struct({text})")).alias("xs")
    sides = [rows.groupBy("owner_login", own("id")).agg(entries("id, 0L AS v, 0L AS m")), labels.groupBy("owner_login", own("label")).agg(entries("label AS id, v, m"))]
    sent = []
    for side, (lists, other) in enumerate((sides, sides[::-1])):
        there = other.groupBy("owner_login").agg(F.collect_list("own").alias("others"))
        to = lists.join(there, "owner_login").select("owner_login", "own", "xs", F.explode("others").alias("other"))
        tile = F.expr(f"own * {blocks} + other" if side == 0 else f"other * {blocks} + own")
        sent.append(to.select(tile.alias("tile"), F.lit(side).alias("side"), "owner_login", "xs"))
    made = sent[0].unionAll(sent[1]).repartitionById(blocks * blocks, "tile").mapInArrow(T.best_of_tile, "id long, score1 long, label1 long, score2 long, label2 long, met long")
    two = F.array(*[F.struct((-F.col(f"score{k}")).alias("s"), F.col(f"label{k}").alias("label")) for k in (1, 2)])
    found = made.groupBy("id").agg(F.sum("met").alias("met"), F.flatten(F.collect_list(two)).alias("top"))
    return found.select("id", "met", F.slice(F.array_sort(F.filter("top", lambda t: t.s < 0)), 1, 2).alias("top"))


def by_person(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, label, copies, people, owner_login): labels of the members of a class, a row for each of their people."""
    return labels.join(classes.select("id", "copies", "people"), "id").select("id", "label", "members", "copies", F.size("people").alias("people"), F.explode("people").alias("owner_login"))


def class_labels(classes: DataFrame, first: DataFrame, rounds: int = 9) -> DataFrame:
    """(id, label, members): how many members of a class have a label after ``rounds`` of ``label_propagation``, where a repository votes with each of its copies.

    ``first(id, top)`` are the best labels where each repository has its own: of a class's members only the first can lead, and it then takes the second best.
    """
    begun = classes.join(first, "id").select("id", "n", F.col("top")[0]["label"].alias("one"), F.get("top", F.lit(1))["label"].alias("two"))
    apart = F.array(F.struct(F.col("one").alias("label"), (F.col("n") - 1).alias("members")), F.struct(F.col("two").alias("label"), F.lit(1).cast("long").alias("members")))
    whole = F.array(F.struct(F.col("one").alias("label"), F.col("n").alias("members")))
    labels = written(begun.select("id", F.explode(F.when(F.col("one") == F.col("id"), apart).otherwise(whole)).alias("l")).select("id", "l.*").where("members > 0"), "labels")
    rows = written(classes.select("id", F.explode("people").alias("owner_login")), "rows")
    for _ in range(rounds - 1):
        held = written(by_person(labels, classes), "held")
        votes = written(held.groupBy("owner_login", "label").agg(F.sum(F.expr("members * copies")).alias("v"), F.lit(0).cast("long").alias("m")), "votes")
        top = best_labels(rows, votes).select("id", "top")
        own = held.join(votes, ["owner_login", "label"]).groupBy("id", "label", "members").agg((F.sum("v") - F.max(F.expr("people * copies"))).alias("own"))
        other = F.get(F.filter("top", lambda t: t.label != F.col("label")), F.lit(0))
        new = F.when(-other["s"] > F.col("own"), other["label"]).otherwise(F.col("label"))
        told = written(own.join(top, "id").select("id", "label", new.alias("new"), "members"), "told")
        removed(held, votes)
        if told.where("new <> label").isEmpty():
            removed(told)
            break
        moved = written(told.groupBy("id", F.col("new").alias("label")).agg(F.sum("members").alias("members")), "labels")
        removed(told, labels)
        labels = moved
    removed(rows)
    return labels


def fold_stats(links: DataFrame, nodes: DataFrame, rounds: int = 9) -> DataFrame:
    """``net_stats`` of the fold of all people of two repositories or more, however many they have, of which no edge is made. ``nodes`` may be counted rows."""
    classes = written(twins(links, nodes), "classes")
    rows = written(classes.select("id", F.explode("people").alias("owner_login")), "rows")
    seconds = F.array(F.struct("id", "n"), F.struct(F.col("second").alias("id"), F.lit(0).cast("long").alias("n")))
    votes = written(classes.select(F.explode("people").alias("owner_login"), "copies", F.explode(seconds).alias("l")).select("owner_login", F.col("l.id").alias("label"), F.col("copies").alias("v"), F.col("l.n").alias("m")).where("label IS NOT NULL"), "votes")
    first = written(best_labels(rows, votes), "first")
    with_met = classes.join(first, "id").select("id", "n", "copies", (F.col("met") - 1).alias("degree"))
    whole = lambda c: F.coalesce(F.sum(F.expr(c)), F.lit(0)).cast("long")
    sums = with_met.agg(whole("n * copies").alias("nodes"), (whole("n * degree") / 2).cast("long").alias("edges"), whole("n").alias("linked"), F.max("degree").alias("max_degree"))
    least = rows.groupBy("owner_login").agg(F.min("id").alias("dst"))
    stars = rows.join(least, "owner_login").select(F.col("id").alias("src"), "dst").where("src <> dst")
    reached = component_labels(classes, stars).join(classes.select("id", "n"), "id").groupBy("component").agg(F.sum("n").alias("n"))
    components = reached.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    sizes = class_labels(classes, first, rounds).join(classes.select("id", "copies"), "id").groupBy("label").agg(F.sum(F.expr("members * copies")).alias("size")).where("size > 1")
    clusters = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest_cluster"))
    return stats_row(sums.crossJoin(components).crossJoin(clusters))
