"""The most relevant other pages of every page, over all pages and not only over linked ones.

The relevance of two pages adds 3 for each direction of a link, 4.5 for each
direction of a related item, 4 for each shared source, 1.5 / ln(degree) for each
common neighbour, and the affinity of their types. All pairs are never made:

* Sources and neighbours are features with lists of the pages that have them. A
  list of at most ``hub`` pages is joined with itself, so those rows are at most
  ``hub`` times the features. Links and related items are added to the same sum.
* Longer lists are hubs and are not expanded. Pages with the same hubs and type
  are alike as far as hubs go, so they form a class, of which the first few pages
  by id stand for all. A class's hubs are ordered by how many classes have them,
  rarest first. What the last ones can add at most is known: as soon as that is
  below the k-th best relevance that every page of the class already has, they are
  left out. Only the others are joined, class with class. The most frequent hub is
  not joined even then: pages that share no other hub have the same relevance but
  for their type, so the first few of each type are enough.
* Pages that share nothing have the affinity of their types, for which the first
  few of each type are enough, too.

Every relevance that reaches the result is the whole sum. Should pages differ in
their hubs and have them in random mixtures, classes are as many as pages and the
bound alone limits the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.operators.graph import AFFINITY, OTHER_AFFINITY, TYPES, affinity, link_counts
from lexaloom.session import cut_statistics

LINK, LISTED, SOURCE, NEIGHBOUR = 3.0, 4.5, 4.0, 1.5
#: Decimal places of a relevance; sums in another order are then equal.
PLACES = 6


def features(edges: DataFrame, related: DataFrame, sources: DataFrame) -> DataFrame:
    """node, feature (its kind and key), weight and n (pages that have it), for features of two pages or more."""
    near = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(related.select("src", "dst")).distinct()
    degree = link_counts(edges).select(F.col("node").alias("dst"), F.col("n_links").cast("double").alias("degree"))
    weight = F.lit(NEIGHBOUR) / F.log(F.greatest(F.coalesce("degree", F.lit(0.0)), F.lit(2.0)))
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")).alias("feature")
    both = near.join(degree, "dst", "left").select(F.col("src").alias("node"), named("neighbour", "dst"), weight.alias("weight")).unionByName(
        sources.select("id", "source").where("id IS NOT NULL AND source IS NOT NULL").distinct().select(F.col("id").alias("node"), named("source", "source"), F.lit(SOURCE).alias("weight"))
    )
    sizes = both.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return both.join(sizes, "feature")


def _most(kind: Column) -> Column:
    """The largest affinity that a type has with any."""
    rows = [F.when(kind == t, F.lit(max(*row, OTHER_AFFINITY))) for t, row in zip(TYPES, AFFINITY, strict=True)]
    return F.coalesce(*rows, F.lit(OTHER_AFFINITY))


def _shared(a: str, b: str) -> Column:
    """The weights of the hubs that two arrays share."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, h: s + h["weight"])


def _first(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; rows are cut in the tasks before they are dealt out."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).drop("place")


def _rated(df: DataFrame) -> DataFrame:
    return df.withColumn("relevance", F.round("relevance", PLACES))


def met_pairs(found: DataFrame, about: DataFrame, edges: DataFrame, related: DataFrame, hub: int) -> DataFrame:
    """node, other and relevance of pages that share a list of at most hub pages, a link or a related item, in both directions."""
    rare = found.where(F.col("n") <= hub)
    met = rare.select("feature", F.col("node").alias("a"), "weight").join(rare.select("feature", F.col("node").alias("b")), "feature").where("a < b").select("a", "b", "weight")
    said = lambda t, w: t.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(w).alias("weight"))
    sums = met.unionByName(said(edges, LINK)).unionByName(said(related, LISTED)).groupBy("a", "b").agg(F.sum("weight").alias("own"))
    end = lambda c: about.select(F.col("id").alias(c), F.col("type").alias(f"type_{c}"), F.col("hubs").alias(f"hubs_{c}"))
    both = sums.join(end("a"), "a").join(end("b"), "b").withColumn("own", F.col("own") + _shared("hubs_a", "hubs_b"))
    side = lambda a, b: both.select(F.col(a).alias("node"), F.col(b).alias("other"), (F.col("own") + affinity(F.col(f"type_{a}"), F.col(f"type_{b}"))).alias("relevance"))
    return _rated(side("a", "b").unionByName(side("b", "a")))


def _by_type(about: DataFrame, k: int) -> DataFrame:
    """type, other and relevance: for each type the k + 1 pages of highest affinity, by id."""
    first = _first(about.select("id", "type"), ["type"], ["id"], k + 1)
    pairs = first.select(F.col("type").alias("type_b"), F.col("id").alias("other"), F.explode(F.array(*map(F.lit, [*TYPES, ""]))).alias("type"))
    rated = _rated(pairs.select("type", "other", affinity(F.col("type"), F.col("type_b")).alias("relevance")))
    return _first(rated, ["type"], [F.desc("relevance"), "other"], k + 1)


def _by_hubs(about: DataFrame, floor: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The classes (class, hubs, type), and the candidates (class, other, relevance) that a class's hubs give.

    floor: id and the k-th best relevance that the page already has.
    """
    with_hubs = about.where(F.size("hubs") > 0)
    reps = _first(with_hubs, ["hubs", "type"], ["id"], k + 1).groupBy("hubs", "type").agg(F.array_sort(F.collect_list("id")).alias("reps"))
    least = with_hubs.join(floor, "id", "left").groupBy("hubs", "type").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("floor"))
    classes = cut_statistics(reps.join(least, ["hubs", "type"]).withColumn("class", F.monotonically_increasing_id()))
    spread = classes.select("class", "type", "floor", F.explode("hubs").alias("hub"))
    often = spread.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("class").orderBy(F.desc("n"), F.desc("hub"))
    placed = spread.join(often, "hub").withColumns({"rest": F.sum(F.col("hub")["weight"]).over(order), "last": F.row_number().over(order) == 1})
    # rest: what this hub and all more frequent ones can add
    asked = placed.where(~F.col("last") & (F.col("rest") + _most(F.col("type")) + 2 * 10.0**-PLACES >= F.col("floor"))).select("class", "hub")
    pairs = asked.join(spread.select("hub", F.col("class").alias("class_b")), "hub").select("class", "class_b").distinct()
    pairs = pairs.join(classes.select("class", "hubs", "type"), "class").join(
        classes.select(F.col("class").alias("class_b"), F.col("hubs").alias("hubs_b"), F.col("type").alias("type_b"), "reps"), "class_b"
    )
    pairs = _rated(pairs.select("class", "reps", (_shared("hubs", "hubs_b") + affinity(F.col("type"), F.col("type_b"))).alias("relevance")))
    best = _first(pairs, ["class"], [F.desc("relevance"), F.get("reps", F.lit(0))], k + 1)
    joined = best.select("class", F.explode("reps").alias("other"), "relevance")
    members = classes.select(F.col("type").alias("type_b"), "reps", F.explode("hubs").alias("hub")).select("hub", "type_b", F.explode("reps").alias("other"))
    members = _first(members, ["hub", "type_b"], ["other"], k + 1)
    alone = placed.where("last").join(members, "hub")
    alone = _rated(alone.select("class", "other", (F.col("hub")["weight"] + affinity(F.col("type"), F.col("type_b"))).alias("relevance")))
    return classes.select("class", "hubs", "type"), _first(joined.unionByName(alone).groupBy("class", "other").agg(F.max("relevance").alias("relevance")), ["class"], [F.desc("relevance"), "other"], k + 1)


def related_pages(nodes: DataFrame, edges: DataFrame, related: DataFrame, sources: DataFrame, k: int = 5, hub: int = 64) -> DataFrame:
    """node, other, relevance (rounded to PLACES) and rank of the k most relevant other pages of each page.

    nodes: id (distinct), type; edges and related: distinct src, dst, both of
    them nodes; sources: id, source. Ties go to the smaller id. Every page has k
    rows, or as many as there are other pages; a null type is none of the named.
    """
    nodes = nodes.where("id IS NOT NULL").select("id", F.when(F.col("type").isin(TYPES), F.col("type")).otherwise("").alias("type"))
    edges, related = cut_statistics(edges.select("src", "dst")), cut_statistics(related.select("src", "dst"))
    found = cut_statistics(features(edges, related, sources))
    hubs = found.where(F.col("n") > hub).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("feature", "weight"))).alias("hubs"))
    about = nodes.join(hubs.withColumnRenamed("node", "id"), "id", "left").withColumn("hubs", F.coalesce("hubs", F.array().cast(hubs.schema["hubs"].dataType)))
    about = cut_statistics(about)
    met = cut_statistics(_first(met_pairs(found, about, edges, related, hub), ["node"], [F.desc("relevance"), "other"], k))
    counted = Window.partitionBy("node")
    floor = met.withColumn("n", F.count(F.lit(1)).over(counted)).where(F.col("n") == k).groupBy(F.col("node").alias("id")).agg(F.min("relevance").alias("floor"))
    classes, by_hubs = _by_hubs(about, floor, k)
    of_class = about.where(F.size("hubs") > 0).join(classes, ["hubs", "type"]).select(F.col("id").alias("node"), "class").join(by_hubs, "class")
    of_type = about.select(F.col("id").alias("node"), "type").join(F.broadcast(_by_type(about, k)), "type")
    every = met.unionByName(of_class.select("node", "other", "relevance")).unionByName(of_type.select("node", "other", "relevance")).where("node <> other")
    every = every.groupBy("node", "other").agg(F.max("relevance").alias("relevance"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("relevance"), "other"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("node", "other", "relevance", "rank")
