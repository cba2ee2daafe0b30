"""What the search for similar lines and for similar documents share.

Items are known by a 64-bit number ``h1``, equal items being one before the
search. Items that agree in a band are compared with the band's lead; where that leaves items of a band in different components
that were not compared with each other, they are compared too: within a band of
moderate size by their sketches, those of large bands by ``prefix_pairs``. So no
link between items that share a band is lost.

An item's sketch (``size``, ``w0`` ... ``w31``) has at least as many elements as
its set and a bitmap of these. What is in one bitmap and not in the other bounds
the similarity from above, so the sketches never rule out a similar pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.components import connected_components, dealt_anew
from netweave.session import cut, stored

#: Longs of a bitmap, and items of a band up to which all are compared within it.
WORDS, BAND = 32, 1024
#: Rounds in which the items that a lead leaves get another, before all of them are compared.
ROUNDS = 2
#: Slack of comparisons with a similarity, which no two ratios of set sizes come near.
SLACK = 1e-9


def led(banded: DataFrame) -> DataFrame:
    """(band, h1) of the bands with two items or more. A band that very many
    items share is split by adaptive execution: bands are found by partial
    minima and maxima and joined to the items."""
    shared = banded.groupBy("band").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low != high")
    return banded.join(dealt_anew(shared.select("band"), "band"), "band", "left_semi")


def starred(members: DataFrame) -> DataFrame:
    """(band, src, dst) of (band, h1): every item of a band with the band's
    lead, the item that meets most others in all its bands. Of the copies of a
    text, each with edits of its own, that is the one that the others are nearest
    to."""
    sizes = members.groupBy("band").agg(F.count("*").alias("items"))
    meets = members.join(dealt_anew(sizes, "band"), "band").groupBy("h1").agg(F.sum("items").alias("meets"))
    weighed = members.join(dealt_anew(meets, "h1"), "h1")
    leads = weighed.groupBy("band").agg(F.max(F.struct("meets", "h1"))["h1"].alias("lead"))
    return weighed.join(dealt_anew(leads, "band"), "band").filter("h1 != lead").select("band", F.col("h1").alias("src"), F.col("lead").alias("dst"))


def rooted(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """(src, dst, src_root, dst_root) of pairs."""
    for end in ("src", "dst"):
        known = dealt_anew(reached, "node").toDF(end, f"{end}_root")
        pairs = pairs.join(known, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs


def extended(reached: DataFrame, links: DataFrame) -> DataFrame:
    """reached, (node, component), with the components that links join as one:
    only the graph of the components is searched."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = cut(ends.join(reached, "node", "full").select("node", F.coalesce("component", "node").alias("component")))
    between = rooted(links, known).filter("src_root != dst_root").select("src_root", "dst_root")
    joined = connected_components(between, "src_root", "dst_root").toDF("component", "root")
    return cut(known.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def sketch() -> list[Column]:
    """Aggregates of ``element`` that make a bitmap."""
    word, bit = F.col("element").bitwiseAND(F.lit(WORDS - 1)), F.shiftrightunsigned("element", 5).bitwiseAND(F.lit(63)).cast("int")
    return [F.bit_or(F.when(word == k, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]


def _sketched(end: str) -> list[Column]:
    return [F.col("h1").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("size", *(f"w{k}" for k in range(WORDS)))]]


def _possible(similarity: float) -> Column:
    """Whether the sketches of src and dst allow the similarity: sets are that
    similar if what only one of them has is no more than a part of their sizes,
    and it is at least as much as the bits that differ. Half of the words rule
    most pairs out."""
    differ = lambda words: reduce(Column.__add__, [F.bit_count(F.col(f"src_w{k}").bitwiseXOR(F.col(f"dst_w{k}"))) for k in words])
    most = (F.col("src_size") + F.col("dst_size")) * ((1 - similarity) / (1 + similarity)) + SLACK
    return (differ(range(WORDS // 2)) <= most) & (differ(range(WORDS)) <= most)


def left_over(members: DataFrame, reached: DataFrame) -> DataFrame:
    """(band, h1) of the items that are not in the component of their band's
    lead, in bands where these are in different components."""
    apart = rooted(members, reached).filter("src_root != dst_root").select("band", F.col("src").alias("h1"), F.col("src_root").alias("root"))
    bands = apart.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("band")
    return apart.join(dealt_anew(bands, "band"), "band", "left_semi").select("band", "h1")


def unsure(members: DataFrame, reached: DataFrame) -> DataFrame:
    """(band, h1, root, items) of the bands in which items that only their lead
    was compared with are in different components."""
    known = dealt_anew(reached, "node").toDF("src", "root")
    known = members.select("band", "src").join(known, "src", "left").select("band", F.col("src").alias("h1"), F.coalesce("root", "src").alias("root"))
    bands = known.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("items")).filter("low != high")
    return known.join(dealt_anew(bands.select("band", "items"), "band"), "band")


def band_pairs(rows: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, src_root, dst_root) of (band, h1, root): the pairs of a band and
    of different roots whose sketches allow the similarity; only these leave the
    join."""
    rows = rows.join(sketches, "h1")
    one, two = (rows.select(F.col("band").alias(f"{end}_band"), F.col("root").alias(f"{end}_root"), *_sketched(end)) for end in ("src", "dst"))
    met = one.join(two, (F.col("src_band") == F.col("dst_band")) & (F.col("src_root") != F.col("dst_root")) & (F.col("src") > F.col("dst")) & _possible(similarity))
    return met.select("src", "dst", "src_root", "dst_root").distinct()


def prefix_pairs(elements: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, src_root, dst_root) of (h1, root, element), items and the
    elements of their sets: all pairs of different roots whose Jaccard similarity
    can be that high.

    A set's elements are ranked from the rarest on. Similar sets share one of
    the first ``(1 - similarity) n + 1`` of theirs; at the first that they share,
    what follows in both sets bounds what they have in common. So items that
    have a passage in common, and little else, do not meet, however many they
    are. Elements of items of one root make no pairs."""
    frequency = elements.groupBy("element").count()
    ranked = elements.join(dealt_anew(frequency, "element"), "element").groupBy("h1", "root").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.least(F.size("ranked"), F.floor((1 - similarity) * F.size("ranked") + SLACK).cast("int") + 1))
    prefixes = stored(ranked.select("h1", "root", F.size("ranked").alias("n"), F.posexplode(first).alias("at", "ranked")).select("h1", "root", "n", "at", "ranked.element"), "prefixes")
    shared = prefixes.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("element")
    prefixes = prefixes.join(dealt_anew(shared, "element"), "element", "left_semi")
    one, two = (prefixes.select("element", *[F.col(c).alias(f"{end}_{c}") for c in ("h1", "root", "n", "at")]) for end in ("src", "dst"))
    bound = F.least(F.col("src_n") - F.col("src_at"), F.col("dst_n") - F.col("dst_at"))
    possible = bound * (1 + similarity) + SLACK >= similarity * (F.col("src_n") + F.col("dst_n"))
    met = one.join(two, (one["element"] == two["element"]) & (F.col("src_root") != F.col("dst_root")) & (F.col("src_h1") > F.col("dst_h1")) & possible)
    return met.select(F.col("src_h1").alias("src"), F.col("dst_h1").alias("dst"), "src_root", "dst_root").distinct()


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, column: str, set_of: Callable[[Column], Column], similarity: float) -> DataFrame:
    """The pairs (src, dst) whose sets' Jaccard similarity is at least that;
    set_of makes a set of what texts (h1, column) has. The sketches rule most
    others out before texts are fetched."""
    for end in ("src", "dst"):
        pairs = pairs.join(sketches.select(*_sketched(end)), end)
    pairs = pairs.filter(_possible(similarity)).select("src", "dst")
    for end in ("src", "dst"):
        pairs = pairs.join(texts.select(F.col("h1").alias(end), F.col(column).alias(f"{end}_set")), end)
    sets = F.array(F.struct(set_of(F.col("src_set")).alias("one"), set_of(F.col("dst_set")).alias("two")))  # made once, whatever is asked of them
    alike = F.exists(sets, lambda s: F.size(F.array_intersect(s["one"], s["two"])) + SLACK >= similarity * F.size(F.array_union(s["one"], s["two"])))
    return pairs.filter(alike).select("src", "dst")


def components(members: DataFrame, sketches: DataFrame, texts: DataFrame, column: str, set_of: Callable[[Column], Column], elements: Callable[[DataFrame], DataFrame], similarity: float, band: int = BAND, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of the items that are linked to some other.

    members: what led gives. So many rounds more compare the items that are
    apart from their band's lead with a lead of their own. elements: (h1, root, element) of (h1, root). Of the
    candidates between two components one is verified first, the others where
    that leaves the components apart."""

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(verified(pairs, sketches, texts, column, set_of, similarity), "links")

    members = stored(starred(members), "starred")
    reached = connected_components(linked(members.select("src", "dst").distinct()))
    left = members
    for _ in range(rounds):
        left = stored(starred(left_over(left, reached)), "starred")
        reached = extended(reached, linked(rooted(left.select("src", "dst").distinct(), reached).filter("src_root != dst_root").select("src", "dst")))
    rest = stored(unsure(members, reached), "unsure")
    pairs = band_pairs(rest.filter(F.col("items") <= band), sketches, similarity)
    large = rest.filter(F.col("items") > band).select("h1", "root").distinct()
    pairs = stored(pairs.union(prefix_pairs(stored(elements(large), "elements"), similarity)), "candidates")
    one_of_two = pairs.groupBy("src_root", "dst_root").agg(F.min(F.struct("src", "dst")).alias("pair")).select("pair.*")
    reached = extended(reached, linked(one_of_two))
    return extended(reached, linked(rooted(pairs.select("src", "dst").distinct(), reached).filter("src_root != dst_root").select("src", "dst")))
