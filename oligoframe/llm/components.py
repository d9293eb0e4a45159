"""Connected components with DataFrame operations only: a distributed union-find.

A round hooks every node to the smallest of its neighbours and itself, follows these pointers twice, and then contracts the
links: each end becomes the node that it points to, and what lies inside one node is gone. Links shrink with every round, and
rounds grow with the logarithm of the longest chain. Pointers of a round of up to ``FEW`` links between numbers are broadcast
(counted before, some 12 MB at most); with more, the sides of its joins are shuffled. State is written to the shared folder
each round, so lineage stays short and a lost executor costs no earlier round; a hot node is one row of pointers and its many
links are summed in their tasks first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, release

#: Links of a round, both ways counted, up to which its pointers are broadcast; there are no more pointers than links.
FEW = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that links reach. edges: columns a and b, of one orderable type, in any order.

    Links with a null or to themselves are ignored, repeated ones count once; nodes without other links have no row.
    """
    edges = edges.filter("a <> b")
    links = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    short = isinstance(links.schema["a"].dataType, T.NumericType)
    many, known = links.count(), None
    while True:
        hooked = links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        few = short and many <= FEW

        def pointers(node: str, to: str) -> DataFrame:
            side = hooked.select(F.col("node").alias(node), F.col("to").alias(to))  # noqa: B023
            return F.broadcast(side) if few else side  # noqa: B023

        # A node that nothing hooks to is reached by no pointer; all pointers end at nodes of this round.
        if few:
            ends = hooked = cut(hooked)
            for _ in range(3):
                ends = ends.join(pointers("to", "next"), "to").select("node", F.col("next").alias("to"))
            hooked = cut(ends)
        else:
            for _ in range(2):
                hooked = cut(hooked.join(pointers("to", "next"), "to").select("node", F.col("next").alias("to")))
        if known is None:
            grown = hooked.select("node", F.col("to").alias("root"))
        else:
            grown = cut(known.join(pointers("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        inside = links.join(pointers("a", "to_a"), "a").join(pointers("b", "to_b"), "b").filter("to_a <> to_b")
        contracted = cut(inside.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
        release(links)
        many = contracted.count()
        if many == 0:
            return grown
        links, known = contracted, grown
