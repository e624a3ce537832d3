"""Connected components of (node, key) rows: nodes that have a key in common are connected.

Each round gives every label the least rank that it meets through any of its keys, as two grouped minima, and then
contracts: labels that moved are replaced, equal (label, key) rows become one, and keys that only one label has are
dropped. A group of nodes that share all their keys is one label after the first round, so no join ever makes more rows
than there are (label, key) rows, and no list of pairs or of edges of a group is made. The rank is the label with some
bits flipped, others in every round: of two neighbours either is the lesser half of the time, so half of the labels
that still have neighbours are expected to go in each round, whatever the shape of the graph.

Rows with a null node or key connect nothing; repeated rows count once; ties can't occur, as ranks of different labels
differ; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, stored


def connected_components(members: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``members`` (node, key; both longs) that share a key with another one.
    component is one of the component's nodes. Each round is written to the shared folder; the rounds' moves shrink and
    are put together at the end."""
    rows, moved = members.select(F.col("node").alias("label"), "key").dropna().distinct(), []
    state = None
    while True:
        flips = F.lit(xxhash.xxh3_64_intdigest(f"round {len(moved)}") - 2**63)
        rank = F.col("label").bitwiseXOR(flips)
        least = rows.groupBy("key").agg(F.min(rank).alias("least"), F.max(rank).alias("most")).where("least <> most").drop("most")
        before, state = state, stored(rows.join(least, "key"), "members")
        to = F.min("least").bitwiseXOR(flips)
        moves = stored(state.groupBy("label").agg(to.alias("to")).where("label <> to"), "moves")
        if moves.isEmpty():
            break
        further = moves.select(F.col("label").alias("to"), F.col("to").alias("then"))
        for _ in range(2):  # a label that moved to one that moved as well goes along
            moves = moves.join(further, "to", "left").select("label", F.coalesce("then", "to").alias("to"))
        moves = stored(moves, "moves")
        moved.append(moves)
        rows = state.select("label", "key").join(moves, "label", "left").select(F.coalesce("to", "label").alias("label"), "key").distinct()
        discarded(before)
    discarded(before)
    discarded(state)
    if not moved:
        return moves.select(F.col("label").alias("node"), F.col("to").alias("component"))
    total = moved.pop()
    while moved:
        onward = total.select(F.col("label").alias("to"), F.col("to").alias("then"))
        total = moved.pop().join(onward, "to", "left").select("label", F.coalesce("then", "to").alias("to")).unionByName(total).distinct()
    # a label can move, come back with rows of others and stay: it is its own component
    total = stored(total.where("label <> to"), "components")
    return total.select(F.col("label").alias("node"), F.col("to").alias("component")).unionByName(total.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
