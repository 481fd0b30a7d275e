"""Filling containers of fixed capacity with texts, by variable-capacity best fit."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.plans.runtime import cut, ship

#: Containers that a shard fills, about; a shard leaves one container partly empty at most.
SHARD_CONTAINERS = 512
#: What a container costs besides its length: so many tokens for itself, and for each of its tokens the
#: part of the length that attention looks back over, of the full capacity's, times this.
OPENING, ATTENTION = 64, 0.25
#: Items that a length is tried with before it is chosen.
LOOK_AHEAD = 8


def lengths(capacity: int) -> list[int]:
    """The permitted container lengths: the eighths of the capacity."""
    return sorted({max(1, capacity * k // 8) for k in range(1, 9)})


def cost(length: int, capacity: int) -> float:
    """What a container of that length costs, in tokens."""
    return OPENING + length * (1 + ATTENTION * length / capacity)


def best_fit(sizes: list[int], permitted: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Container number and offset of every item, and the final length of every container.

    The items come in decreasing order.  Each goes into the open container that it
    leaves the least room in.  Where it fits in none, all permitted lengths that hold it are weighed against
    each other: each is filled, on trial, with the largest remaining items that fit (``LOOK_AHEAD`` of them, then
    by what is left), and the one is opened that costs least for each token so placed, of equal ones the longest.
    In the end every container is cut to the shortest permitted length that holds its contents.
    """
    largest = permitted[-1]
    price = {c: cost(c, largest) for c in permitted}
    room: list[list[int]] = [[] for _ in range(largest + 1)]
    some = 0
    fill: list[int] = []
    container, offset = [0] * len(sizes), [0] * len(sizes)
    rest = sum(sizes)
    # how many items of each size remain, and which sizes do, as bits
    many = [0] * (largest + 1)
    for size in sizes:
        many[size] += 1
    remain = sum(1 << size for size in set(sizes) if size)

    def trial(first: int, length: int) -> int:
        """Tokens that a container of that length is filled with, begun with an item."""
        used: dict[int, int] = {first: 1}
        left, placed = length - first, first
        for _ in range(LOOK_AHEAD):
            below = remain & ((2 << left) - 1)
            size = below.bit_length() - 1
            while size > 0 and used.get(size, 0) >= many[size]:
                below &= (1 << size) - 1
                size = below.bit_length() - 1
            if size <= 0:
                return placed
            used[size] = used.get(size, 0) + 1
            left, placed = left - size, placed + size
        return min(placed + left, rest)

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            able = permitted[bisect_left(permitted, size) :]
            length = min(able, key=lambda c: (price[c] / max(1, trial(size, c)), -c))
            at, left = len(fill), length
            fill.append(0)
        container[i], offset[i] = at, fill[at]
        fill[at] += size
        left -= size
        room[left].append(at)
        some |= 1 << left
        rest -= size
        many[size] -= 1
        if not many[size]:
            remain &= ~(1 << size)
    return container, offset, [permitted[bisect_left(permitted, max(1, f))] for f in fill]


def least_cost(sizes: list[int], permitted: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest best fit: with all permitted lengths, with those above half the capacity, and with the capacity alone.

    Short lengths save attention where short items remain to fill them; where all items are long they would stay
    partly empty.
    """
    largest = permitted[-1]
    made = [best_fit(sizes, lengths) for lengths in (permitted, [c for c in permitted if 2 * c > largest], [largest])]
    final = [[permitted[bisect_left(permitted, c)] for c in lengths] for _, _, lengths in made]
    best = min(range(3), key=lambda k: sum(cost(c, largest) for c in final[k]))
    return made[best][0], made[best][1], final[best]


def containers(counts: DataFrame, capacity: int, shard_containers: int = SHARD_CONTAINERS) -> DataFrame:
    """Assignment of all texts: ``doc_id``, ``part``, ``parts``, ``first_token``, ``tokens``, ``container``, ``offset``, ``length``.

    ``counts`` has ``doc_id`` and ``n_tokens``.  A text of more than ``capacity`` tokens is cut
    into parts of the capacity and a rest, any other is one part; texts without tokens
    (null, empty) take no room but are assigned as well.  The parts are dealt to shards
    of bounded size by a hash and packed shard by shard, so no task sees more than its
    shard.  ``container`` is unique over all shards.
    """
    spark = counts.sparkSession
    ship(spark)
    counts = cut(counts)
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    rows = counts.count()
    shards = max(1, round(total / (capacity * shard_containers)), round(rows / 200_000))
    n = F.col("n_tokens")
    parts = counts.select("doc_id", n, F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int").alias("parts"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = parts.select(
        "doc_id", "part", "parts", (F.col("part").cast("bigint") * capacity).alias("first_token"), F.least(F.lit(capacity), n - F.col("part").cast("bigint") * capacity).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int").alias("shard"),
    )
    permitted = lengths(capacity)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        at, offset, final = least_cost(rows["tokens"].tolist(), permitted)
        shard = int(rows["shard"].iloc[0])
        return rows.drop(columns="shard").assign(container=[shard << 32 | a for a in at], offset=offset, length=[final[a] for a in at])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return parts.groupBy("shard").applyInPandas(pack, f"doc_id {kind}, part int, parts int, first_token bigint, tokens int, container bigint, offset int, length int")
