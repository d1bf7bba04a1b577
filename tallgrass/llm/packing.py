"""Problem 3: put items of varying length into containers of fixed capacity.

Method: first-fit decreasing with a tournament tree over the room left in each container, run
independently in randomised groups of about ``GROUP`` items.  The groups are hash groups of the
key, so no group grows with the data and no lengths cluster; each group wastes at most part of
its last containers.

Defined results: a null length is no item; a length of 0 or less needs no room and goes to the
first container of its group; only an item longer than the capacity is divided, into full
containers and one remainder that is packed like any item; repeated rows are items of their
own.  Ties in length go by key.  Empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 4096
#: pack_bins rows that are broadcast at most; more are joined by shuffle.
BINS = 10_000


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each size, for sizes in descending order, none above ``capacity``."""
    leaves = 1
    tree = [capacity] * 2  # tree[k] is the largest room under node k
    out = []
    for s in sizes:
        if tree[1] < s:  # nothing has room: twice the containers
            leaves *= 2
            level = [capacity if k >= leaves // 2 else tree[leaves // 2 + k] for k in range(leaves)]
            tree = [0] * leaves + level
            for k in range(leaves - 1, 0, -1):
                tree[k] = max(tree[2 * k], tree[2 * k + 1])
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < s:
                k += 1
        out.append(k - leaves)
        tree[k] -= s
        k //= 2
        while k:
            m = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == m:
                break
            tree[k] = m
            k //= 2
    return out


def pack_group(g: pd.DataFrame, key: str) -> pd.DataFrame:
    """Pieces and containers of one group (all rows share a bin)."""
    cap = int(g["capacity"].iat[0])
    n = np.maximum(g["_len"].to_numpy(np.int64), 0)
    keys = g[key].to_numpy()
    whole = np.where(n > cap, n // cap, 0)
    rest = n - whole * cap
    parts = whole + ((rest > 0) | (whole == 0))
    last = np.flatnonzero((rest > 0) | (whole == 0))
    last = last[np.lexsort((keys[last], -rest[last]))]
    at = np.array(first_fit(rest[last].tolist(), cap), np.int64)
    used = int(at.max(initial=-1)) + 1
    own = np.repeat(np.arange(len(n)), whole)  # full containers, one for each whole piece
    part = np.arange(len(own)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = pd.DataFrame({
        "length": np.concatenate([rest[last], np.full(len(own), cap)]), key: np.concatenate([keys[last], keys[own]]), "part": np.concatenate([whole[last], part]),
        "parts": np.concatenate([parts[last], parts[own]]), "container": np.concatenate([at, used + np.arange(len(own))]),
    })
    out["bin_id"], out["capacity"], out["grp"] = g["bin_id"].iat[0], cap, g["_grp"].iat[0]
    return out[["bin_id", key, "part", "parts", "length", "grp", "container", "capacity"]]


def pack(corpus: DataFrame, bins: DataFrame, *, key: str = "scan_idx", fields: tuple[str, ...] = ("template_tokens", "trace_chars"), seed: int = 42) -> DataFrame:
    """``(bin_id, key, part, parts, length, grp, container, capacity)``, a row per piece.

    A container is named by ``(bin_id, grp, container)``.  The corpus is scanned for the key and
    the length fields only; what is shuffled is those numbers.
    """
    rows = corpus.count()
    groups = max(1, math.ceil(rows / GROUP))
    bins = bins.select("bin_id", "item_field", "capacity").where("capacity > 0")
    if bins.count() <= BINS:
        bins = F.broadcast(bins)
    each = F.array(*[F.struct(F.lit(f).alias("item_field"), corpus[f].cast("bigint").alias("_len")) for f in fields])
    items = corpus.select(corpus[key], F.pmod(F.xxhash64(F.lit(seed), corpus[key]), F.lit(groups)).alias("_grp"), F.explode(each).alias("i"))
    items = items.select(key, "_grp", "i.*").where("_len is not null").join(bins, "item_field")
    kind = corpus.schema[key].dataType.simpleString()
    return items.groupBy("bin_id", "_grp").applyInPandas(lambda g: pack_group(g, key), f"bin_id int, `{key}` {kind}, part int, parts int, length bigint, grp bigint, container bigint, capacity int")
