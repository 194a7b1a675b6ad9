"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents a shard. Each shard leaves about one container partly filled, so the loss is one container in a few thousand.
SHARD = 40_000
#: Capacities in one run, which are part of the plan; more are refused.
MOST_PACKS = 10_000


class Piece(NamedTuple):
    item: int
    piece: int
    start: int
    size: int
    container: int


class OpenBins:
    """A segment tree over the remaining capacities 0..capacity; a leaf holds the open bins with just that much room.

    Only nodes with bins below them exist, so memory goes by the rooms that occur, not by the capacity.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count: dict[int, int] = {}
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_: int) -> None:
        self.bins.setdefault(room, []).append(bin_)
        count, k = self.count, self.leaves + room
        while k:
            count[k] = count.get(k, 0) + 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the tightest bin with room for `size`: (room, bin), None if there is none."""
        count, k = self.count, self.leaves + size
        if k not in count:
            while k > 1 and (k & 1 or k + 1 not in count):  # up, until a right sibling has bins
                k >>= 1
            if k == 1:
                return None
            k += 1
            while k < self.leaves:
                k *= 2
                if k not in count:
                    k += 1
        room = k - self.leaves
        while k:
            if count[k] == 1:
                del count[k]
            else:
                count[k] -= 1
            k >>= 1
        bins = self.bins[room]
        bin_ = bins.pop()
        if not bins:
            del self.bins[room]
        return room, bin_


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[Piece]:
    """Where each item goes. An item above the capacity gives full containers of its own and a rest that is packed.

    Ties go to the earlier item; items of size 0 take no room but get a container.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    out, parts, n = [], [], 0
    for item, size in enumerate(sizes):
        full, rest = divmod(size, capacity) if size > capacity else (0, size)
        for piece in range(full):
            out.append(Piece(item, piece, piece * capacity, capacity, n))
            n += 1
        if rest or not full:
            parts.append((rest, item, full))
    parts.sort(key=lambda x: (-x[0], x[1]))
    open_ = OpenBins(capacity)
    for size, item, piece in parts:
        found = open_.take(size)
        room, bin_ = found or (capacity, n)
        n += found is None
        open_.add(room - size, bin_)
        out.append(Piece(item, piece, piece * capacity, size, bin_))
    return out


def token_count(text: Column) -> Column:
    """A run of letters and digits is one token, every other visible character is one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long")


_SCHEMA = "pack_name string, container string, doc_id long, piece int, pieces int, start_token long, tokens long"


def pack(docs: DataFrame, packs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Every document in a container of every capacity: pack_name, container, doc_id, piece, pieces, start_token, tokens.

    Documents are dealt to shards by their hash, about `shard` in each however many there are, and each shard is packed
    by best-fit decreasing; only ids and sizes are shuffled. Only documents above the capacity are split.

    n_tokens counts where it is present and not negative, else the tokens of the text; null and empty texts have 0 and
    still get a container. Rows of the same doc_id are one document, of the largest size; rows of null doc_id stay
    documents of their own. Pack rows repeated or without a name or a positive capacity are left out. Empty tables
    give no rows. Other columns are ignored.
    """
    stored = F.when(F.col("n_tokens") >= 0, F.col("n_tokens").cast("long"))
    items = docs.select(F.col("doc_id").cast("long"), F.coalesce(stored, token_count(F.col("text")), F.lit(0)).alias("tokens"))
    wanted = packs.filter("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    # Documents of null id are spread by size; the number of shards comes from a count of the rows.
    n = max(1, -(-docs.count() // shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", F.col("tokens")), F.lit(7)), F.lit(n)).cast("int"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, shard_no = key
        known = pdf[pdf["doc_id"].notna()].groupby("doc_id", as_index=False)["tokens"].max()
        pdf = pd.concat([known, pdf.loc[pdf["doc_id"].isna(), ["doc_id", "tokens"]]], ignore_index=True)
        ids = pdf["doc_id"].astype("Int64")
        done = pd.DataFrame(best_fit_decreasing(pdf["tokens"].astype(int).tolist(), int(capacity)), columns=Piece._fields)
        return pd.DataFrame(
            {
                "pack_name": name,
                "container": f"{name}-{shard_no}-" + done["container"].astype(str),
                "doc_id": ids.take(done["item"]).reset_index(drop=True),
                "piece": done["piece"],
                "pieces": done.groupby("item")["piece"].transform("count"),
                "start_token": done["start"],
                "tokens": done["size"],
            }
        )

    asked = wanted.orderBy("pack_name").take(MOST_PACKS + 1)
    if len(asked) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    text = json.dumps([{"pack_name": r["pack_name"], "capacity": r["capacity"]} for r in asked])
    listed = F.from_json(F.lit(text), "array<struct<pack_name:string,capacity:bigint>>")
    each = dealt.select("doc_id", "tokens", "shard", F.explode(listed).alias("p")).select("p.*", "doc_id", "tokens", "shard")
    return each.groupBy("pack_name", "capacity", "shard").applyInPandas(fill, _SCHEMA)
