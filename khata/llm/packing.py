"""Problem 8: filling containers of fixed capacity.

A configuration linear program over the histogram of lengths is solved by
multiplicative weights: each round prices the lengths, finds the best filling of a
container by a knapsack dynamic program, and lowers the weights of the lengths it
serves. A round serves at least an even part of what is left, or all that is left of
one of its lengths, so the program covers the whole demand after a number of rounds
that follows the capacity only. The fractional solution is rounded down; what that
leaves over is placed first-fit by falling length. All of that depends on the
capacity, not on the number of items. The items then take the places of their length
by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.llm import tokens
from khata.session import written

CAPACITY = 2048
#: Lengths are rounded up to multiples of this in the program; 1 wastes nothing.
GRAIN = 1
#: Share of the scarcest length that a round serves, and the rounds that the demand is spread over; the program goes on until all is covered.
STEP, ROUNDS = 0.34, 1000
#: Fillings that are served from one table of the dynamic program at most, and how far below the best one they may be worth.
FROM_ONE, SLACK = 16, 0.003
#: Items that one ranking task takes of one length.
PER_TASK = 500_000


def _fillings_of(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack over `sizes` (rising): the highest price of each capacity, and which size is put in last there (-1 for none)."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fit[c]
        gain = value[c - sizes[:n]] + price[:n]
        k = int(gain.argmax())
        if gain[k] > value[c - 1]:
            value[c], last[c] = gain[k], k
        else:
            value[c] = value[c - 1]
    return value, last


def _traced(sizes: np.ndarray, last: np.ndarray, capacity: int, first: int) -> np.ndarray:
    """How often each size stands in the best filling that holds size number `first`."""
    counts = np.zeros(len(sizes), np.int64)
    counts[first] = 1
    c = capacity - int(sizes[first])
    while c > 0:
        k = last[c]
        if k >= 0:
            counts[k] += 1
            c -= int(sizes[k])
        else:
            c -= 1
    return counts


def fillings(demand: np.ndarray, capacity: int, step: float = STEP, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """A fractional cover of the whole demand: (how often each size, how many containers). demand[s] items have size s (0..capacity)."""
    sizes = np.flatnonzero(demand)
    need = demand[sizes].astype(float)
    left = need.copy()
    price = sizes / capacity
    found: dict[bytes, list] = {}
    done = 0
    while len(open_ := np.flatnonzero(left > 1e-9)):
        value, last = _fillings_of(sizes[open_], price[open_], capacity)
        worth = price[open_] + value[capacity - sizes[open_]]
        # each size with the best that goes with it is a filling; those about as good as the best are served from one table
        order = np.argsort(-worth, kind="stable")[:FROM_ONE]
        for first in order[worth[order] >= (1 - SLACK) * worth[order[0]]]:
            own = _traced(sizes[open_], last, capacity, int(first))
            used = np.flatnonzero(own)
            counts, at = own[used], open_[used]
            if (left[at] <= 1e-9).any():
                continue
            even = float(left @ sizes) / capacity / max(1, rounds - done)
            served = min(float(np.min(left[at] / counts)), max(1.0, even, step * float(np.min(need[at] / counts))))
            whole = np.zeros(len(sizes), np.int64)
            whole[at] = counts
            known = found.setdefault(whole.tobytes(), [whole, 0.0])
            known[1] += served
            left[at] -= served * counts
            price[at] *= np.exp(-step * served * counts / need[at])
            done += 1
    out = []
    for counts, x in found.values():
        whole = np.zeros(capacity + 1, np.int64)
        whole[sizes] = counts
        out.append((whole, x))
    return out


def least_containers(demand: np.ndarray, capacity: int) -> int:
    """A lower bound on the containers: the space that all items need, and the number of items of more than half a container."""
    sizes = np.arange(len(demand))
    return max(-(-int(demand @ sizes) // capacity), int(demand[2 * sizes > capacity].sum()))


def left_to_rounding(demand: np.ndarray, capacity: int) -> float:
    """The share of the space that the program's containers, rounded down, leave to first-fit."""
    total = float(demand @ np.arange(len(demand)))
    placed = sum(int(x + 1e-6) * float(counts @ np.arange(capacity + 1)) for counts, x in fillings(demand, capacity))
    return 1 - placed / total if total else 0.0


def plan(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places for all items by size: arrays (size, first rank, containers, items of that size in each, first container), sorted by the first two."""
    left = demand.astype(np.int64).copy()
    rows: list[tuple[int, int, int, int]] = []  # size, containers, times, first container
    n = 0
    for counts, x in sorted(fillings(demand, capacity), key=lambda f: -f[1]):
        used = np.flatnonzero(counts)
        many = min(int(x + 1e-6), int(np.min(left[used] // counts[used])))
        if many > 0:
            rows += [(int(s), many, int(counts[s]), n) for s in used]
            left[used] -= many * counts[used]
            n += many
    # the rest: first fit by falling size, equal containers kept as one with a count
    open_: list[list] = []  # room, how many alike, {size: times}
    for s in np.flatnonzero(left)[::-1]:
        s, many = int(s), int(left[s])
        for bin_ in sorted(open_, key=lambda b: b[0]):
            fit = bin_[0] // s
            if not fit or not many:
                continue
            alike, rest = divmod(many, fit)
            take = min(alike, bin_[1])
            if take:
                if take < bin_[1]:
                    open_.append([bin_[0], bin_[1] - take, dict(bin_[2])])
                    bin_[1] = take
                bin_[0] -= fit * s
                bin_[2][s] = fit
                many -= take * fit
            elif rest:
                if bin_[1] > 1:
                    open_.append([bin_[0], bin_[1] - 1, dict(bin_[2])])
                    bin_[1] = 1
                bin_[0] -= rest * s
                bin_[2][s] = rest
                many -= rest
        if many:
            fit = capacity // s
            whole, rest = divmod(many, fit)
            if whole:
                open_.append([capacity - fit * s, whole, {s: fit}])
            if rest:
                open_.append([capacity - rest * s, 1, {s: rest}])
    for _, alike, content in open_:
        rows += [(s, alike, times, n) for s, times in content.items()]
        n += alike
    rows.sort(key=lambda r: (r[0], r[3]))
    size, containers, times, first = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    places = containers * times
    before = np.cumsum(places) - places
    start = before - np.repeat(before[np.searchsorted(size, np.unique(size))], np.unique(size, return_counts=True)[1]) if len(size) else before
    return size, start, containers, times, first


def _placer(table: tuple[np.ndarray, ...]):
    size, start, _, times, first = table
    span = int(start.max()) + 1 if len(start) else 1
    order = size * span + start

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(order, own * span + np.minimum(rank, span - 1), "right") - 1
            box = first[at] + (rank - start[at]) // times[at] if len(at) else rank
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("piece"), b.column("n_tokens"), pa.array(box, pa.int64())], names=["id", "piece", "n_tokens", "container"])

    return place


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length_col: str = "n_tokens", grain: int = GRAIN) -> DataFrame:
    """Every item in a container: (`id_col`, piece INT, n_tokens BIGINT, container BIGINT).

    An item longer than `capacity` is cut into consecutive pieces of `capacity` and
    a last one of the rest; piece counts from 0. An item of length 0 or null comes
    out once with n_tokens 0 and a null container. Ties take places by id; repeated
    rows are items of their own. An empty table gives an empty result. `lengths`
    is read several times and should be a written table.
    """
    grain = grain if capacity % grain == 0 else 1
    own = lengths.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("bigint").alias("n"))
    cut = own.where("n > 0").withColumn("piece", F.explode(F.expr(f"sequence(0, cast((n - 1) div {capacity} as int))")))
    pieces = cut.select("id", "piece", F.least(F.lit(capacity), F.expr(f"n - piece * {capacity}L")).alias("n_tokens")).withColumn("size", F.expr(f"(n_tokens + {grain - 1}) div {grain}"))
    histogram = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity / grain rows
    demand = np.zeros(capacity // grain + 1, np.int64)
    for row in histogram:
        demand[row["size"]] = row["n"]
    table = plan(demand, capacity // grain)
    buckets = max(1, int(demand.max()) // PER_TASK + 1)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("size", "bucket").orderBy("id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1)
    if buckets > 1:
        each = pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.join(each.select("size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    ranked = ranked.select("id", "piece", "n_tokens", "size", F.col("rank").cast("bigint").alias("rank"))
    placed = ranked.mapInArrow(_placer(table), "id BIGINT, piece INT, n_tokens BIGINT, container BIGINT")
    none = own.where("n <= 0").selectExpr("id", "0 as piece", "0L as n_tokens", "cast(null as bigint) as container")
    return placed.unionByName(none).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str = tokens.FOLDER, name: str = tokens.NAME) -> DataFrame:
    """Documents, measured in tokens, in containers of `capacity` tokens; see pack_lengths."""
    return pack_lengths(written(tokens.token_lengths(docs, "doc_id", "text", folder, name), "lengths"), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused space, and the least number of containers that the tokens need."""
    total = packed.agg(F.max("container").alias("last"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.countDistinct("container").alias("containers"))
    return total.select("containers", "tokens", F.expr(f"containers * {capacity}L - tokens").alias("unused"), F.expr(f"cast(ceil(tokens / {capacity}) as bigint)").alias("least_containers"))
