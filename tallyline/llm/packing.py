"""Problem 7: filling containers of fixed capacity by bin completion.

A container is begun with the largest text left and completed by an undominated filling. Fillings are enumerated, not sampled:
those that leave no room first, then those that leave one token, and so on, each in descending order of its texts; a filling is
dominated, and left out, if a text outside would fit in the place of one or more of its texts and fill the room as well or
better. The search goes depth first over the fillings of each container, cuts branches whose waste exceeds what
a solution better than the incumbent may waste, and takes best-fit decreasing as the first incumbent. It stops at the
lower bound (Martello and Toth's L2) or at its budget. While the bound is not reached, the containers with the most room left and
some of the others are emptied and searched anew, which finds what lies too deep for one search over all.

Texts are packed in groups by hash of doc_id, each in one task and bounded in size; containers that
stay under ``FULL`` of the capacity give their texts to the next, smaller round, so that what the
groups waste at their ends is packed together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts that one task packs at a time.
GROUP = 4000
#: Containers filled to this share are closed; the others go on to the next round.
FULL = 0.995
ROUNDS = 4
#: Kinds of containers that the texts meet in one pass; more kinds take more passes.
KINDS = 1000
#: Containers that one search begins, besides two for each of the incumbent; fillings that it looks at for one container.
NODES = 1000
LOOKED_AT = 24
#: While the lower bound is not reached, so many wasteful containers and others are emptied and searched anew, with so many nodes besides two
#: for each; it ends after VAIN tokens of capacity, summed over the attempts since the last gain, as an attempt costs in proportion to the capacity.
WASTEFUL, OTHERS, NODES_AGAIN, VAIN = 40, 120, 200, 30_000
#: Fixed value: how the vocabulary's tokenizer splits a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(folder: str):
    import base64
    from pathlib import Path

    import tiktoken

    with open(Path(folder) / VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and tokens of every text (a public byte-level vocabulary at ``folder``); null and empty texts have none."""
    kept: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept.get("enc") or kept.setdefault("enc", _encoder(folder))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of ``sizes`` (sorted downwards) by container."""
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by room left
    present = 0  # bit r is set if a container has room r
    bins: list[list[int]] = []
    for i, s in enumerate(sizes.tolist()):
        fits = present >> s
        if fits and s:
            r = s + ((fits & -fits).bit_length() - 1)
            b = room_of[r].pop()
            if not room_of[r]:
                present &= ~(1 << r)
        elif not s and bins:
            bins[-1].append(i)
            continue
        else:
            b, r = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room_of[r - s].append(b)
        present |= 1 << (r - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer containers: texts above half the capacity cannot share, and for every threshold a the
    texts of at least a must fit beside the larger ones that leave them room (Martello and Toth's L2)."""
    s = np.sort(sizes[sizes > 0])[::-1].astype(np.int64)
    if not len(s):
        return 0
    cum = np.concatenate([[0], np.cumsum(s)])
    n_half = int((s * 2 > capacity).sum())
    best = -(-int(cum[-1]) // capacity)
    for a in np.unique(s[s * 2 <= capacity]).tolist() or [0]:
        n1 = int((s > capacity - a).sum())
        n_a = int((s >= a).sum())
        alone = (n_half - n1) * capacity - int(cum[n_half] - cum[n1])  # room beside the larger ones
        rest = int(cum[max(n_a, n_half)] - cum[n_half])
        best = max(best, n_half + max(0, -(-(rest - alone) // capacity)))
    return best


def _any_in_reach(sums: int, sizes: int, width: int) -> bool:
    """Whether some bit of ``sizes`` lies 1 to ``width`` above some bit of ``sums``."""
    reach, have = sums << 1, 1
    while have < width:
        step = min(have, width - have)
        reach |= reach << step
        have += step
    return width > 0 and bool(reach & sizes)


class _Fillings:
    """The undominated fillings of ``room`` with sizes of ``count`` (by size), from the least room left up to ``allowed``.

    An iterator: what the search does not ask for is not made. Sums are sets of bits: ``reach[k]`` has the sums that the k smallest
    sizes present can make, so every branch taken ends in a filling.
    """

    def __init__(self, count: np.ndarray, room: int, allowed: int) -> None:
        self.room, self.allowed, self.looked = room, allowed, 0
        self.sizes = np.flatnonzero(count[: room + 1]).tolist()
        self.counts = [int(count[v]) for v in self.sizes]
        full, now = (1 << (room + 1)) - 1, 1
        self.reach = [now]
        self.present = sum(1 << v for v in self.sizes)
        self.have = dict(zip(self.sizes, self.counts, strict=True))
        for v, c in zip(self.sizes, self.counts, strict=True):
            c, step = min(c, room // v), 1
            while c > 0:  # so many copies by doubling
                take = min(step, c)
                now |= (now << (v * take)) & full
                c -= take
                step *= 2
            self.reach.append(now)

    def __iter__(self):
        sums = self.reach[-1]
        while sums and self.looked < LOOKED_AT:
            total = sums.bit_length() - 1
            sums &= ~(1 << total)
            if self.room - total > self.allowed:
                return
            for filling in self._of(total):
                self.looked += 1
                if self._undominated(filling, self.room - total):
                    yield tuple(v for v, n in filling for _ in range(n))
                if self.looked >= LOOKED_AT:
                    return

    def _of(self, total: int):
        """All multisets with this sum, larger sizes and more of them first, as (size, copies)."""
        stack = [(len(self.sizes), total, ())]
        while stack:
            k, left, chosen = stack.pop()
            if not left:
                yield chosen
                continue
            # The largest size that may come next: every smaller one is tried after it.
            options = []
            while k and self.reach[k] >> left & 1:
                v = self.sizes[k - 1]
                most = min(self.counts[k - 1], left // v)
                options += [(k - 1, left - n * v, (*chosen, (v, n))) for n in range(most, 0, -1) if self.reach[k - 1] >> (left - n * v) & 1]
                k -= 1
                if len(options) >= 16:  # the rest is looked at when these are done
                    options.append((k, left, chosen))
                    break
            stack += reversed(options)

    def _undominated(self, filling: tuple, room_left: int) -> bool:
        """Whether no size outside fits in place of a part of the filling (or of nothing) and fills as much or more.

        In place of one text only more counts; in place of several the same is enough, as fewer texts leave better ones.
        """
        outside = self.present
        for v, n in filling:
            if n == self.have[v]:
                outside &= ~(1 << v)
        single, several = 0, 0
        sums = 1
        for v, n in filling:
            for _ in range(n):
                several |= (sums & ~1) << v
                sums |= sums << v
            single |= 1 << v
        return not (_any_in_reach(1 | single | several, outside, room_left) or several & outside)


class _Search:
    """Bin completion over a multiset of sizes."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.capacity, self.total = capacity, int(sizes.sum())
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.count[0] = 0
        self.bound = lower_bound(sizes, capacity)
        self.nodes = 0

    def solve(self, incumbent: int, nodes: int = NODES) -> list[tuple[int, ...]] | None:
        """Fillings of fewer than ``incumbent`` containers, if the search finds them."""
        best: list[tuple[int, ...]] | None = None
        open_: list[tuple] = []  # (fillings still to try at this container, its largest size, waste before it)
        chosen: list[tuple[int, ...]] = []
        waste = 0
        budget = nodes + 2 * incumbent
        while True:
            left = np.flatnonzero(self.count)
            allowed = (incumbent - 1) * self.capacity - self.total - waste
            if not len(left):
                if len(chosen) < incumbent:
                    best, incumbent = list(chosen), len(chosen)
                if incumbent <= self.bound:
                    return best
            elif allowed >= 0 and self.nodes < budget:
                self.nodes += 1
                largest = int(left[-1])
                self.count[largest] -= 1
                open_.append((iter(_Fillings(self.count, self.capacity - largest, allowed)), largest, waste))
                self.count[largest] += 1
                chosen.append(())
            elif self.nodes >= budget:
                return best
            # The next filling of the last container that has one.
            while open_:
                options, largest, before = open_[-1]
                for s in chosen.pop():
                    self.count[s] += 1
                room = (incumbent - 1) * self.capacity - self.total - before
                filling = next(options, None)
                if filling is not None and self.capacity - largest - sum(filling) <= room:
                    whole = (largest, *filling)
                    for s in whole:
                        self.count[s] -= 1
                    chosen.append(whole)
                    waste = before + self.capacity - sum(whole)
                    break
                open_.pop()
            if not open_:
                return best


def _again(bins: list[tuple[int, ...]], capacity: int, bound: int) -> list[tuple[int, ...]]:
    """Fewer containers, if emptying the wasteful ones together with others makes a part of them fit into fewer."""
    rng, vain = np.random.default_rng(len(bins)), 0
    while bound < len(bins) and len(bins) > WASTEFUL + OTHERS and vain < VAIN:
        vain += capacity
        room = np.array([capacity - sum(b) for b in bins])
        order = np.argsort(-room + rng.random(len(bins)) * capacity / 100, kind="stable")
        some = [*order[:WASTEFUL], *rng.permutation(order[WASTEFUL:])[:OTHERS]]
        search = _Search(np.array([s for i in some for s in bins[i]]), capacity)
        fewer = search.solve(len(some), NODES_AGAIN) if search.bound < len(some) else None
        if fewer is not None:
            emptied = set(some)
            bins, vain = [b for i, b in enumerate(bins) if i not in emptied] + fewer, 0
    return bins


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of every size (each at most ``capacity``)."""
    sizes = np.asarray(sizes, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    down = sizes[order]
    out = np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return out
    bins = best_fit(down, capacity)
    search = _Search(down, capacity)
    if len(bins) > max(1, search.bound):
        plain = [tuple(int(down[i]) for i in b if down[i]) for b in bins]
        better = _again(search.solve(len(bins)) or plain, capacity, search.bound)
        if len(better) < len(bins):
            at: dict[int, list[int]] = {}
            for i in range(len(down) - 1, -1, -1):
                at.setdefault(int(down[i]), []).append(i)
            bins = [[at[s].pop() for s in b if s] for b in better]
            bins[-1] += at.get(0, [])
    for b, members in enumerate(bins):
        out[order[members]] = b
    return out


def _packer(number: int, last: bool):
    """Packs one group; in the last round every container stays as it is."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity_tokens"].iloc[0])
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        b = pack(pdf["tokens"].to_numpy(), capacity)
        used = np.bincount(b, pdf["tokens"].to_numpy())
        name = [f"{k}-{number}-{g}-{x}" for k, g, x in zip(pdf["container_kind"], pdf["part"], b, strict=True)]
        return pd.DataFrame({
            "container_kind": pdf["container_kind"], "capacity_tokens": pdf["capacity_tokens"], "container_id": name, "doc_id": pdf["doc_id"], "piece": pdf["piece"].astype("int32"),
            "tokens": pdf["tokens"], "open": (used[b] < FULL * capacity) & (not last),
        })

    return one


def _parts(kinds: Iterator) -> Iterator[list[tuple[str, int]]]:
    while part := [(k["container_kind"], k["capacity_tokens"]) for k in itertools.islice(kinds, KINDS)]:
        yield part


def fill(tokens: DataFrame, containers: DataFrame, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Puts every doc_id of ``tokens`` (doc_id, tokens) into containers of each kind of ``containers`` (container_kind, capacity_tokens).

    Columns: container_kind, capacity_tokens, container_id, doc_id, piece, tokens. A text within the
    capacity is whole (piece 0); one that exceeds it alone gives full pieces, each filling a container, and
    a last piece that is packed like a text. Texts without tokens take no room but are listed.
    Kinds with a null or not positive capacity are left out; repeated rows of a doc_id count once.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).filter("capacity_tokens > 0 AND container_kind IS NOT NULL").distinct()
    sized = durable(tokens.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    rows = sized.count()
    items = None
    for part in _parts(kinds.orderBy("container_kind", "capacity_tokens").toLocalIterator()):
        kind = F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity_tokens")) for k, c in part)))
        some = sized.select("*", kind.alias("k")).select("doc_id", "tokens", "k.*")
        items = some if items is None else items.unionByName(some)
    if items is None:
        items = sized.select("doc_id", "tokens", F.lit("").alias("container_kind"), F.lit(1).cast("long").alias("capacity_tokens")).limit(0)
    over = F.floor((F.col("tokens") - 1) / F.col("capacity_tokens")).cast("int")
    items = items.withColumn("n_full", F.greatest(over, F.lit(0)))
    whole = items.select("container_kind", "capacity_tokens", "doc_id", F.col("n_full").alias("piece"), (F.col("tokens") - F.col("n_full") * F.col("capacity_tokens")).alias("tokens"))
    full = items.filter("n_full > 0").select(
        "container_kind", "capacity_tokens", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece"), "doc_id",
    ).select("container_kind", "capacity_tokens", F.concat_ws("-", F.col("container_kind"), F.lit("full"), F.col("doc_id"), F.col("piece")).alias("container_id"), "doc_id", "piece", F.col("capacity_tokens").alias("tokens"))
    schema = "container_kind string, capacity_tokens long, container_id string, doc_id long, piece int, tokens long, open boolean"
    out = full
    waiting = whole
    for r in range(rounds):
        groups = max(1, -(-rows // group))
        last = groups == 1 or r == rounds - 1
        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(groups))
        done = durable(waiting.withColumn("part", part).groupBy("container_kind", "part").applyInPandas(_packer(r, last), schema))
        out = out.unionByName(done.filter("NOT open").drop("open"))
        if last:
            break
        waiting = done.filter("open").select("container_kind", "capacity_tokens", "doc_id", "piece", "tokens")
        rows = max([x["n"] for x in waiting.groupBy("container_kind").agg(F.count("*").alias("n")).collect()], default=0)
        if not rows:
            break
    return out


def summary(filled: DataFrame) -> DataFrame:
    """For each kind: texts, tokens, containers, the lower bound ceil(tokens / capacity) and the share of room left unused."""
    s = filled.groupBy("container_kind", "capacity_tokens").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.sum("tokens").alias("tokens"), F.countDistinct("container_id").alias("containers"))
    return s.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn(
        "unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
