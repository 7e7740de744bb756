"""Online clustering of documents into stories, in order of time: one small kernel for batches and streams.

The result depends on the order, so documents of one shard (an event type, a region, a feed)
are folded one after another, and shards run in parallel.  Clusters that have been idle
for the window are forgotten, which bounds the state of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClusterConfig:
    threshold: float = 0.86
    penalty: float = 0.10
    bonus: float = 0.0
    window_hours: float = 48.0
    candidates: int = 5
    need_shared: bool = False


@dataclass
class Shard:
    """Active clusters of one shard: ids, sums of vectors and their unit vectors as rows of growing matrices, names and last times."""

    ids: list[str] = field(default_factory=list)
    names: list[set] = field(default_factory=list)
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    unit: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    last: np.ndarray = field(default_factory=lambda: np.zeros(0))
    oldest: float = float("inf")  # no cluster was last seen before

    def expire(self, now: float, hours: float) -> None:
        """Forgets what the window has left; clusters are only looked through when one may be among it."""
        horizon = now - hours * 3600
        if self.oldest >= horizon:
            return
        n = len(self.ids)
        keep = np.flatnonzero(self.last[:n] >= horizon)
        if len(keep) < n:
            self.ids, self.names = ([x[i] for i in keep.tolist()] for x in (self.ids, self.names))
            for m in (self.sums, self.unit, self.last):
                m[: len(keep)] = m[keep]
        self.oldest = float(self.last[: len(keep)].min()) if len(keep) else float("inf")

    def found(self, doc_id: str, size: int, at: float) -> int:
        n = len(self.ids)
        if n == len(self.last):
            self.sums, self.unit = (np.concatenate([m.reshape(n, size), np.zeros((max(16, n), size))]) for m in (self.sums, self.unit))
            self.last = np.concatenate([self.last, np.zeros(max(16, n))])
        self.ids.append(doc_id)
        self.names.append(set())
        self.sums[n], self.last[n], self.oldest = 0.0, at, min(self.oldest, at)
        return n

    def assign(self, doc_id: str, vector: np.ndarray, names: set, at: float, c: ClusterConfig) -> tuple[str, float, bool]:
        """The cluster that a document joins, its similarity before that, and whether it is new.

        Of the closest few centroids the best wins, less the penalty where both have names and share
        none, plus the bonus where they share one; with need_shared those that share none are out.
        """
        self.expire(at, c.window_hours)
        best, most = -1, -1.0
        if self.ids:
            sims = self.unit[: len(self.ids)] @ vector
            k = min(c.candidates, len(sims))
            near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
            for i in near[np.argsort(-sims[near], kind="stable")][:k].tolist():
                shared = names & self.names[i]
                if c.need_shared and not shared:
                    continue
                s = float(sims[i]) - (c.penalty if names and self.names[i] and not shared else 0.0) + (c.bonus if shared else 0.0)
                if s > most:
                    best, most = i, s
        new = best < 0 or most < c.threshold
        if new:
            best = self.found(doc_id, len(vector), at)
        self.sums[best] += vector
        self.unit[best] = self.sums[best] / max(float(np.linalg.norm(self.sums[best])), 1e-12)
        self.names[best] |= names
        self.last[best] = max(self.last[best], at)
        return self.ids[best], max(most, 0.0), new


OUT = "shard string, doc_id string, cluster_id string, similarity double, novelty double"


def fold(shard: Shard, rows: pd.DataFrame, c: ClusterConfig) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["at", "seq"], kind="stable").itertuples():
        v = np.asarray(r.embedding, float)
        v = v / max(np.linalg.norm(v), 1e-12)
        found, sim, new = shard.assign(r.doc_id, v, set(r.names if r.names is not None else ()), r.at, c)
        out.append((r.shard, r.doc_id, found, sim, 1.0 if new else min(max(1 - sim, 0.0), 1.0)))
    return pd.DataFrame(out, columns=["shard", "doc_id", "cluster_id", "similarity", "novelty"])


def cluster(docs: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Rows (shard, doc_id, cluster_id, similarity, novelty); docs: shard, doc_id, seq, at (timestamp), embedding, names.  A cluster is named by its first document."""
    rows = docs.select(F.col("shard").cast("string"), F.col("doc_id").cast("string"), "seq", (F.unix_micros("at") / 1e6).alias("at"), "embedding", "names")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, last = None, None
        for batch in batches:
            for _, part in batch.groupby("shard", sort=False, dropna=False):
                if shard is None or part["shard"].iloc[0] != last:
                    shard, last = Shard(), part["shard"].iloc[0]
                yield fold(shard, part, config)

    # Spark sorts, on disk where need be; a task holds one batch of rows and the live clusters of one shard.
    return rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("at"), F.asc_nulls_last("seq")).mapInPandas(run, OUT)


def event_clusters(founders: DataFrame, firm_types: list[str], threshold: float = 0.76, bonus: float = 0.06, window_hours: float = 48.0) -> DataFrame:
    """Rows as from ``cluster``: founding documents of stories joined to events of their own type.

    founders: event_type, doc_id, seq, at, embedding, names (companies).  A shared name lowers the bar by bonus; stories
    of firm_types only join an event that shares one.  Types run in parallel.  A story whose event has been forgotten is
    passed in again as a founder and opens or joins another.
    """
    rows = founders.withColumnRenamed("event_type", "shard")
    firm = F.col("shard").isin(firm_types)
    config = ClusterConfig(threshold=threshold, penalty=0.0, bonus=bonus, window_hours=window_hours)
    return cluster(rows.where(~firm), config).unionByName(cluster(rows.where(firm), replace(config, need_shared=True)))


def cluster_stream(docs: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """The same over a stream; what a shard remembers, its clusters of the last window, is Spark's state for it."""
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = pickle.loads(state.get[0]) if state.exists else Shard()
        rows = pd.concat(list(batches), ignore_index=True)
        out = fold(shard, rows, config)
        state.update((pickle.dumps(shard),))
        yield out

    rows = docs.select(F.col("shard").cast("string"), F.col("doc_id").cast("string"), "seq", (F.unix_micros("at") / 1e6).alias("at"), "embedding", "names")
    return rows.groupBy("shard").applyInPandasWithState(run, OUT, "memory binary", "append", GroupStateTimeout.NoTimeout)


def roll_up(docs: DataFrame) -> DataFrame:
    """One row for each cluster: documents, publishers, weighted sentiment, first and last time, and the headline (news before social, then the closest, then the earliest)."""
    weight = F.col("credibility") * F.col("relevance") * (0.1 + 0.9 * (1 - F.col("neutral")))
    return docs.groupBy("cluster_id").agg(
        F.count("*").alias("n_docs"), F.count_distinct("publisher").alias("n_publishers"), F.coalesce(F.try_divide(F.sum(weight * F.col("sentiment")), F.sum(weight)), F.lit(0.0)).alias("sentiment"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("text", F.struct((F.col("kind") == "news").alias("news"), "similarity", -F.col("seq"))).alias("headline"),
    )


def centroids(vectors: DataFrame, by: str, vector: str, digits: int = 6) -> DataFrame:
    """Rows (by, position, value): the normalised mean vector of each group, position by position, so that a large group is summed in many tasks."""
    sums = vectors.select(by, F.posexplode(vector).alias("position", "x")).groupBy(by, "position").agg(F.sum(F.col("x").cast("double")).alias("s"))
    norms = sums.groupBy(by).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.join(norms, by).select(by, "position", F.round(F.try_divide("s", "norm"), digits).alias("value"))
