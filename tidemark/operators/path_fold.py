"""Copies, stories and events of a shard in one fold: what a document is news of, for batches and streams.

A document is looked up by fingerprint first.  A copy of something analysed before is no news: it
adds to the count of its story and event and keeps them alive.  Any other relevant document joins a
*story*, a tight group of texts that say the same, or founds one; a founder joins an *event* of its own type, a looser group
of stories, or founds that.  A story may outlive its event: the next document that joins
it then founds or joins an event anew, as its founder did.

What a document joins depends on all before it, so the documents of one shard (a feed, a region, a
language) are folded in order, and shards run in parallel.  A fold remembers a bounded number of
fingerprints, and the clusters of its window.  ``fold_batch`` and ``fold_stream`` are the
same kernel over a sorted table and over Spark's keyed state.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class FoldConfig:
    """Thresholds of cosine similarity, hours that a cluster lives without a report, and how many fingerprints are remembered.

    Clusters are looked through for dead ones every so many assignments.  With wait_for_batch a copy
    counts for its story only in a later batch than the text that it is a copy of.
    """

    story: float = 0.86
    apart: float = 0.10
    event: float = 0.76
    shared: float = 0.06
    window_hours: float = 48.0
    candidates: int = 5
    relevance: float = 0.5
    market_wide: tuple[int, ...] = ()
    copies: int = 50_000
    story_checks: int = 200
    event_checks: int = 50
    wait_for_batch: bool = True


def unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    return v / max(math.sqrt(v.dot(v)), 1e-12)


@dataclass
class Group:
    """A story or an event."""

    id: str
    total: np.ndarray
    last: float
    names: set[str] = field(default_factory=set)
    type: int = -1
    event: str = ""
    order: int = 0


class Live:
    """Groups that are alive, in the order in which they began, with their unit centroids as rows of one growing matrix."""

    def __init__(self, every: int):
        self.every, self.calls, self.started = every, 0, 0
        self.groups: list[Group] = []
        self.row: dict[str, int] = {}
        self.unit = np.zeros((0, 0))
        self.ahead: np.ndarray | None = None  # products with vectors to come, a row for each of these, of the groups as they were
        self.since: dict[int, int] = {}  # groups that changed since then, by number: their place in changed
        self.changed = np.zeros((0, 0), np.float32)
        self.touched: set[str] = set()
        self.dead: set[str] = set()

    def put(self, group: Group) -> None:
        n = len(self.groups)
        if n >= len(self.unit):
            grown = np.zeros((max(16, 2 * n), len(group.total)))
            grown[:n] = self.unit[:n] if n else 0
            self.unit = grown
        self.groups.append(group)
        self.row[group.id] = n
        self.started = max(self.started, group.order + 1)
        self.centre(group)

    def centre(self, group: Group) -> None:
        i = self.row[group.id]
        self.unit[i] = unit(group.total)
        if self.ahead is not None:
            k = self.since.setdefault(i, len(self.since))
            if k >= len(self.changed):
                self.changed = np.concatenate([self.changed, np.zeros((max(16, k), len(group.total)), np.float32)])
            self.changed[k] = self.unit[i]

    def look_ahead(self, vectors: np.ndarray) -> None:
        """Takes the products with vectors to come in one go, which is much faster than one by one; those of groups that change meanwhile are taken anew."""
        n = len(self.groups)
        self.since, self.changed = {}, np.zeros((0, vectors.shape[1]), np.float32)
        self.ahead = vectors @ self.unit[:n].T.astype(np.float32) if n else np.zeros((len(vectors), 0), np.float32)

    def near(self, v: np.ndarray, bar: float, place: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Groups whose product with v is bar or more, by number, and these products; place is that of v in what was looked ahead at.

        Products looked ahead at are in single precision, and what these leave is multiplied in double precision.
        """
        n = len(self.groups)
        if place is None or self.ahead is None:
            found = np.arange(n)
        else:
            room = 1e-7 * (len(v) + 16)
            found = np.flatnonzero(self.ahead[place] >= bar - room)
            if self.since:
                numbers = np.fromiter(self.since, np.int64, len(self.since))
                close = self.changed[: len(numbers)] @ v.astype(np.float32) >= bar - room
                known = np.ones(n, bool)
                known[numbers] = False
                found = np.sort(np.concatenate([found[known[found]], numbers[close]]))
        s = self.unit[found] @ v if 4 * len(found) < n else (self.unit[:n] @ v)[found]
        over = s >= bar
        return found[over], s[over]

    def get(self, name: str | None) -> Group | None:
        return self.groups[self.row[name]] if name in self.row else None

    def found(self, prefix: str, doc_id: str, size: int, at: float) -> Group:
        group = Group(prefix + hashlib.sha1(doc_id.encode()).hexdigest()[:10], np.zeros(size), at, order=self.started)
        self.put(group)
        return group

    def add(self, group: Group, vector: np.ndarray, names: set[str], at: float) -> None:
        group.total = group.total + vector
        group.names |= names
        self.touch(group, at)
        self.centre(group)

    def touch(self, group: Group, at: float) -> None:
        group.last = max(group.last, at)
        self.touched.add(group.id)

    def expire(self, now: float, hours: float) -> None:
        """Every so many calls, forgets the groups without a report inside the window."""
        self.calls += 1
        if self.calls < self.every:
            return
        self.calls = 0
        keep = [i for i, g in enumerate(self.groups) if g.last >= now - hours * 3600]
        if len(keep) < len(self.groups):
            if self.ahead is not None:
                at = {i: k for k, i in enumerate(keep)}
                left = [(i, k) for i, k in self.since.items() if i in at]
                self.ahead = self.ahead[:, [i for i in keep if i < self.ahead.shape[1]]]
                self.changed, self.since = self.changed[[k for _, k in left]], {at[i]: k for k, (i, _) in enumerate(left)}
            alive = [self.groups[i] for i in keep]
            self.dead |= self.row.keys() - {g.id for g in alive}
            self.unit[: len(keep)] = self.unit[keep]
            self.groups, self.row = alive, {g.id: i for i, g in enumerate(alive)}


class Copies:
    """The last so many fingerprints, each with the story that its text went to and the batch of that."""

    def __init__(self, most: int):
        self.most, self.seen = most, OrderedDict()

    def get(self, print_: str) -> tuple[str | None, int] | None:
        return self.seen.get(print_)

    def put(self, print_: str, story: str | None, batch: int) -> None:
        self.seen.pop(print_, None)
        self.seen[print_] = story, batch
        if len(self.seen) > self.most:
            self.seen.popitem(last=False)


OUT = "shard string, doc_id string, duplicate boolean, noise boolean, story_id string, event_id string, similarity double, event_similarity double, novelty double, founds_story boolean, refounded boolean"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


#: Documents whose products with what is alive are taken together, about how many products at most, and stories from which on that is worth it.
AHEAD, AHEAD_CELLS, FEW = 512, 1 << 24, 64


class Fold:
    """The fold of one shard."""

    def __init__(self, config: FoldConfig, copies=None):
        self.config = config
        self.stories, self.events = Live(config.story_checks), Live(config.event_checks)
        self.copies = Copies(config.copies) if copies is None else copies

    def take_all(self, rows: list) -> list[tuple]:
        """The rows for documents in order; AHEAD of them are looked ahead at together."""
        out = []
        while len(out) < len(rows):
            size = max(32, min(AHEAD, AHEAD_CELLS // max(1, len(self.stories.groups), len(self.events.groups))))
            some = rows[len(out) : len(out) + size]
            place = {i: k for k, i in enumerate(i for i, r in enumerate(some) if r.embedding is not None and r.relevance >= self.config.relevance and self.new(r))}
            sizes = {len(some[i].embedding) for i in place}
            if len(place) > 1 and len(sizes) == 1 and len(self.stories.groups) > FEW:
                vectors = np.array([unit(some[i].embedding) for i in place], np.float32)
                for live in (self.stories, self.events):
                    live.look_ahead(vectors)
            else:
                place = {}
            out += [self.take(r, place.get(i)) for i, r in enumerate(some)]
            self.stories.ahead = self.events.ahead = None
        return out

    def new(self, r) -> bool:
        return r.fp is None or self.copies.get(r.fp) is None

    def take(self, r, place: int | None = None) -> tuple:
        """The row for a document, after which it is part of what the fold knows; place is its place in what was looked ahead at."""
        c, now = self.config, r.at
        known = self.copies.get(r.fp) if r.fp is not None else None
        if known is not None:
            story = self.stories.get(known[0]) if known[1] < r.batch or not c.wait_for_batch else None
            event = self.events.get(story.event) if story else None
            if event is None:
                return (r.shard, r.doc_id, True, False, None, None, None, None, None, False, False)
            self.stories.touch(story, now)
            self.events.touch(event, now)
            return (r.shard, r.doc_id, True, False, story.id, event.id, None, None, None, False, False)
        if not r.relevance >= c.relevance or r.embedding is None:  # a null relevance is none
            self.remember(r, None)
            return (r.shard, r.doc_id, False, True, None, None, None, None, None, False, False)
        v = unit(r.embedding)
        names, firms = (set(x) if x is not None else set() for x in (r.entities, r.companies))
        self.stories.expire(now, c.window_hours)
        story, similarity = self.nearest_story(v, firms, place)
        new = story is None
        if new:
            story = self.stories.found("sty_", r.doc_id, len(v), now)
        event = None if new else self.events.get(story.event)
        refounded = not new and event is None
        if event is None:
            self.events.expire(now, c.window_hours)
            event = self.nearest_event(v, r.type, names, firms, place)
            if event is None:
                event = self.events.found("evt_", r.doc_id, len(v), now)
                event.type = r.type
            story.event = event.id
        near = float(self.events.unit[self.events.row[event.id]] @ v) if event.total.any() else 1.0
        self.stories.add(story, v, firms, now)
        self.events.add(event, v, names, now)
        self.remember(r, story.id)
        return (r.shard, r.doc_id, False, False, story.id, event.id, 1.0 if new else similarity, near, 1.0 if new else min(max(1 - similarity, 0.0), 1.0), new, refounded)

    def remember(self, r, story: str | None) -> None:
        if r.fp is not None:
            self.copies.put(r.fp, story, r.batch)

    def nearest_story(self, v: np.ndarray, firms: set[str], place: int | None = None) -> tuple[Group | None, float]:
        """Of the closest few the best one, less a penalty where both name companies and share none, if it is close enough."""
        live = self.stories
        if not live.groups:
            return None, 0.0
        few, s = live.near(v, self.config.story, place)  # one that is farther is none, with a penalty or without
        k = min(self.config.candidates, len(s))
        if k < len(s):
            closest = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            few, s = few[closest], s[closest]
        order = np.argsort(-s, kind="stable")[:k]
        best, most = None, -1.0
        for i, similarity in zip(few[order].tolist(), s[order].tolist(), strict=True):
            group = live.groups[i]
            at = similarity - (self.config.apart if firms and group.names and firms.isdisjoint(group.names) else 0.0)
            if at > most:
                best, most = group, at
        return (best, most) if most >= self.config.story else (None, 0.0)

    def nearest_event(self, v: np.ndarray, type_: int, names: set[str], firms: set[str], place: int | None = None) -> Group | None:
        """The event of a type that clears its bar by most; a shared name lowers the bar, and but for market-wide types a shared company is a must."""
        live, c = self.events, self.config
        if not live.groups:
            return None
        best, most = None, 0.0
        for i, near in zip(*(x.tolist() for x in live.near(v, c.event - c.shared, place)), strict=True):
            group = live.groups[i]
            if group.type != type_ or (type_ not in c.market_wide and firms.isdisjoint(group.names)):
                continue
            over = near - (c.event - (0.0 if names.isdisjoint(group.names) else c.shared))
            if over >= 0 and (best is None or over > most):
                best, most = group, over
        return best


_IN = ["shard", "doc_id", "fp", "batch", "seq", "at", "type", "relevance", "embedding", "entities", "companies"]


def _rows(docs: DataFrame) -> DataFrame:
    kinds = {"shard": "string", "doc_id": "string", "fp": "string", "batch": "long", "type": "int", "relevance": "double"}
    return docs.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else (F.unix_micros(c) / 1e6).alias(c) if c == "at" else F.col(c) for c in _IN])


def fold_batch(docs: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """Rows OUT for every document of docs (shard, doc_id, fp, batch, seq, at, type, relevance, embedding, entities, companies).

    Shards are folded in the order of batch, at and seq, nulls last.  A document whose relevance is null or too small, or
    that has no embedding, is noise; one without a fingerprint is no copy.  type is a number, fp the text's
    fingerprint.  Spark sorts, on disk where need be; a task holds one batch of rows and one fold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, shard = None, None
        for rows in batches:
            out = []
            for of, some in groupby(_tuples(rows), key=lambda r: r.shard):
                if fold is None or of != shard:
                    fold, shard = Fold(config), of
                out += fold.take_all(list(some))
            yield pd.DataFrame(out, columns=_NAMES)

    order = ["shard", *[F.asc_nulls_last(c) for c in ("batch", "at", "seq")]]
    return _rows(docs).repartition("shard").sortWithinPartitions(*order).mapInPandas(run, OUT)


def _tuples(rows: pd.DataFrame) -> Iterator:
    """Rows with None for what is missing."""
    rows = rows.astype({c: object for c in ("shard", "doc_id", "fp", "embedding", "entities", "companies")})
    for c in ("shard", "doc_id", "fp"):
        rows[c] = rows[c].where(rows[c].notna(), None)
    return rows.fillna({"batch": 0}).astype({"batch": "int64"}).itertuples()


class KeptCopies:
    """``Copies`` in keyed state: a story for each fingerprint, and a queue of fingerprints by number; a few look-ups for each document, whatever is kept."""

    def __init__(self, stories, queue, ends, most: int):
        self.stories, self.queue, self.ends, self.most = stories, queue, ends, most
        self.first, self.next, self.n = ends.get() if ends.exists() else (0, 0, 0)

    def get(self, print_: str) -> tuple[str | None, int] | None:
        return tuple(self.stories.getValue((print_,)))[:2] if self.stories.containsKey((print_,)) else None

    def put(self, print_: str, story: str | None, batch: int) -> None:
        if self.stories.containsKey((print_,)):
            self.queue.removeKey((self.stories.getValue((print_,))[2],))
        else:
            self.n += 1
        self.stories.updateValue((print_,), (story, batch, self.next))
        self.queue.updateValue((self.next,), (print_,))
        self.next += 1
        while self.n > self.most:
            if self.queue.containsKey((self.first,)):
                oldest = self.queue.getValue((self.first,))[0]
                self.queue.removeKey((self.first,))
                self.stories.removeKey((oldest,))
                self.n -= 1
            self.first += 1

    def close(self) -> None:
        self.ends.update((self.first, self.next, self.n))


_GROUP = "total binary, last double, names array<string>, type int, event string, began long"


class PathProcessor(StatefulProcessor):
    """The fold in Spark's keyed state: one map entry for each live story, event and fingerprint; only what a batch changes is written."""

    def __init__(self, config: FoldConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = {name: handle.getMapState(name, "id string", _GROUP) for name in ("stories", "events")}
        self.seen = handle.getMapState("copies", "fp string", "story string, batch long, number long")
        self.queue = handle.getMapState("queue", "number long", "fp string")
        self.ends = handle.getValueState("ends", "first long, next long, n long")
        self.calls = handle.getValueState("calls", "stories int, events int, story_order long, event_order long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        copies = KeptCopies(self.seen, self.queue, self.ends, self.config.copies)
        fold = Fold(self.config, copies)
        for name, live in (("stories", fold.stories), ("events", fold.events)):
            found = [Group(k[0], np.frombuffer(v[0]), v[1], set(v[2]), v[3], v[4], v[5]) for k, v in self.kept[name].iterator()]
            for group in sorted(found, key=lambda g: g.order):
                live.put(group)
        if self.calls.exists():
            fold.stories.calls, fold.events.calls, fold.stories.started, fold.events.started = self.calls.get()
        docs = pd.concat(list(rows), ignore_index=True).sort_values(["batch", "at", "seq"], kind="stable", na_position="last")
        out = fold.take_all(list(_tuples(docs)))
        for name, live in (("stories", fold.stories), ("events", fold.events)):
            for group in live.dead:
                if self.kept[name].containsKey((group,)):
                    self.kept[name].removeKey((group,))
            for group in (live.get(i) for i in live.touched):
                if group is not None:
                    self.kept[name].updateValue((group.id,), (group.total.tobytes(), group.last, sorted(group.names), group.type, group.event, group.order))
        self.calls.update((fold.stories.calls, fold.events.calls, fold.stories.started, fold.events.started))
        copies.close()
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def fold_stream(docs: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """The same over a stream.  Each micro-batch is folded in the order of batch, at and seq behind all earlier ones; the state store must be RocksDB."""
    return _rows(docs).groupBy("shard").transformWithStateInPandas(PathProcessor(config), OUT, "Append", "None")


def with_batches(at: Column, minutes: int = 15) -> Column:
    """A number for the slot of a timestamp: what arrives in one slot is one batch."""
    return F.floor(F.unix_seconds(at) / (60 * minutes)).cast("long")
