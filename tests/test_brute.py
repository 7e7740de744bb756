"""Queries that SQL can hardly say, against plain Python over whole small tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.tilt import TiltConfig
from tidemark.plans import documents, events, markets


def test_ols_robust(spark, sf):
    rows = markets.daily_signals(spark, sf).toPandas()
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows["volume"]), rows["top"]])
    y = rows["s"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    cov = inv @ (x.T * e**2) @ x @ inv * len(y) / (len(y) - 3)
    got = {r["term"]: r for r in markets.R.queries["ols_robust"](spark, sf).collect()}
    assert len(got) == 3
    for name, b, v in zip(("intercept", "log_volume", "top"), beta, np.diag(cov), strict=True):
        r = got.get(name) or got.get("const")
        assert r["beta"] == pytest.approx(b, rel=1e-6) and r["t"] == pytest.approx(b / math.sqrt(v), rel=1e-6)


def halved(shape, low, high, total):
    a, b = 0.0, 1e6
    for _ in range(300):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(m * shape, low, high).sum() < total else (a, m)
    return np.clip(b * shape, low, high)


def goals(spark, sf):
    c, out = TiltConfig(max_weight=0.5), {}
    panel = markets.filled_index(spark, sf).toPandas()
    for day, g in panel.groupby("date"):
        g = g.sort_values("ticker")
        parent, sector = g["parent"].to_numpy(), g["sector"].to_numpy()
        raw = parent * np.exp(c.strength * g["sentiment"].clip(-1, 1).to_numpy())
        raw = raw / raw.sum()
        low, high = c.min_multiple * parent, np.minimum(c.max_multiple * parent, c.max_weight)
        names = sorted(set(sector))
        total = lambda v: np.array([v[sector == n].sum() for n in names])
        shares = halved(total(raw), np.maximum(total(low), total(parent) - c.sector_band), np.minimum(total(high), total(parent) + c.sector_band), 1.0)
        for n, share in zip(names, shares, strict=True):
            mine = sector == n
            for t, w in zip(g["ticker"][mine], halved(raw[mine], low[mine], high[mine], share), strict=True):
                out[day, t] = w
    return out


def test_bounded_weights_and_index_backtest(spark, sf):
    want = goals(spark, sf)
    got = {(r["date"], r["ticker"]): r["target"] for r in markets.R.queries["bounded_weights"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    c = TiltConfig(max_weight=0.5)
    s = {(r["day"], r["ticker"]): r["s"] for r in markets.filled_grid(spark, sf).collect()}
    days, names = sorted({d for d, _ in s}), sorted({t for _, t in s})
    rows = {(r["strategy"], r["date"]): (r["net"], r["turnover"]) for r in markets.R.queries["index_backtest"](spark, sf).collect()}
    for strategy in ("tilted", "equal"):
        w = np.full(len(names), 1 / len(names))
        for i, d in enumerate(days):
            ret = np.array([(s[days[i + 1], t] - s[d, t]) / 50 if i + 1 < len(days) else 0.0 for t in names])
            goal = np.array([want[d, t] if strategy == "tilted" else 0.2 for t in names])
            move = np.where(np.abs(goal - w) >= c.no_trade, goal - w, 0.0)
            if np.abs(move).sum():
                move = move - move.sum() * np.abs(move) / np.abs(move).sum()
            turnover = np.abs(move).sum() / 2
            if turnover > c.max_turnover:
                move, turnover = move * c.max_turnover / turnover, c.max_turnover
            w = w + move
            assert rows[strategy, d] == pytest.approx(((1 - turnover * c.cost_bps / 1e4) * (1 + w @ ret) - 1, turnover), abs=1e-9)
            w = w * (1 + ret) / (w * (1 + ret)).sum()
    assert len(rows) == 2 * len(days)


def test_story_clusters(spark, sf):
    got = {r["doc_id"]: r["cluster_id"] for r in documents.R.queries["story_clusters"](spark, sf).collect()}
    found, live = {}, {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        v, at = np.array(r["embedding"], float), r["vec_id"] * 60
        v = v / max(np.linalg.norm(v), 1e-12)
        shard = live.setdefault(r["label"], [])
        shard[:] = [c for c in shard if c["last"] >= at - 7200]
        sims = [(float(c["sum"] @ v / max(np.linalg.norm(c["sum"]), 1e-12)), -i) for i, c in enumerate(shard)]
        best = max(sims, default=(-1.0, 0))
        if best[0] >= 0.86:
            c = shard[-best[1]]
        else:
            shard.append(c := {"id": str(r["vec_id"]), "sum": np.zeros(len(v)), "last": at})
        c["sum"], c["last"] = c["sum"] + v, at
        found[str(r["vec_id"])] = c["id"]
    assert got == found


def test_entity_mentions(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect():
        t = r["text"] or ""
        edge = r"(?<![A-Za-z0-9]){}(?![A-Za-z0-9])"
        found = [(m.start(), -m.end(), "E1", "alias") for w in ("the of", "the") for m in re.finditer(edge.format(w), t, re.IGNORECASE)]
        found = [f for f in found if not any(m.start() <= f[0] and -f[1] <= m.end() for m in re.finditer("in the", t))]
        found += [(m.start(), -m.end(), "E2", "exact") for w in ("Der", "Die") for m in re.finditer(edge.format(w), t)]
        if r["source"] == "src0" or re.search("price|tion", t, re.IGNORECASE):
            found += [(m.start(), -m.end(), "E3", "ambiguous") for w in ("une", "la") for m in re.finditer(edge.format(w), t)]
        end = 0
        for a, b, who, via in sorted(found):
            if a >= end:
                end = -b
                n, docs = want.setdefault((who, via), (0, set()))
                want[who, via] = (n + 1, docs | {r["doc_id"]})
    got = {(r["entity"], r["via"]): (r["mentions"], r["docs"]) for r in documents.R.queries["entity_mentions"](spark, sf).collect()}
    assert got == {k: (n, len(d)) for k, (n, d) in want.items()}


def test_stress_situations(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).orderBy("at", F.col("user_id").cast("string")).collect()
    want, open_, of = set(), {}, {}
    for r in rows:
        kind, impact, reports, at, name = r["event_type"], r["value"] / 10, int(r["value"]), r["at"], str(r["user_id"])
        if impact <= 7:
            continue
        keys = {f"K{r['user_id'] % 7}"} if r["value"] < 95 else set()
        live = open_.setdefault(kind, [])
        live[:] = [s for s in live if at - s["seen"] <= 48 * 3600]
        mine = next((s for s in live if s["id"] == of.get((kind, name))), None)
        if mine and keys and mine["keys"] and not keys & mine["keys"]:
            mine = None
        if mine is None:
            shared = [s for s in live if keys & s["keys"]]
            mine = shared[0] if shared else live[-1] if live and not keys else None
        why = None
        if mine is None:
            mine, why = {"id": name, "keys": keys, "impact": impact, "reports": reports}, "new"
            live[:] = [s for s in live if s["id"] != name] + [mine]
        elif keys and impact >= mine["impact"] + 0.75:
            why = "impact"
        elif keys and reports >= 60 and reports >= 1.8 * mine["reports"]:
            why = "coverage"
        mine["seen"], of[kind, name] = at, mine["id"]
        if why:
            mine["impact"], mine["reports"] = max(mine["impact"], impact), reports
            want.add((kind, name, at, mine["id"], why))
    assert {tuple(r) for r in events.R.queries["stress_situations"](spark, sf).collect()} == want and want


def test_index_trades(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).orderBy("at", F.col("user_id").cast("string")).collect()
    want, state = set(), {}
    for r in rows:
        s = state.setdefault(r["event_type"], {"now": {}, "then": {}, "acted": set(), "due": False, "last": None})
        name, tone = str(r["user_id"]), r["value"] / 50 - 1
        s["now"][name] = tone
        if abs(tone - s["then"].get(name, 0.0)) >= 0.2:
            s["due"] = True
        elif r["value"] / 10 >= 7 and r["event_id"] not in s["acted"]:
            s["acted"].add(r["event_id"])
            s["due"] = True
        waited = math.inf if s["last"] is None else r["at"] - s["last"]
        why = "initial" if s["last"] is None else "tactical" if s["due"] and waited >= 900 else "scheduled" if waited >= 3600 else None
        if why:
            s.update(then=dict(s["now"]), due=False, last=r["at"])
            want.add((r["event_type"], r["at"], why))
    assert {tuple(r) for r in events.R.queries["index_trades"](spark, sf).collect()} == want and want


def test_price_mentions(spark, sf):
    want = {"THE": [0, 0], "THAT": [0, 0]}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        ws = re.findall(r"[a-z0-9&$%.]*[a-z0-9%]", (r["text"] or "").lower())
        for name in want:
            votes = 0
            for i, w in enumerate(ws):
                if w != name.lower():
                    continue
                vote = None
                for x in ws[i + 1 : i + 5]:
                    if x == "was":
                        vote = 0
                    elif x in ("in", "on"):
                        vote = 1
                    elif x in ("for", "is"):
                        vote = -1
                    elif x in ("and", "of", "the", "that") or x[0].isdigit():
                        continue
                    break
                if vote is None:
                    front = [x for x in ws[max(0, i - 3) : i] if x not in ("a", "in", "of", "the")][-1:]
                    vote = 1 if front and front[0] == "on" else -1 if front and front[0] in ("for", "is") else 0
                votes += vote
            if votes:
                want[name][votes < 0] += 1
    got = {r["price"]: [r["up"], r["down"]] for r in documents.R.queries["price_mentions"](spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if any(v)}
