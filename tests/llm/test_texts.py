"""Language ID, decontamination, BPE, URLs, personal data, shards and the pipeline."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bpe, decontaminate, langid, pii, sharding, url_filter

ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !?"), (None, "the words of this"), (5, "x" * 30000)]


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 9)]
    odd = [(None if i is None else 1000 + i, t) for i, t in ODD]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in train + [(i, t, None) for i, t in odd] + [odd[0] + (None,)]], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(train) + len(odd) + 1
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by[1001] == [("und", 0.0)] * 2 and [by[1000 + i] for i in (2, 3, 4)] == [[("und", 0.0)]] * 3 and by[None][0][0] == "en" and by[1005][0][0] in ("en", "de")
    none = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identify(none, langid.fit(none)).first()["lang_pred"] == "und"
    assert langid.identify(none.limit(0), langid.fit(none)).count() == 0


def test_language_query_is_the_parse_by_hand(spark, sf):
    from tidemark.llm.queries import op3_language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parser = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.where("length(text) between 1 and 900").limit(40).collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in op3_language_id(spark, sf).collect()}
    mapped = lambda t: langid.symbols_of(np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t.lower().encode())]), parser.classes)[0].tobytes()
    samples = {lang: [mapped(t) for t in ts] for lang, ts in langid.sample(docs).items()}
    for i, t in texts.items():
        costs = []
        for lang, parts in sorted(samples.items()):
            s, at, n = mapped(t), 0, 0
            while at < len(s):
                k = 1
                while at + k < len(s) and any(s[at : at + k + 1] in p for p in parts):
                    k += 1
                at, n = at + k, n + 1
            costs.append((n * np.log2(sum(len(p) + 1 for p in parts) + 1), lang))
        assert got[i] == (min(costs)[1] if any(c.isalpha() for c in t) else "und"), (i, costs)


def test_restarts_change_no_prediction(spark, sf, monkeypatch):
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parser, texts = langid.fit(docs), pa.array([r["text"] for r in docs.collect()])
    names = parser.predict(texts)[0]
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    assert parser.predict(texts)[0] == names


def test_a_small_sample_is_no_handicap(spark):
    rng = random.Random(4)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, make("abcdefgh", 40), "big") for i in range(300)] + [(1000 + i, make("efghijkl", 40), "small") for i in range(6)]
    rows += [(2000 + i, make("efghijkl", 12), None) for i in range(50)] + [(3000 + i, make("abcdefgh", 12), None) for i in range(50)] + [(4000, "漢字だけの文章はここにない言語です。まったく知らない。", None), (4001, make("efghijkl", 40), "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, parser).collect()}
    assert sum(got[2000 + i] == "small" for i in range(50)) >= 48 and sum(got[3000 + i] == "big" for i in range(50)) >= 48
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_identified(docs, parser).collect()}
    assert 4000 not in kept and kept[4001] in ("small", "big") and len(kept) == len(rows) - 1


def test_automaton_parse_is_the_longest_match_parse():
    rng = random.Random(1)
    found = {k: ["".join(rng.choice(a) for _ in range(60)) for _ in range(3)] for k, a in (("x", "abcd"), ("y", "bcde"))}
    parser = langid.Parser(found)
    text = "".join(rng.choice("abcde") for _ in range(200))
    phrases, _ = parser.phrases(np.frombuffer(text.encode(), np.uint8), np.array([0, 200]))
    for row, name in zip(phrases, parser.languages, strict=True):
        at = n = 0
        while at < len(text):
            k = 1
            while at + k < len(text) and any(text[at : at + k + 1] in s for s in found[name]):
                k += 1
            at, n = at + k, n + 1
        assert row[0] == n


def greedy_coverage(item, text, least):
    """Words of item covered by tiles, longest first, by comparing all pairs of places anew for each tile."""
    item, text = np.asarray(item), np.asarray(text)
    same, total = item[:, None] == text[None, :], 0
    while True:
        run, best = np.zeros(len(text) + 1, int), (0, 0, 0)
        for i in range(len(item) - 1, -1, -1):  # run[j]: how far the words from i and j on are equal and free
            run[:-1] = np.where(same[i], run[1:] + 1, 0)
            run[-1] = 0
            j = int(np.argmax(run[:-1]))
            best = max(best, (int(run[j]), -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        same[i : i + k] = False
        same[:, j : j + k] = False
        total += k


@pytest.mark.parametrize("seed", range(6))
def test_tiles_are_real_and_do_not_overlap(seed):
    rng = random.Random(seed)
    item = np.array([rng.randint(1, 12) for _ in range(40)], np.uint64)
    text = np.concatenate([item[20:], np.array([99, 98], np.uint64), item[:20], np.array([rng.randint(1, 12) for _ in range(30)], np.uint64)])
    tiles = decontaminate.tile(item, text, 5)
    seen_a, seen_b = set(), set()
    for a, b, n in tiles:
        assert n >= 5 and (item[a : a + n] == text[b : b + n]).all()
        assert not seen_a & set(range(a, a + n)) and not seen_b & set(range(b, b + n))
        seen_a |= set(range(a, a + n))
        seen_b |= set(range(b, b + n))
    assert len(seen_a) == 40 == greedy_coverage(item.tolist(), text.tolist(), 5)


def test_tiles_keep_what_a_longer_tile_leaves():
    parts = [[f"{i}{j}" if j else "The" for j in range(6)] for i in range(5)]
    number = {w: n for n, w in enumerate(sorted({w for p in parts for w in p}), 1)}
    item, text = (np.array([number[w] for i in order for w in parts[i]], np.uint64) for order in (range(5), (1, 0, 3, 2, 4)))
    assert sum(t[2] for t in decontaminate.tile(item, text, 5)) == 29 == greedy_coverage(item.tolist(), text.tolist(), 5)


def test_tiles_of_moved_short_sentences_are_greedy():
    for seed in range(1000):
        rng = random.Random(seed)
        parts = [[rng.randint(1, 3)] + [10 * i + j for j in range(10, 10 + rng.randint(4, 8))] for i in range(1, 7)]
        item = [w for p in parts for w in p]
        rng.shuffle(parts)
        text = [w for p in parts + parts[:2] for w in p]
        if seed % 2:  # the front of one match is the end of another
            at = rng.randint(0, len(item) - 7)
            text = item[at : at + 7] + [9] + item[at + 5 : at + 5 + rng.randint(5, 9)] + [9] + text[: rng.randint(0, 30)]
        tiles = decontaminate.tile(np.array(item, np.uint64), np.array(text, np.uint64), 5)
        assert sum(t[2] for t in tiles) == greedy_coverage(item, text, 5), seed


def test_a_match_whose_front_is_taken_is_cut():
    item = list(range(1, 13))
    text = [*range(1, 8), 99, *range(6, 13)]
    assert sum(t[2] for t in decontaminate.tile(np.array(item, np.uint64), np.array(text, np.uint64), 5)) == 12


def test_decontamination_query_by_brute_force(spark, sf):
    from tidemark.llm.queries import op5_decontamination

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, number = set(), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = words(r["text"] or "")
        seeds = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item_id, item in items:
            if seeds & {tuple(item[i : i + 5]) for i in range(len(item) - 4)}:
                a, b = ([number.setdefault(w, len(number)) for w in ws] for ws in (item, text))
                n = greedy_coverage(a, b, 5)
                if n >= 0.8 * len(item):
                    want.add((r["doc_id"], item_id, n, len(item)))
    got = {tuple(r)[:4] for r in op5_decontamination(spark, sf).collect()}
    assert got == want and want


def test_contamination(spark):
    items = {10: [f"b{i}" for i in range(30)], 11: [f"c{i}" for i in range(40)], 12: ["a", "b", "c"]}
    fill = [f"f{i}" for i in range(500)]
    moved = items[10][18:] + ["zz"] + items[10][:18]
    rows = [(1, " ".join(fill[:50] + items[10] + fill[50:])), (2, " ".join(moved)), (3, " ".join(items[11][:28])), (4, " ".join(items[11][:32])), (5, "A b C"), (6, " ".join(fill)), (7, ", ".join(w.upper() for w in items[10])), (8, None), (9, ""), (None, " ".join(items[10]))]
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()] + [(13, None), (None, " ".join(fill[:20])), (14, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(brute.docs(spark, rows, extra=True), bench).collect()}
    assert got == {(1, 10), (2, 10), (4, 11), (7, 10), (None, 10)}
    kept = decontaminate.keep_clean(brute.docs(spark, rows, extra=True), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 8, 9] and kept.columns == ["doc_id", "text", "part", "ids", "keys"]
    assert decontaminate.contamination(brute.docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(brute.docs(spark, rows), bench.limit(0)).count() == 0


def test_contamination_in_several_passes(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    once = sorted(decontaminate.contamination(docs, bench).select("doc_id", "item_id").collect())
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2000)
    assert once and sorted(decontaminate.contamination(docs, bench).select("doc_id", "item_id").collect()) == once
    odd = docs.unionAll(docs.where("doc_id < 5")).withColumn("name", F.lit(1)).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    bad = {r["doc_id"] for r in decontaminate.contamination(docs, bench).collect()}
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - len(bad) - len({i for i in bad if i < 5})


def test_bpe(spark, sf):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    vocab = bpe.vocabulary(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [*ODD, (6, "don't 'sabc  \n x\t"), (7, "日本語 😀😀 á\u0301"), (8, "<|endoftext|>"), (8, "<|endoftext|>")]
    got = {}
    for r in bpe.encode_documents(brute.docs(spark, rows, extra=True), path, P.PATTERN).collect():
        got.setdefault(r["doc_id"], []).append((np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"])))
    for i, t in rows:
        assert (enc.encode_ordinary(t or ""), (t or "").encode()) in got[i]
    d = bpe.digests(brute.docs(spark, [(1, "a b"), (2, None)]), path, P.PATTERN).collect()
    ids = np.array(enc.encode_ordinary("a b"), "<u4").tobytes()
    assert tuple(d[0]) == (1, 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"a b").hexdigest()) and d[1]["n_tokens"] == 0
    assert bpe.digests(brute.docs(spark, []), path, P.PATTERN).count() == 0


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    made = []
    kept = bpe.Pieces(lambda p: made.append(p) or list(p))
    for i in range(100):
        assert kept[f"p{i % 12}"] == np.array(list(f"p{i % 12}".encode()), "<u4").tobytes()
        assert kept["x" * 1000] == np.full(1000, 120, "<u4").tobytes()
    assert len(kept) + len(kept.old) <= 20 and "x" * 1000 not in kept and made.count(b"p1") < 9


def test_bpe_appends_and_edits():
    P = pytest.importorskip("public_tokenizers")
    vocab = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    for _ in range(60):
        s = bytes(rng.choice(b"thanedbl -") for _ in range(rng.randint(1, 400)))
        table = bpe.PrefixTable(vocab, s[:50]).append(s[50:])
        assert table.ids() == vocab.encode_piece(s) and bpe.merged(s, vocab.ranks) == table.ids()
        a = rng.randint(0, len(s))
        b = rng.randint(a, min(len(s), a + 5))
        made = table.edit(a, b, b"xth")
        assert table.ids() == vocab.encode_piece(s[:a] + b"xth" + s[b:])
        assert made <= len(table.piece)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_urls(spark):
    urls = ["http://Example.com/en/x", "http://www.example.com/en/", "http://a.www.EXAMPLE.com/en/?q", "http://badexample.com/en/", "http://x.net/es/1#t", "http://x.net?/es/", "ftp://net/es/", None, "no scheme", "http://y.org/a", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int"), RULES).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("com/", "allow") and got[4] == ("x.net", "/es/1", "net/es/", "block") and got[5] == ("x.net", "", None, "allow") and got[6][2] == "net/es/"
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("y.org", "/a", None, "allow") and got[10][:2] == ("b:", "//c/d")


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.x.org", 1)] * 80 + [("new.x.org", 1)] + [(f"h{i}.y{i}.org", 0) for i in range(200)] + [("good.z.org", 0)] * 50
    pages = spark.createDataFrame([(i, f"http://{h}/", b) for i, (h, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages.select("page_id", "url"), pages.select("page_id", "bad"), []).collect()}
    assert got["bad.x.org"] == "block" and got["good.z.org"] == "allow" and got["h1.y1.org"] == "allow"
    assert url_filter.judge(pages.limit(0).select("page_id", "url"), pages.select("page_id", "bad"), []).count() == 0


def test_hosts_without_labels_have_their_domains_bound(spark):
    rows = [("a.evil.org", 1)] * 200 + [(f"h{i}.y{i}.org", 0) for i in range(200)] + [("a.fine.bad", 1)] * 30 + [("b.evil.org", None), ("new.z.org", None), ("c.new.bad", None), ("x.unseen", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/", b) for i, (h, b) in enumerate(rows)], "page_id long, url string, bad int")
    outcomes = pages.where("bad is not null").select("page_id", "bad")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages.select("page_id", "url"), outcomes, []).collect()}
    assert got["a.evil.org"] == got["b.evil.org"] == "block" and got["new.z.org"] == got["h1.y1.org"] == "allow"
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"), "bad")
    by = {r["host"]: r for r in url_filter.reputations(hosts, hosts).collect()}
    assert by["b.evil.org"]["n"] == 0 and by["b.evil.org"]["mean"] > 0.9 and by["c.new.bad"]["mean"] > by["x.unseen"]["mean"]
    assert by["x.unseen"]["mean"] == pytest.approx(230 / 430) and by["c.new.bad"]["lower"] <= by["c.new.bad"]["mean"]


PII_TEXTS = ["a@b.c%d@e.f x@y.com. 1.2.3.4.5 12.34.56.78.90", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "😀 foo@bar.baz 0001.02.3.4 999.1.1.1", "+1 (23) 456-7890. +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "1 2 3 4 4 5 5 6 7 8 9 0 1 2 3 4 5", "x" * 5000 + "@" + "y" * 300 + ".z", "9" * 3000, "a@b", ".".join("1" * 40), "a.b@c-.-d..e@f.g"]


def test_base_spans(spark):
    rows = [*enumerate(PII_TEXTS), (90, None), (91, ""), (None, "me@you.org"), (92, PII_TEXTS[0]), (92, PII_TEXTS[0])]
    got = {r["doc_id"]: r for r in pii.find(brute.docs(spark, rows, extra=True)).collect()}
    for i, t in rows:
        found = brute.personal(t)
        text = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k])
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(found[k]) for k in pii.KINDS]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert pii.find(brute.docs(spark, [])).count() == 0


def test_contexts_find_what_the_expressions_miss(spark):
    rows = [(i, f"hello kontakt: user{i}@mail{i}.org bye") for i in range(20)] + [(50, "kontakt: hidden@localhost end"), (51, "other: hidden2@localhost end")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(brute.docs(spark, rows)).collect()}
    assert got[50] == "email:9:25" and got[51] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(brute.docs(spark, rows, extra=True)).collect()}
    assert text[50] == "kontakt: <email> end" and text[51] == rows[-1][1] and text[3] == "hello kontakt: <email> bye"


def test_contexts_find_numbers_in_groups(spark):
    def card(i):
        d = f"411111111111{i:03d}"
        return d + next(c for c in "0123456789" if brute.luhn(d + c))

    numbers = ["(555) 123-4567", "030 1234 5678", "030.1234 567"]
    rows = [(i, f"ring +4930{i:07d} now") for i in range(40)] + [(100 + i, f"number: {card(i)} ok") for i in range(40)]
    rows += [(200 + i, f"ring {n} now") for i, n in enumerate(numbers)] + [(210, "number: 1234 5678 9012 3456 ok"), (211, "ring 030 1234 5678 9.8.7.6 now"), (212, "other 030 1234 5678 then"), (213, "other 030 1234 5679 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(brute.docs(spark, rows)).collect()}
    assert [got[200 + i] for i in range(3)] == [f"phone:5:{5 + len(n)}" for n in numbers]
    assert got[210] == "card:8:27" and got[211] == "ip:19:26,phone:5:18" and got[212] == "" and got[213] == "phone:6:19"
    text = {r["doc_id"]: r["text"] for r in pii.redact(brute.docs(spark, rows)).collect()}
    assert text[200] == "ring <phone> now" and text[210] == "number: <card> ok"


def test_believed_values_support_further_patterns(spark):
    rows = [(i, f"kontakt: user{i}@mail{i}.org bye") for i in range(80)]
    rows += [(100 + i, f"kontakt: hidden{i}@localhost end") for i in range(5)] + [(200 + i, f"write hidden{i}@localhost end") for i in range(5)] + [(300, "about hidden1@localhost then")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(brute.docs(spark, rows)).collect()}
    assert got[100] == "email:9:26" and [got[200 + i] for i in range(5)] == ["email:6:23"] * 5 and got[300] == ""


def test_time_grows_with_length(spark):
    texts = [" ".join(f"x{i}y 4{i:05d}" for i in range(20000)), " ".join(f"{i:05d}" for i in range(40000)), " ".join(f"u{i}@m{i}.org," for i in range(20000)), "1 " * 150000, "+1 (23) 456-7890 a " * 15000]
    docs = brute.docs(spark, list(enumerate(texts))).repartition(5)
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    new = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert time.time() - began < 150  # quadratic work takes many minutes
    for i, t in enumerate(texts):
        found = brute.personal(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(found[k]) for k in pii.KINDS]
    assert new[2] == ", ".join(["<email>"] * 20000) + "," and new[3] == texts[3] and new[4] == "<phone> a " * 15000


def test_discoveries_are_right_and_whole(spark):
    rng = random.Random(2)
    vowels = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    filler = lambda n: " ".join(vowels() for _ in range(n))
    rows, planted = [], set()
    cues = {"phone": ["ring", "call us on"], "email": ["mailto:", "contact address"], "ip": ["host", "server at"]}
    make = {"phone": (lambda i: f"+49 30 {1000000 + i}", lambda i: f"030 {1000 + i} {5000 + i}"), "email": (lambda i: f"u{i}@site{i % 7}.org", lambda i: f"u{i}@intranet{i % 5}"), "ip": (lambda i: f"10.{i % 200}.3.4", lambda i: f"10:{i % 200}:3:{i % 250}")}
    for i in range(900):
        kind = rng.choice(list(cues))
        cue, seen = rng.choice(cues[kind]), i % 9 != 0
        front = f"{filler(rng.randint(1, 12))} {cue} "
        value = make[kind][0 if seen else 1](i)
        rows.append((i, f"{front}{value} {filler(5)} {rng.choice(['page', 'item', 'in'])} {rng.randint(1000, 10**9)} {filler(3)}"))
        if not seen:
            planted.add((i, f"{kind}:{len(front)}:{len(front) + len(value)}"))
    got = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in pii.find(brute.docs(spark, rows)).collect()}
    found = set()
    for i, t in rows:
        base = brute.personal(t)
        found |= {(i, x) for x in got[i][0].split(",") if x and x not in {f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]}}
    hits = len(found & planted)
    assert hits / len(planted) >= 0.9 and hits / len(found) >= 0.9, (hits, len(planted), len(found))


def test_overlapping_spans_are_replaced_together(spark):
    text = "ab" * 600 + "0123456789" + "cd" * 3000
    spans = "array(named_struct('kind', 1, 'start', 1203, 'end', 1206), named_struct('kind', 0, 'start', 1200, 'end', 1204), named_struct('kind', 2, 'start', 1205, 'end', 1210), named_struct('kind', 3, 'start', 7000, 'end', 7002))"
    got = spark.createDataFrame([(text,)], "text string").select(pii.replaced(F.col("text"), F.expr(spans))).first()[0]
    assert got == "ab" * 600 + "<email>" + ("cd" * 3000)[: 7000 - 1210] + "<phone>" + ("cd" * 3000)[7002 - 1210 :]


def test_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)] + [(None, None), (7, "text 7")]
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=6000, first_tier_bytes=500, fan_in=3)
    docs = brute.docs(spark, rows, extra=True)
    for k in range(8):
        store.append(docs.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 8 == k).coalesce(1))
    assert store.version() == 8 and store.append(docs.limit(0)) == 8
    before = sorted((tuple(r) for r in store.read().select("doc_id", "text").collect()), key=repr)
    assert before == sorted(rows, key=repr)
    version = store.compact()
    assert version > 8 and store.plan().isEmpty()
    assert sorted((tuple(r) for r in store.read().select("doc_id", "text").collect()), key=repr) == before
    assert store.read(8).count() == len(rows)  # an older version can still be read
    manifest = store.manifest().collect()
    assert sum(r["rows"] for r in manifest) == len(rows) and len(manifest) < 8
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(), version)
    assert store.vacuum() > 0 and store.read().count() == len(rows)


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    rows = brute.docs(spark, [(1, "a"), (2, "b")])
    one, two = (sharding.Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.version = two.version = lambda: 0  # both looked before either wrote
    assert one.append(rows.where("doc_id = 1")) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        two.append(rows.where("doc_id = 2"))
    assert not one._publish("x", one._name(1)) and one._publish("x", one._name(2))
    store = sharding.Store(spark, str(tmp_path / "s"))
    assert [r["doc_id"] for r in store.read(1).collect()] == [1]


def planned(shards, target, fan_in):
    """shards of (name, bytes, tier, born): sets of names to be merged, by hand."""
    out = set()
    for tier in {t for _, _, t, _ in shards}:
        mine = sorted((s for s in shards if s[2] == tier and s[1] * 2 <= target), key=lambda s: (s[3], s[0]))
        if len(mine) < fan_in:
            continue
        groups, at = {}, 0
        for name, size, *_ in mine:
            groups.setdefault((at + size / 2) // target, []).append(name)
            at += size
        out |= {tuple(g) for g in groups.values() if len(g) > 1}
    return out


def test_plan_is_the_one_made_by_hand(spark, tmp_path):
    rng = random.Random(5)
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=1000, first_tier_bytes=100, fan_in=3)
    shards = [(f"shards/{i:03d}", rng.choice([20, 90, 150, 350, 480, 700, 1000]), rng.randint(0, 2), rng.randint(1, 5)) for i in range(60)]
    store._commit(spark.createDataFrame([(n, b, 1, t, v) for n, b, t, v in shards], sharding._MANIFEST), 1)
    got = {}
    for r in store.plan().collect():
        got.setdefault(r["target"], []).append(r)
    born = {n: v for n, _, _, v in shards}
    assert {tuple(r["shard"] for r in sorted(g, key=lambda r: (born[r["shard"]], r["shard"]))) for g in got.values()} == planned(shards, 1000, 3)
    assert all(sum(r["bytes"] for r in g) < 2 * 1000 for g in got.values())


def test_shard_documents(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("tier", F.lit("x"))
    got = sharding.shard_documents(docs, str(tmp_path / "d"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert set(got.columns) == {*docs.columns, "document_tier", "arrival", "shard", "version"}
    store = sharding.Store(spark, str(tmp_path / "d"))
    assert store.version() > sharding.ARRIVALS and store.manifest(sharding.ARRIVALS).count() > store.manifest().count() and store.plan().isEmpty()
    assert store.manifest(3).agg(F.max("born")).first()[0] == 3
    assert sharding.shard_documents(docs.limit(0), str(tmp_path / "e")).count() == 0
    odd = brute.docs(spark, [(None, None), (None, "x"), (-1, ""), (-1, "")], extra=True)
    assert sorted((tuple(r) for r in sharding.shard_documents(odd, str(tmp_path / "f")).select("doc_id", "text", "arrival").collect()), key=repr) == [(-1, "", 15)] * 2 + [(None, "x", 0), (None, None, 0)]


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {d for d, t in rows if any(c.isalpha() for c in t)}
    kept &= {d for d, _, c in brute.jaccard([(d, t) for d, t in rows if d in kept]) if d == c}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept -= {r["doc_id"] for r in decontaminate.contamination(docs, bench).collect()}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == kept
    stage_docs = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, sf)
        assert stage_docs.columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], docs.schema)
        assert stage(spark, empty, sf).count() == 0, name
