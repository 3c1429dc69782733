"""The training-data operators against brute force, other implementations and exact round trips, on small tables with the odd cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import bpe, embed, exact, graph, html, licenses, neardup, packing, sharding, toxicity, warc

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, keep_id string, score string, sequence_id string"


def docs(spark, texts):
    """With extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


WORDS = ["alpha", "beta,", "gamma", "delta.", "Ünï", "日本", "x1", "don't", "#!", "idiot"]


def texts(n=60, seed=5):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    for t in out[:10]:  # near copies, and copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out += [" ".join(w), t, t + "  \n"]
    return [*out, "", None, "   ", "a" * 3000, "one", "ONE", " ".join(out)]


def test_bpe_is_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    ts = texts() + ["".join(rng.choice("ab \n\t'sé日1.#\x1c\x85 ") for _ in range(200)) for _ in range(50)]
    df = docs(spark, ts)
    out = bpe.encode(df, path, P.PATTERN)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(ts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r["doc_id"]: r["text"] for r in bpe.decode(out, path, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(ts)}
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}?a=b c", "<p>" + "x" * (i % 5 * 60)) for i in range(40)] + [(100, None, None), (101, "u", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("first", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        same = min(j for j, _, g in rows if (g or "") == (h or ""))
        refers = same if len(raw) >= 100 and same != i else None
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), refers)
    w = warc.BundleWriter()
    for i in range(5):
        w.add(str(i).encode(), warc.warc_record(i, "u", b"z" * 200_000, hashlib.sha256(b"z" * 200_000).hexdigest()))
    raw = w.to_bytes()
    r = warc.BundleReader(lambda at, n: raw[at : at + n], len(raw))
    assert len(r.frames) == 5 and warc.parse_record(r.record(b"3"))["page_id"] == 3


def test_warc_keeps_repeated_rows(spark, tmp_path):
    import pyarrow.fs as pafs

    rows = [(1, "u", "a" * 150)] * 3 + [(None, None, "b")] * 2 + [(None, "v", "a" * 150), (1, "u", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_archives(manifest, f"file://{tmp_path}/w").collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted([("1", 150, "response", None)] * 3 + [("None", 1, "response", None)] * 2 + [("None", 150, "revisit", 1), ("1", 1, "response", None)])
    (path, size) = manifest.select("path", "size").first()
    raw = pafs.LocalFileSystem().open_input_file(path).read()
    reader = warc.BundleReader(lambda at, n: raw[at : at + n], size)
    assert len(reader.index) == len(reader.order) == 7
    assert all(warc.parse_record(reader.record(name)) and f"<{name.decode()}>".encode() in reader.record(name) for name in reader.index)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    chain = []
    for n in range(40):  # a group of near copies that isn't one star
        w = list(base)
        for _ in range(n % 9):
            w[rng.randrange(80)] = f"v{rng.randint(0, 99)}"
        chain.append(" ".join(w))
    ts = texts() + chain
    sets = []
    for t in ts:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in (t or "")).split() if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    want = brute_components(range(len(ts)), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    got = neardup.near_duplicates(docs(spark, ts), words=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}


def test_near_duplicates_without_ids(spark):
    """No id, one id on two texts, one row twice, copies with and without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, b + " end"), (7, c), (7, d), (7, d), (9, c), (3, d), (None, d), (None, None), (5, " ")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=5).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == sorted(
        [("None", 26, "None", True)] * 3 + [("None", 27, "None", True), ("7", 26, "7", True), ("9", 26, "7", False), ("3", 26, "3", True), ("None", 26, "3", False), ("None", 0, "None", True), ("5", 0, "5", True)] + [("7", 26, "3", False)] * 2
    )


def test_blocks_give_all_links(spark):
    """The third turn alone, from members that share buckets but no component."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    ts = []
    for _ in range(30):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(100)] = f"v{rng.randint(0, 999)}"
        ts.append(" ".join(w))
    df = docs(spark, ts).select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("mark"))
    sigs = neardup.signatures(df, 2)
    multi = neardup._bands(sigs)
    none = spark.createDataFrame([], "id bigint, component bigint")
    own, mixed = neardup._mixed(multi, none)
    links = neardup._rest(own, mixed, sigs, neardup._Sets(df, sigs.select("id", F.col("id").alias("low"), "mark", "set_key"), 2), 0.8, 80)
    sets = neardup.shingles(ts, 2)
    near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    found = {(r["a"], r["b"]) for r in links.collect()}
    assert all(near(a, b) for a, b in found)
    assert brute_components(range(30), lambda i, j: (i, j) in found or (j, i) in found) == brute_components(range(30), near)


def test_registers_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 63, 40).astype(np.uint64)])
    r = neardup.registers([np.unique(a), np.unique(b), np.unique(a)[:3]])
    assert abs(neardup.estimate(r[0], r[1]) - 360 / 440) < 0.15 and neardup.estimate(r[0], r[0]) > 0.99


def test_exact_duplicates(spark):
    ts = texts()
    norm = ["".join((t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})) for t in ts]
    for r in exact.exact_duplicates(docs(spark, ts)).collect():
        own = [i for i, n in enumerate(norm) if n == norm[r["doc_id"]]]
        keep = min(own, key=lambda i: (-len(ts[i] or ""), i))
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(own), keep == r["doc_id"], hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest())


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(4)
    q = exact.CountingQuotientFilter
    parts = [np.unique(rng.integers(0, 1 << 61, 500).astype(np.uint64), return_counts=True) for _ in range(3)]
    parts.append((parts[0][0][:50], np.full(50, 7)))
    merged = q.merge([q.from_bytes(q.build(k, c, 3).to_bytes()) for k, c in parts], 0)
    keys, counts = merged.items(0)
    want: dict = {}
    for k, c in parts:
        for x, n in zip(k.tolist(), c.tolist()):
            want[x] = want.get(x, 0) + n
    assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ts = [*texts(), "a<|endoftext|>b", "<|startoftext|> A <|ENDOFTEXT|> " + "x y " * 100 + "<|endoftext|>"]
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in ts]
    got = packing.pack_documents(docs(spark, ts), path, capacity=64).collect()
    places: dict = {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + 64]
        assert r["start"] == 64 * r["piece"] and r["length"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.1 * sum(map(len, ids)) / 64 + 1
    bins: list[int] = []  # offline: the largest first, each to the fullest place, without a bound on what is open
    for n in sorted((r["length"] for r in got), reverse=True):
        fits = [i for i, used in enumerate(bins) if used + n <= 64]
        if fits:
            bins[max(fits, key=bins.__getitem__)] += n
        else:
            bins.append(n)
    assert len(places) <= 1.05 * len(bins) + 1


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, most=2)
    assert [b.place(n)[0] for n in (6, 7, 8, 4, 3)] == [0, 1, 2, 0, 3]


def walked(ids, cells, shards, vnodes=64):
    """(shard, slot) of rows, one by one: each arc's rows in order, what finds no room goes on to the next node, a node further each round."""
    nodes = sharding.ring(shards, vnodes)
    queue: dict = {}
    for i in sorted(range(len(ids)), key=lambda i: (cells[i], ids[i])):
        queue.setdefault(next((a for a, (c, _) in enumerate(nodes) if c >= cells[i]), 0), []).append(i)
    wrapped = queue.get(0, [])  # the first arc has the cells up to its node, and those past the last node
    queue[0] = [i for i in wrapped if cells[i] <= nodes[0][0]] + [i for i in wrapped if cells[i] > nodes[0][0]]
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    out, used = {}, [0] * shards
    for step in range(len(nodes)):
        for arc in range(len(nodes)):
            shard, rest = nodes[(arc + step) % len(nodes)][1], queue.get(arc, [])
            while rest and used[shard] < room[shard]:
                out[rest.pop(0)] = (shard, used[shard])
                used[shard] += 1
    return out


def test_sharding(spark):
    ts = texts(300)
    df = docs(spark, ts)
    cells = [r[0] for r in df.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(sharding.CELLS))).collect()]
    placed = {}
    for shards, hot in ((40, 100_000), (41, 100_000), (7, 100_000)):
        got = sharding.shard_rows(df, shards=shards, hot=hot).collect()
        want = walked(range(len(ts)), cells, shards)
        placed[shards] = {r["doc_id"]: r["shard"] for r in got}
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want and len(got) == len(ts)
        for r in got:
            t = (ts[r["doc_id"]] or "").encode()
            assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "rows"
    edited = sharding.shard_rows(df.withColumn("text", F.concat("text", F.lit("!"))), shards=40).collect()
    assert {r["doc_id"]: r["shard"] for r in edited} == placed[40]  # the id decides


def test_sharding_moves_little():
    """From 40 to 41 shards: what the new shard takes and what overflows differently."""
    rng = random.Random(3)
    cells = [rng.randrange(sharding.CELLS) for _ in range(4000)]
    a, b = walked(range(4000), cells, 40), walked(range(4000), cells, 41)
    assert sum(a[i][0] != b[i][0] for i in a) / 4000 < 0.35  # a hash modulo the number of shards: 0.98


def test_sharding_of_a_hot_id(spark):
    rows = [(5, f"t{i % 3}") for i in range(500)] + [(None, None)] * 200 + [(i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sharding.shard_rows(df, shards=9, hot=50).collect()
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 1000 and sorted(map(len, slots.values())) == [111] * 8 + [112]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), 16 + len(t or "")) for i, t in rows)


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 16))
    rows = [v + rng.normal(size=16) * 0.2 for v in base for _ in range(15)] + [base[0], base[0], base[0] * 2]
    rows = [[float(np.float32(x)) for x in r] for r in rows] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>").withColumn("key", F.lit(1))
    good = [i for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)]

    def linked(i, j):
        if i not in good or j not in good or len(rows[i]) != len(rows[j]):
            return False
        a, b = np.array(rows[i]), np.array(rows[j])
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9

    got = {r["vec_id"]: r for r in embed.near_vectors(df).collect()}
    n = len(rows)
    want = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    assert sum(got[i]["n_links"] for i in range(n)) >= 0.98 * sum(want) and all(got[i]["n_links"] <= want[i] for i in range(n))
    comp = brute_components(range(n), linked)
    assert sum(got[i]["component_id"] == comp[i] for i in range(n)) >= n - 1


def test_vectors_without_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(None, a), (None, b), (None, b), (7, a), (7, b), (9, c), (None, None), (7, b), (4, [0.0, 0.0, 1.0])]
    got = embed.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    want = [("None", 2, "7", False), ("None", 3, "7", False), ("None", 3, "7", False), ("7", 2, "7", True), ("7", 3, "7", True), ("9", 2, "7", False), ("None", 0, "None", True), ("7", 3, "7", True), ("4", 0, "4", True)]
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == sorted(want)


def test_vectors_of_large_buckets(spark):
    """More rows in a bucket than a block holds, at two lengths, against brute force."""
    rng = np.random.default_rng(12)
    rows = [rng.normal(size=8) * 0.12 + np.eye(8)[i % 2] for i in range(1300)] + [rng.normal(size=5) * 0.1 + 1 for _ in range(80)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in embed.near_vectors(df).collect()}
    want = np.zeros(len(rows), np.int64)
    for a, b in ((0, 1300), (1300, 1380)):
        unit = np.array(rows[a:b])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        want[a:b] = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() and want[:1300].max() > 300


def test_toxicity_learns_stems(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        w = [rng.choice("la de mi so fa re ti do".split()) + rng.choice("xyz") for _ in range(40)]
        if i % 3 == 0:
            w[rng.randrange(40)] = "grumble" + rng.choice("abcdefgh")
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    rows += [(1000, None, None), (1001, "", None), (1002, "   ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    out = toxicity.toxicity(df.select("doc_id", "text", F.lit(0).alias("score")), df.select("doc_id", "toxic")).collect()
    labels = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and labels[r["doc_id"]] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.9
    none = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0)).collect()
    assert all(r["predicted"] == 0 for r in none)


def test_toxicity_sample_is_balanced(spark, monkeypatch):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:1040]
    docs = spark.createDataFrame([(i, f"text number {i}") for i in ids], "id bigint, text string")
    labels = spark.createDataFrame([(i, int(n < 40)) for n, i in enumerate(ids)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", lambda bags, own, weights: seen.append((len(bags), own, weights)))
    for sample, toxic in ((60, 30), (500, 40), (5000, 40), (1, 0)):
        toxicity.train(docs, labels, sample)
        n, own, weights = seen.pop()
        assert n == min(sample, 1040) and own.sum() == toxic
        for label, all_rows in ((0, 1000), (1, 40)):
            if (own == label).any():
                assert abs(weights[own == label].sum() - all_rows) < 1e-6
    toxicity.train(docs, labels.where("toxic > 1"))
    assert seen.pop()[0] == 0


def test_toxicity_reads_long_words():
    """A passage behind the first 64 characters of a text without blanks counts as one before them."""
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[zlib.crc32("混账东西".encode()) % toxicity.BUCKETS] = 500 * (1 + toxicity.PRIOR)  # a single word among the blank ones
    model = toxicity.ToxicityModel(weights, 0.0)
    clean, early, late = model.score(["天" * 204, "天" * 20 + "混账东西" + "天" * 180, "天" * 180 + "混账东西" + "天" * 20])
    assert early == late > clean + 0.1
    assert not model.known  # too long to be remembered


def test_licenses(spark):
    ts = ["x All rights\nreserved. CC BY-NC 4.0!", "Licensed under the Apache License, Version 2.0.", "licensed under the terms of the Apache License 2.0", "licensed under the Apache Software License 2.0", None, "", "all rights reserved all rights reserved", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, ts)).collect()}
    assert [got[i]["labels"] for i in range(9)] == ["cc-by,reserved", "apache-2.0", "apache-2.0", "", "", "", "reserved", "mit", "gpl,gpl-3.0"]
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (9, 2, 1, 4)
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 3)
    assert got[4]["first_word"] is None and got[4]["score"] == 0.0


def test_automaton():
    a = licenses.TokenAutomaton("a b <<optional>>c d <</optional>>e <<any:2>>f <<g|h i>>")
    ok = lambda s: a.accepts([w.encode() for w in s.split()], 0)
    assert ok("a b e f g") and ok("a b c d e x y f h i") and not ok("a b c e f g") and not ok("a b e x y z f g") and not ok("a b e f h")


def test_automaton_is_a_plain_matcher():
    """Random templates, those that begin with a region and those of one word too, against regular expressions."""
    import re

    rng = random.Random(17)

    def part(depth=0):
        kind = rng.random()
        if kind < 0.5 or depth > 1:
            w = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
            return w + " ", "".join(f"{x} " for x in w.split())
        if kind < 0.65:
            n = rng.randint(0, 2)
            return f"<<any:{n}>> ", f"(?:[a-d] ){{0,{n}}}"
        if kind < 0.8:
            return "<<a|b c>> ", "(?:a |b c )"
        t, r = part(depth + 1)
        return f"<<optional>>{t}<</optional>>", f"(?:{r})?"

    tried = 0
    for _ in range(400):
        parts = [part() for _ in range(rng.randint(1, 4))]
        template, pattern = "".join(p[0] for p in parts), "".join(p[1] for p in parts)
        if re.fullmatch(pattern, "") or re.fullmatch(pattern, "d ") or re.fullmatch(pattern, "d d "):
            if re.fullmatch(pattern, ""):
                with pytest.raises(ValueError):
                    licenses.TokenAutomaton(template)
            continue
        scan = licenses.Scanner({"x": [template]}, {})
        for _ in range(20):
            text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
            assert (scan(text)[5] == "x") == bool(re.search(r"(?<![^ ])" + pattern, text + " ")), (template, text)
            tried += 1
    assert tried > 3000
    one = licenses.Scanner({"x": ["<<any:2>> license"], "y": ["copyleft"]}, {})
    assert one("under this license")[5] == "x" and one("Copyleft!")[5] == "y" and one("licenses")[5] == ""


def test_html(spark):
    page = "<html><head><title>t</title></head><body><div class='top bar'>Site name</div><nav>n</nav>{}<div class='cookie-note'>c</div><footer>f</footer></body></html>"
    rows = [(i, "http://h/%d" % i, page.format(f"<div><h1>T{i}</h1><p>a{i} &amp;&nbsp;b<br>c<p>d <b>e</b>{i}</p></div>")) for i in range(8)]
    rows += [(50, None, None), (51, "u", ""), (52, "http://h/x", "<article><header><h1>H</h1></header><p>x<script>var a='</p>';</script>y</p><div class=comments>no</div></article>z"), (53, "http://k/", "<div>" * 5000 + "deep")]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3]["text"] == "T3\n\na3 & b c\n\nd e3" and got[3]["n_chars"] == len(got[3]["text"])
    assert (got[50]["text"], got[51]["text"], got[52]["text"], got[53]["text"]) == ("", "", "H\n\nxy", "deep")


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert neardup.near_duplicates(none).count() == exact.exact_duplicates(none).count() == sharding.shard_rows(none).count() == 0
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == licenses.scan_licenses(none).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.main_text(pages).count() == warc.round_trip(pages).count() == 0
    assert embed.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 520)]
    frame = lambda e: spark.createDataFrame(e, "a bigint, b bigint")
    ids = sorted({v for e in edges for v in e if e[0] != e[1]})
    known = set(edges) | {(b, a) for a, b in edges}
    want = brute_components(ids, lambda i, j: (i, j) in known)
    assert {r["id"]: r["component"] for r in graph.components(frame(edges)).collect()} == want
    labels = graph.components(frame(edges[:100]))
    for part in (edges[100:250], edges[:50], edges[250:]):
        labels = graph.extended(labels, frame(part))
    rows = labels.collect()
    assert len(rows) == len(want) and {r["id"]: r["component"] for r in rows} == want


def pipeline_rows():
    """Documents with toxic ones, exact and near copies, repeated rows, rows without an id, and texts that are empty, missing or very long; labels."""
    rng = random.Random(21)
    word = lambda: rng.choice("la de mi so fa re ti do".split()) + rng.choice("xyz") + str(rng.randint(0, 60))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = "grumble" + rng.choice("abcdefgh")
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    long = " ".join(word() for _ in range(100))
    rows += [(1000, long), (1001, long + " \n"), (1002, long.replace(" ", "  ") + "."), (1003, long + " end"), (1004, long + " END"), (1005, "solo " + long)]
    rows += [(1010, None), (1011, ""), (1012, "  "), (1013, " ".join(f"n{i}" for i in range(30_000))), (1014, "x" * 200_000), (None, "no id here at all"), (None, "and none here"), (7, rows[7][1]), (1002, "another text of one id")]
    return rows, labels


def brute_pipeline(rows, toxic):
    """ids that the pipeline keeps, by loops over all rows and pairs."""
    keep = [r for r in rows if not toxic(r[1])]
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    best = {}
    for r in sorted(keep, key=order):
        best.setdefault(norm(r[1]), r[0])
    stay = set(best.values())
    keep = [r for r in keep if r[0] in stay]
    sets = []
    for _, t in keep:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    groups = brute_components(range(len(keep)), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    stay = set()
    for root in set(groups.values()):
        ids = [keep[i][0] for i in groups if groups[i] == root]
        stay.add(min((i for i in ids if i is not None), default=None))
    return [r for r in keep if r[0] in stay]


def test_pipeline_is_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, labels = pipeline_rows()
    frame = spark.createDataFrame([(*r, "s", 5, "k", "w") for r in rows], "doc_id bigint, text string, score string, kept int, _toxicity string, sequence_id string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    model = toxicity.train(docs.select(F.col("doc_id").alias("id"), "text"), corpus_pipeline.table(spark, str(tmp_path), "labels"))
    assert sum(model.score([r[1]])[0] >= 0.5 for r in rows) >= 80  # the stage has work to do
    want = brute_pipeline(rows, lambda t: model.score([t])[0] >= 0.5)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == frame.columns
    got = docs.collect()
    assert {(r["score"], r["kept"], r["_toxicity"], r["sequence_id"]) for r in got} == {("s", 5, "k", "w")}
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r[0] is None for r in want) == 2
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_templates_decide(spark):
    """Recurrence alone tells what isn't the article, within it and on pages that mark none; passages that sites share stay; by brute force over all pages."""
    rng = random.Random(31)
    shared = "<p>a passage that many sites quote</p>"
    rows, want = [], {}
    for host in ("a.org", "b.org", "c.org", "d.org"):
        for i in range(12):
            own = [f"own {host} {i} {j}" for j in range(rng.randint(1, 4))]
            quote = host == "a.org" and i < 8 or host != "a.org" and i < 3  # on most pages of one host, on few of the others
            body = "".join(f"<p>{x}</p>" for x in own) + shared * quote + f"<div>Tell your friends <i>about {host}</i></div>"
            if i % 2:
                body = f"<article>{body}</article>"
            rows.append((len(rows), f"http://{host}/{i}", f"<html><body><div><ul><li>Home<li>About</ul></div>{body}<div>All of {host}</div></body></html>"))
            want[rows[-1][0]] = "\n\n".join(own + ["a passage that many sites quote"] * quote)
    rows += [(900 + i, "http://one.org/", "<p>Home</p><p>copies are one page</p>") for i in range(9)]
    rows += [(950 + i, None, f"<div>same</div><p>{i}</p>") for i in range(3)]
    want |= {900 + i: "Home\n\ncopies are one page" for i in range(9)} | {950 + i: f"same\n\n{i}" for i in range(3)}
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert got == want
    by_host: dict = {}
    for _, url, source in rows:
        by_host.setdefault(url and url.split("/")[2], set()).add(source)
    counts = {h: {} for h in by_host}
    for h, sources in by_host.items():
        for s in sources:
            for x in {t[0] for t in html.Page(s).subtrees}:
                counts[h][x] = counts[h].get(x, 0) + 1
    often = lambda h, x: counts[h][x] >= 5 and counts[h][x] * 2 >= len(by_host[h])
    known = {h: {x for x in counts[h] if often(h, x) and (lambda on: 2 * sum(often(g, x) for g in on) >= len(on))([g for g in counts if counts[g].get(x, 0) > 1 and len(by_host[g]) >= 5])} for h in counts}
    assert got == {i: html.Page(s).text(frozenset(known[u and u.split("/")[2]])) for i, u, s in rows}
    assert sum(got[i] != html.Page(s).text() for i, _, s in rows) == 48


def test_parser_is_linear():
    import time

    begin = time.time()
    for source in ('<a "' * 8000, "<a ='>'" * 8000 + '="', "<div>" * 4000 + "</b>" * 4000, "<p><table><td>" + "<b>" * 5000 + "<h1></h1>" * 5000, "<a " + "a" * 100_000 + "=1>", "<" * 100_000, "<!--" * 50_000):
        html.Page(source).text()
    assert time.time() - begin < 5
    assert html.Page("<p title=don't>x's</p><ul><li>a<li>b</ul>a < b <!--> c <a href='>'>d</a><br/>e <q").text() == "x's\n\na\n\nb\n\na < b c d e <q"


def test_shared_folder(spark, monkeypatch):
    from kbspark.llm import common

    common.release(spark)
    df = common.stored(spark.range(3), "x")
    path = common._made[spark.sparkContext.applicationId][-1]
    assert df.count() == 3 and path.startswith(common.shared_dir(spark))
    common.release(spark)
    assert not common._made and not __import__("os").path.exists(path.removeprefix("file://"))
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(spark)
