"""Each operator's query on the awkward corpus, against brute force that follows the wording of its contract."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborlake.llm import decontam, graph, langid, mixing, pii, queries, secretscan, simhash, substring, tiff, tokenpack, toolchat
from arborlake.llm.common import Scratch, row_key, shared_dir


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# The folder that executors share.


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_dir(session)


def test_row_key_tells_rows_apart(spark):
    rows = [(1, "a"), (1, None), (None, "a"), (None, None), (1, ""), (11, "a"), (1, "1:a"), (None, "-")]
    got = spark.createDataFrame(rows + rows, "doc_id bigint, text string").select(row_key().alias("k")).collect()
    assert len({bytes(r["k"]) for r in got}) == len(rows) and all(len(r["k"]) == 16 for r in got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


# 1: decontamination


def brute_decontamination(docs, bench):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(list)
    for n, (item, text) in enumerate(bench):
        w = re.findall(word, lower(text or ""))
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[i : i + 13])].append((n, item))
    out = Counter()
    for doc, text in docs:
        w = re.findall(word, lower(text or ""))
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                for who in windows.get(tuple(w[i : i + n]), ()):
                    items.add(who)
                    hit.update(range(i, i + n))
        ids = sorted({str(i) for _, i in items if i is not None})
        out[(doc, len(w), len(hit), len(items), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


def test_op1(spark, awkward, documents):
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{awkward}/benchmark.parquet").collect()]
    got = queries.op1_decontamination(spark, awkward)
    want = brute_decontamination(documents, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(n for k, n in want.items() if k[5]) >= 3 and any(k[2] and not k[5] for k in want)


def test_op1_blocks_and_segments_do_not_change_the_result(spark, awkward):
    docs, bench = (spark.read.parquet(f"{awkward}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = queries.op1_decontamination(spark, awkward)
    index = decontam.build_index(docs, Scratch(spark, "t"), segment_bytes=3000)
    assert index.count() > 10
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for pass_bytes in (1, 100, 1 << 20):
        cut = decontam.verdict(decontam.find(index, bench, block_bytes=50, pass_bytes=pass_bytes))
        assert rows(cut, *columns) == rows(whole, *columns)


def test_op1_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a x b c d"), (3, "d c b a"), (4, "a b"), (5, "c d")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    index = decontam.build_index(docs, Scratch(spark, "t"))
    found = lambda slop: {r["doc_id"] for r in decontam.find(index, items, window=4, slop=slop).collect() if r["n_items"]}
    assert found(0) == {1} and found(1) == {1, 2}


def brute_proximity(docs, items, window, slop):
    """(doc, start, item) by trying every start of every document."""
    out = set()
    for d, text in docs:
        w = text.split()
        for item, t in items:
            v = t.split()
            for i in range(max(len(v) - window + 1, 1)):
                win = v[i : i + window]
                for s in range(len(w) - len(win) + 1):
                    if all(term in w[max(s + k - slop, 0) : s + k + slop + 1] for k, term in enumerate(win)):
                        out.add((d, s, item, len(win)))
    return out


@pytest.mark.parametrize("slop", [1, 2])
def test_op1_proximity_is_a_matter_of_the_document_alone(spark, slop):
    rng = random.Random(slop)
    docs = [(0, "a x b x c")] + [(i, " ".join(rng.choices("abcdx" if i % 2 else "aab", k=rng.randint(0, 12)))) for i in range(1, 60)]
    items = [(1, "a b c"), (2, "d a b c"), (3, "x x"), (4, "b")]
    found = brute_proximity(docs, items, 3, slop)
    covered, by_doc = defaultdict(set), defaultdict(set)
    for d, s, item, n in found:
        covered[d].update(range(s, s + n))
        by_doc[d].add(item)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1, 60, 1 << 20):
        index = decontam.build_index(frame, Scratch(spark, "t"), segment_bytes=size)
        got = decontam.find(index, bench, window=3, slop=slop).collect()
        assert {r["doc_id"]: set(r["items"]) for r in got if r["items"]} == dict(by_doc)
        assert {r["doc_id"]: {p for s in r["spans"] for p in range(s["start"], s["end"])} for r in got if r["spans"]} == dict(covered)


# 2: language


def test_op2(spark, awkward, documents):
    got = queries.op2_language_id(spark, awkward).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{awkward}/documents.parquet").collect() if r["doc_id"] is not None and r["doc_id"] < 150}
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in documents)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    text = dict(documents)
    for r in got:
        has_letter = any(c.isalpha() for c in text[r["doc_id"]] or "") or r["doc_id"] is None
        assert r["lang_pred"] in ({"en", "de", "fr"} if has_letter else {"und"}) or r["doc_id"] is None
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 10


def test_op2_kernel_and_nystrom(spark):
    texts = [b"the river", b"der fluss", b"the river the river"]
    m = langid.presence(texts)
    for n, x in m.items():
        assert np.allclose((x * x).sum(axis=1), 1), n
    assert np.allclose(m[1][0], m[1][2])
    long_text = b"ab" * langid.CHUNK
    assert np.allclose(langid.presence([long_text])[3], langid.presence([b"ab" * 100])[3])
    model = langid.fit([b"the river and the stone", b"the house", b"der fluss und der stein", b"das haus"], ["en", "en", "de", "de"])
    assert [model.langs[i] for i in model.predict([b"the stone", b"der stein"])[0]] == ["en", "de"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50])
def test_op2_cuts_add_no_ngrams(chunk):
    rng = random.Random(chunk)
    texts = ["", " ", "a", "a ", "  Ab--cd ", "Über  der\n\nFluss " * 20] + ["".join(rng.choices(["a", "Bc", " ", "--", "é", "."], k=rng.randint(0, 60))) for _ in range(300)]
    for text in texts:
        whole = " " + re.sub(" +", " ", "".join(c if c >= "\x80" or c.isalpha() else " " for c in lower(text))).strip(" ")
        whole = (whole if whole == " " else whole + " ").encode()
        want = {n: {whole[i : i + n] for i in range(len(whole) - n + 1)} for n in (1, 2, 3)}
        got = {n: {p[i : i + n] for p in langid.folded(text.encode(), chunk) for i in range(len(p) - n + 1)} for n in (1, 2, 3)}
        assert got == want, text


def brute_grams(text):
    """The sets of cells of a text's 1-, 2- and 3-grams, one byte at a time."""
    whole = b" " + re.sub(b" +", b" ", bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text)).strip(b" ")
    whole = whole if whole == b" " else whole + b" "
    code = lambda g: int.from_bytes(g, "big")
    shift = {1: None, 2: 20, 3: 19}
    return {n: {code(whole[i : i + n]) if n == 1 else (code(whole[i : i + n]) * 2654435761 % 2**32) >> shift[n] for i in range(len(whole) - n + 1)} for n in (1, 2, 3)}


def brute_language(docs):
    """Kernel ridge on Nyström features from dictionaries of n-grams: (lang, score) of each (doc_id, text, lang)."""
    train = [(lang, d, t) for d, t, lang in docs if d is not None and t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5 and any(c.isalpha() for c in t)]
    names = sorted({x[0] for x in train})
    grams = [brute_grams(t.encode()) for _, _, t in train]
    kernel = lambda a, b: sum(len(a[n] & b[n]) / np.sqrt(len(a[n]) * len(b[n])) for n in (1, 2, 3) if a[n] and b[n]) / 3
    return names, train, grams, kernel


def brute_predictions(docs):
    """((doc_id, text), lang, score) of every row of ``docs`` (doc_id, text, lang), by a kernel ridge that is fitted on its texts."""
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    names, train, grams, kernel = brute_language(plain)
    assert max(Counter(x[0] for x in train).values()) <= langid.PER_LANG  # the sample is all of it
    draw = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)).alias("h")).collect()}
    order = sorted(range(len(train)), key=lambda i: (train[i][0], draw[train[i][1]], train[i][1], train[i][2]))
    train, grams = [train[i] for i in order], [grams[i] for i in order]
    number = np.array([names.index(x[0]) for x in train])
    seen, rank = Counter(), []
    for k in number:
        rank.append(seen[k])
        seen[k] += 1
    landmarks = sorted(range(len(train)), key=lambda i: (rank[i], number[i]))[: langid.LANDMARKS]
    z = [grams[i] for i in landmarks]
    k_xz = np.array([[kernel(g, c) for c in z] for g in grams])
    value, vector = np.linalg.eigh(k_xz[landmarks])
    keep = value > 1e-6 * value.max()
    project = vector[:, keep] / np.sqrt(value[keep])
    x = np.hstack([k_xz @ project, np.ones((len(train), 1))])
    weight = np.array([len(train) / len(names) / seen[k] for k in number])
    ridge = langid.RIDGE * len(train) * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    y = np.where(number[:, None] == np.arange(len(names)), 1.0, -1.0)
    beta = np.linalg.solve(x.T @ (weight[:, None] * x) + ridge, x.T @ (weight[:, None] * y))
    out = []
    for d, t, _ in plain:
        if not t or not any(c.isalpha() for c in t):
            out.append(((d, t), "und", 0.0))
            continue
        g = brute_grams(t.encode())
        m = np.append(np.array([kernel(g, c) for c in z]) @ project, 1.0) @ beta * 6
        p = np.exp(m - m.max()) / np.exp(m - m.max()).sum()
        out.append(((d, t), names[int(m.argmax())], float(p.max())))
    return out


def test_op2_equals_plain_kernel_ridge(spark, awkward):
    want, got = defaultdict(list), defaultdict(list)
    for (d, _), lang, score in brute_predictions(spark.read.parquet(f"{awkward}/documents.parquet")):
        want[d].append((lang, score))
    for r in queries.op2_language_id(spark, awkward).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert set(got) == set(want)
    for d in want:
        for (lang, score), (lang2, score2) in zip(sorted(got[d]), sorted(want[d]), strict=True):
            assert abs(score - score2) < 5e-3 and (lang == lang2 or score2 < 0.5), d


def test_op2_ignores_id_source_and_lang(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    a = langid.predict(docs.select("doc_id", "text"), model)
    b = langid.predict(docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang")), model)
    assert rows(a, "text", "lang_pred") == rows(b, "text", "lang_pred")


# 3: near-duplicates


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_op3(spark, awkward, documents):
    docs = sorted(documents, key=lambda d: (d[0] is None, d[0] or 0))
    fp = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    label = brute_components(fp)
    want = Counter((d, f"{int(f):016x}", docs[k][0]) for (d, _), f, k in zip(docs, fp, label, strict=True))
    assert rows(queries.op3_simhash_dedup(spark, awkward), "doc_id", "fingerprint", "component_id") == want


def near_fingerprints(seed, n_centres, n_each):
    rng = random.Random(seed)
    out = set()
    for _ in range(n_centres):
        x = rng.getrandbits(64)
        for _ in range(n_each):
            out.add(x)
            x ^= sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(1, 5))))
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed,centres,each", [(1, 200, 6), (2, 5, 400), (3, 1500, 1), (4, 1, 1200)])
def test_op3_vantage_tree_equals_brute_force(seed, centres, each):
    fp = near_fingerprints(seed, centres, each)
    forest = simhash.Forest(len(fp))
    simhash.vantage_tree(fp, np.arange(len(fp)), forest)
    assert [forest.root(i) for i in range(len(fp))] == brute_components(fp).tolist()


@pytest.mark.parametrize("seed,centres,each,shard,aim", [(5, 300, 5, 4096, 4096), (5, 300, 5, 4096, 8), (6, 3, 300, 50, 20), (7, 400, 4, 2, 64), (8, 1, 900, 4096, 30)])
def test_op3_shards_and_blocks_lose_no_link(spark, seed, centres, each, shard, aim):
    fp = near_fingerprints(seed, centres, each)
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp.view(np.int64))], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table, Scratch(spark, "t"), shard_rows=shard, aim=aim).collect()}
    assert got == dict(enumerate(brute_components(fp).tolist()))


def test_op3_linked_pairs_meet_in_a_shard(spark):
    fp = near_fingerprints(9, 300, 4)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    levels = simhash.plan_levels(table, len(fp), aim=4)
    rows = simhash.shards_of(table, levels).collect()
    assert len(levels[0]) >= 8 and len(rows) < 8 * len(fp)
    shards = defaultdict(set)
    for r in rows:
        shards[r["fp"]].add(r["shard"])
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.RADIUS
    signed = fp.view(np.int64).tolist()
    pairs = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    assert len(pairs) > 200 and all(shards[a] & shards[b] for a, b in pairs)
    # Most pairs of fingerprints that don't link are never compared.
    sizes = Counter(r["shard"] for r in rows)
    assert sum(n * n for n in sizes.values()) < len(fp) ** 2 / 4


def test_op3_own_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z"), (2, "a b c", "x", "y", "z")], "doc_id bigint, text string, fp string, component_id string, component string")
    got = simhash.deduplicate(docs, Scratch(spark, "t"), ["doc_id", "fp", "component_id", "component"]).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1)}
    with pytest.raises(ValueError):
        simhash.deduplicate(docs, Scratch(spark, "t"), ["fp"], id_col="fp")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}


# 4: secrets


def test_op4(spark, awkward, documents):
    want = Counter((d, *secretscan.brute_digest(t)) for d, t in documents)
    got = queries.op4_secret_scan(spark, awkward)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    found = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert found[217].startswith("access:0:20") and "pem:0:" in found[218] and "vcs:" in found[218]
    assert sum(k[1] for k in want) >= 4


def test_op4_ledger_scans_only_what_is_new(spark):
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(1, "password=abcdef1"), (2, "password=abcdef1"), (3, "clean"), (None, None), (6, "token, but none")], schema)
    ledger = secretscan.Ledger(Scratch(spark, "t"))
    spans = lambda df: {(r["doc_id"], len(r["spans"]), r["run"]) for r in df.collect()}
    assert spans(ledger.scan(docs, 1)) == {(1, 1, 1), (2, 1, 1), (3, 0, 1), (None, 0, 1), (6, 0, 1)}
    assert ledger.read("findings").count() == 4 and ledger.read("versions").count() == 5
    more = docs.union(spark.createDataFrame([(4, "secret: qwertyu"), (5, "clean"), (1, "password=changed1")], schema))
    assert spans(ledger.scan(more, 2)) == {(1, 1, 1), (2, 1, 1), (3, 0, 1), (None, 0, 1), (6, 0, 1), (4, 1, 2), (5, 0, 1), (1, 1, 2)}
    assert ledger.read("findings").filter("run = 2").count() == 2
    # The same run again replaces itself; a new rule version scans all.
    ledger.scan(more, 2)
    assert ledger.read("findings").count() == 6
    ledger.scan(more, 3, "next")
    assert ledger.read("findings").filter("run = 3").count() == 6
    # Every version of a path is in the ledger.
    assert ledger.read("versions").filter("doc_id = 1").select("blob").distinct().count() == 2


def test_op4_marks_let_every_finding_through(spark, documents):
    rng = random.Random(3)
    parts = ["password", "PassWD", "api_key", "APIKEY", "Secret", "token", "=", ":", " ", '"', "AKIA", "ABCD1234", "deadbeef", "0123456789", "eyJ", "abcdefgh9", ".", "ghp_", "a1" * 18, "xoxb-", "-----BEGIN ", "PRIVATE KEY-----", "-----END PRIVATE KEY-----", "é", "\n"]
    texts = [t or "" for _, t in documents] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", secretscan.marked(F.col("t")).alias("m")).collect()
    held = {r["i"] for r in got if r["m"]}
    found = {i for i, t in enumerate(texts) if secretscan.scan(t)}
    assert found <= held and len(found) > 100 and len(held) < len(texts)


@pytest.mark.parametrize("text", ["-eyJabcdefghijk" * 40_000, "eyJ" * 200_000, "password" * 80_000, "password" + " " * 600_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "ghp_" * 150_000, "xoxb-" * 100_000, "a" * 600_000])
def test_op4_rules_are_linear(text):
    began = time.time()
    secretscan.scan(text)
    assert time.time() - began < 3


# 5: substrings


def brute_substrings(docs, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    order = lambda d: substring.LAST_ID if d is None else d
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, substring.LAST_ID), order(d))
    out = Counter()
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone.update(range(i, i + window))
        out[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


def test_op5(spark, awkward, documents):
    want = brute_substrings(documents, 50)
    assert rows(queries.op5_substring_dedup(spark, awkward), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(k[2] > 0 for k in want) >= 3


@pytest.mark.parametrize("window", [2, 3, 7, 8])
def test_op5_short_windows(spark, window):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for i in range(40)] + [(3, "a b c a b c a b c"), (None, "a b c a b c a b c"), (50, "a b c a b c a b c\n")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = substring.deduplicate(frame, Scratch(spark, "t"), window, with_text=True)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(docs, window)
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in got.collect())


def test_op5_hashes():
    single = np.arange(1, 40, dtype=np.uint64)
    for n in (1, 2, 5, 25, 39, 40):
        lanes = [substring.window_hashes(single, n, lane) for lane in (0, 1)]
        for h in lanes:
            assert len(h) == max(len(single) - n + 1, 0) and len(set(h.tolist())) == len(h)
        assert n == 1 or not set(lanes[0].tolist()) & set(lanes[1].tolist())
    assert [substring.lengths_of(n) for n in (50, 8, 3, 2, 1)] == [[13, 25, 50], [2, 4, 8], [1, 2, 3], [1, 2], [1]]


def test_op5_equal_first_hashes_alone_remove_nothing(spark, monkeypatch):
    """Windows that collide in the first family are told apart by the second."""

    def weak(self, words):
        lanes = plain(self, words).copy()
        lanes[:, 0] = 7
        return lanes

    plain = substring.WordHashes.lanes
    docs = [(1, "a b c d e f g h"), (2, "i j k l m n o p"), (3, "x a b c d e f g h")]
    known = substring.WordHashes()
    monkeypatch.setattr(substring.WordHashes, "lanes", weak)
    keys = [substring.Windows(t.encode().split(), known, 4).extended(np.arange(2)) for _, t in docs]
    assert keys[0][1].tolist() == keys[1][1].tolist() and keys[0][2].tolist() != keys[1][2].tolist()
    assert substring.anchors(np.array([5, 3, 4, 9, 8], np.uint64), 3).tolist() == [3, 3, 4]


def test_op5_levels_go_on_until_none_survives(spark):
    rng = random.Random(8)
    long = [rng.choice("abcdefgh") for _ in range(70)]
    docs = [(1, long + list("xyz")), (2, list("zz") + long[:41]), (3, long[20:70]), (4, [rng.choice("abc") for _ in range(60)]), (5, list("q"))]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    got = {(r["doc_id"], r["length"]): sorted(r["starts"]) for r in substring.repeat_levels(frame, Scratch(spark, "t"), 5).collect()}
    want, n = {}, 5
    while True:
        where = defaultdict(set)
        for d, w in docs:
            for i in range(len(w) - n + 1):
                where[tuple(w[i : i + n])].add(d)
        level = {}
        for d, w in docs:
            starts = [i for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1]
            if starts:
                level[(d, n)] = starts
        if not level:
            break
        want |= level
        n *= 2
    assert got == want and max(k[1] for k in want) == 40
    assert substring.repeat_levels(frame.filter("doc_id = 4"), Scratch(spark, "t"), 5).collect() == []


# 6: tokens


def test_op6(spark, awkward, documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    ids = Counter()
    for d, t in documents:
        got = model.encode(t or "", add_special_tokens=False).ids + [0]
        ids[(d, len(got), zlib.crc32(np.array(got, "<u4").tobytes()))] += 1
    found = queries.op6_token_output(spark, awkward).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == ids
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 20, 31, 32])
def test_op6_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokenpack.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokenpack.unpack(data, bits, 0, 1001) == ids).all()
    for start, n in ((0, 0), (1, 1), (7, 500), (1000, 1), (993, 8)):
        assert (tokenpack.unpack(data, bits, start, n) == ids[start : start + n]).all()


def test_op6_bits():
    assert [tokenpack.id_bits(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_op6_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokenpack, "UNITS", 40)
    monkeypatch.setattr(tokenpack, "PIECES", 60)
    from tokenizers import Tokenizer

    encoder, plain = tokenpack.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "a", "é", "foo", ".", " ", "  ", "\n", ",", "'s", "1", "²", "_", "\t", "日本", "-", "X.y", "\r\n", "!", " ", "\x1c", "　", "bar."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + ["long " * 5, "z" * 300 + " after", "a " * (1 << 20)]
    for at in range(0, len(texts), 500):
        lot = texts[at : at + 500]
        assert [x.tolist() for x in encoder([t.encode() for t in lot])] == [plain.encode(t, add_special_tokens=False).ids for t in lot]


def test_op6_special_tokens_and_other_tokenizers(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    text = "foo <|endoftext|> end"
    (got,) = tokenpack.Encoder(path)([text.encode()])
    assert got.tolist() == plain.encode(text, add_special_tokens=False).ids and 50256 in got.tolist()
    described = json.loads(plain.to_str())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(described | change))
        encoder, model = tokenpack.Encoder(str(other)), Tokenizer.from_file(str(other))
        assert not encoder.cuts_hold
        lot = ["Some Words, and <|endoftext|>", "", "A b"]
        assert [x.tolist() for x in encoder([t.encode() for t in lot])] == [model.encode(t, add_special_tokens=False).ids for t in lot]


# 7: personal data


def brute_pii(text):
    text = text or ""
    digits = lambda w: re.sub("[^0-9]", "", w)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda w: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda w: all(int(p) <= 255 for p in w.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda w: 12 <= len(digits(w)) <= 19 and luhn(digits(w))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda w: 9 <= len(digits(w)) <= 15),
    ]
    found = sorted((m.start(), k, m.end()) for k, (rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m[0]))
    return *(sum(x[1] == k for x in found) for k in range(4)), sha(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in found))


def test_op7(spark, awkward, documents):
    want = Counter((d, *brute_pii(t)) for d, t in documents)
    got = queries.op7_pii(spark, awkward)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert sum(k[1] for k in want) >= 4 and sum(k[2] for k in want) >= 3 and sum(k[3] for k in want) >= 1 and sum(k[4] for k in want) >= 2


def test_op7_random_texts(spark):
    rng = random.Random(11)
    parts = ["a", "b.", "@", ".", "-", "+", "1", "22", "4111111111111111", " ", "(", ")", "é", "日", "256", "0", "c", "_", "%", "\n"]
    docs = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(3000)]
    got = pii.digest(pii.find(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark, "t")))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == Counter((d, *brute_pii(t)) for d, t in docs)


def test_op7_gate_lets_every_address_through(spark):
    texts = ["mail jo@site [dot] com", "jo@site", "bob (at) example (dot) org", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", pii.matches(F.col("text"), "address").alias("m"))
    got = {r["doc_id"]: [(m["start"], m["end"], m["word"]) for m in r["m"]] for r in docs.collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pii.RULES["address"], t)] for i, t in enumerate(texts)}
    assert got[0] == [(5, 22, "jo@site [dot] com")]


def test_op7_long_texts_take_linear_time(spark):
    texts = {1: "a.b@cd.ef " * 150_000, 2: "12 " * 300_000 + "x", 3: "+1 (555) 555-0199; " * 40_000, 4: "1" * 1_000_000, 5: "é 10.0.0.1 " * 40_000, 6: "+1" * 300_000, 7: "a" * 1_000_000 + "@"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs, Scratch(spark, "t"))).collect()}
    assert time.time() - began < 90
    assert (got[1]["n_email"], got[3]["n_phone"], got[5]["n_ip"]) == (150_000, 40_000, 40_000)
    assert got[1]["base_sha256"] == sha(",".join(f"email:{10 * i}:{10 * i + 9}" for i in range(150_000)))


def personal_corpus(rng):
    """(doc_id, text, the loose personal spans): base spans, loose ones and look-alikes, each in a phrase of its own."""
    name = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    d = lambda n: "".join(rng.choices("0123456789", k=n))

    def card():
        x = [int(c) for c in d(15)]
        s = sum(c if i % 2 else (2 * c - 9 * (c > 4)) for i, c in enumerate(x))
        return "".join(map(str, x)) + str(-s % 10)

    forms = [
        (lambda: (f"mail {name()}.{name()}@{name()}.org", None)), (lambda: (f"call +1 ({d(3)}) 555-{d(4)}", None)), (lambda: (f"the card {card()}", None)), (lambda: (f"from 10.{rng.randint(0, 255)}.0.7", None)),
        (lambda: (f"call ({d(3)}) 555-{d(4)}", r"\([0-9]{3}\) 555-[0-9]{4}")), (lambda: (f"write to {name()} (at) {name()} (dot) org", r"[a-j]+ \(at\) .*org")),
        (lambda: (f"order {d(16)}", None)), (lambda: (f"on 20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", None)), (lambda: (f"invoice {d(9)}", None)), (lambda: (f"version 1{d(2)}.999.3{d(2)}.4", None)), (lambda: (f"{name()}@{name()}", None)),
    ]
    docs = []
    for i in range(600):
        text, truth = "", set()
        for _ in range(rng.randint(1, 5)):
            phrase, rule = rng.choice(forms)()
            text += " ".join(name() for _ in range(rng.randint(1, 6))) + " "
            if rule:
                m = re.search(rule, phrase)
                truth.add((len(text) + m.start(), len(text) + m.end()))
            text += phrase + rng.choice([". ", ", ", " "])
        docs.append((i, text, truth))
    return docs


def test_op7_added_spans_on_held_out_documents(spark):
    docs = personal_corpus(random.Random(21))
    frame = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["added"]} for r in pii.find(frame, Scratch(spark, "t")).collect()}
    held = [(got[i], truth) for i, _, truth in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right, added, real = sum(len(a & t) for a, t in held), sum(len(a) for a, _ in held), sum(len(t) for _, t in held)
    print(f"held out: {added} added, precision {right / added:.3f}, recall {right / real:.3f} of {real}")
    assert real > 50 and right >= 0.95 * added and right >= 0.8 * real


def test_op7_ensemble_learns_and_calibrates():
    cells = []
    for digits in range(6):
        for cue in range(4):
            x = dict.fromkeys(pii.FEATURES, 0) | {"digits": digits, "cue": cue}
            good = digits >= 3 and cue == 1
            cells += [(x, held, 100, 97 if good else 1) for held in (False, True)]
    e = pii.fit(cells)
    chosen = {(c[0]["digits"], c[0]["cue"]) for c in cells if e.of(c[0]) >= e.thresholds[0]}
    assert chosen == {(d, 1) for d in (3, 4, 5)}
    assert pii.fit([(cells[0][0], False, 10, 0)]) is None and pii.fit([]) is None


def test_op7_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.cd or 4111 1111 1111 1111 now"), (2, None)], "doc_id bigint, text string")
    found = pii.find(docs, Scratch(spark, "t"))
    got = docs.join(found, "doc_id").select("doc_id", pii.redact(F.coalesce("text", F.lit("")), F.col("base")).alias("x")).collect()
    assert {r["doc_id"]: r["x"] for r in got} == {1: "é mail [email] or [card] now", 2: ""}


# 8: tool calls


def test_op8_links(spark):
    calls = spark.createDataFrame(
        [
            ("c", 0, "a", "answer", '{"prompt": "p", "turn": 1, "style": "long"}', []), ("c", 2, "b", "answer", '{"turn": "x", "zzz": 1}', ["a"]), ("c", 3, "late", "instruct", '{"turn":0,"prompt":"q"}', ["later"]), ("c", 9, "later", "nosuch", "[]", ["unknown"]),
            ("d", 0, "x", "answer", "{", ["y"]), ("d", 1, "y", "answer", None, ["x"]), ("d", 2, "z", "instruct", '{"turn":-1,"prompt":""}', ["y"]), ("e", 0, None, "answer", '{"prompt":"p","turn":1}', []), (None, 0, "n", "answer", '{"prompt":"p","turn":1}', []),
            ("f", 0, "same", "instruct", '{"prompt":"é","turn":1}', []), ("f", 1, "same", "instruct", '{"turn":1,"prompt":"é"}', []),
        ],
        "conv_id string, turn bigint, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("c", 1, "a", "ra"), ("c", 5, "a", "second"), ("c", 4, "b", "rb"), ("c", 10, "late", "rl"), ("g", 0, "lone", "ro"), ("f", 2, "same", None)], "conv_id string, turn bigint, call_id string, content string")
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in toolchat.link(calls, results, Scratch(spark, "t")).collect()}
    assert len(got) == 12
    status = {k: r["status"] for k, r in got.items()}
    assert status[("c", "a", 0)] == "ok" and status[("c", "b", 2)] == "invalid" and status[("g", "lone", None)] == "orphan"
    assert {status[("d", c, t)] for c, t in (("x", 0), ("y", 1), ("z", 2))} == {"cycle"} and status[("e", None, 0)] == status[(None, "n", 0)] == "unlinked"
    assert got[("c", "late", 3)]["position"] > got[("c", "later", 9)]["position"]
    assert got[("c", "b", 2)]["errors"] == "prompt: missing; turn: not integer; zzz: unexpected"
    assert got[("c", "later", 9)]["errors"] == "arguments: no JSON object"
    assert got[("c", "a", 0)]["record"] == '{"arguments":{"prompt":"p","style":"long","turn":1},"id":"a","name":"answer","result":"ra"}'
    assert got[("f", "same", 0)]["record"] == got[("f", "same", 1)]["record"]


def test_op8_awkward(spark, awkward):
    got = queries.op8_tool_call_linking(spark, awkward).collect()
    assert Counter(r["status"] for r in got)["ok"] >= 1 and any(r["status"] == "orphan" for r in got)
    assert sum(r["status"] != "orphan" for r in got) == 7


def test_op8_keeps_every_result(spark, tmp_path):
    talks = [(None, 0, "user", "q"), *[(None, 1, "assistant", t) for t in ("a", "b", "b", None)], (1, 0, "user", "p"), (1, 1, "assistant", None), (1, 1, "assistant", "again"), (1, 1, "assistant", "again"), (8, 3, "assistant", "x"), (8, 3, "assistant", "x"), (8, None, "assistant", "y")]
    spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_tool_call_linking(spark, str(tmp_path)).collect()
    content = lambda r: None if r["record"].endswith('"result":null}') else r["record"].split('"result":"')[1][:-2]
    assert Counter((r["conv_id"], r["status"], r["errors"], content(r)) for r in got) == Counter(
        [(None, "unlinked", "", None), *[(None, "orphan", "", t) for t in ("a", "b", "b", None)], (1, "ok", "", "again"), (1, "orphan", "result: duplicate", "again"), (1, "orphan", "result: duplicate", None), (8, "orphan", "", "x"), (8, "orphan", "", "x"), (8, "orphan", "", "y")]
    )


def brute_positions(turns, needs):
    """Positions by repeated relaxation, as many rounds as there are calls; what still moves then, or needs it, has none."""
    at = {k: (t or 0) for k, t in turns.items()}
    step = lambda: {k: max([at[k], *(at[n] + 1 for n in needs[k] if n in at)]) for k in at}
    for _ in range(len(at) + 1):
        at = step()
    moving = {k for k, v in step().items() if v != at[k]}
    while True:
        more = {k for k in at if k in moving or any(n in moving for n in needs[k])}
        if more == moving:
            return {k: None if k in moving else v for k, v in at.items()}
        moving = more


@pytest.mark.parametrize("seed", range(4))
def test_op8_positions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for conv in range(30):
        n = rng.randint(1, 12)
        turns = {f"k{i}": rng.choice([None, i, i, rng.randint(0, 5)]) for i in range(n)}
        # Half of the conversations have no cycle: their calls need calls of a lower rank in a hidden order.
        rank = {k: rng.random() for k in turns}
        needs = {k: [x for x in rng.choices([*turns, "unknown"], k=rng.randint(0, 3)) if conv % 2 or x == "unknown" or rank[x] < rank[k]] for k in turns}
        rows += [(conv, turns[k], k, "answer", None, needs[k]) for k in turns]
        want |= {(conv, k): v for k, v in brute_positions(turns, needs).items()}
    calls = spark.createDataFrame(rows, "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    got = {(r["conv_id"], r["call_id"]): r["position"] for r in toolchat.positions(calls, Scratch(spark, "t")).collect()}
    assert got == want and None in want.values()


def test_op8_long_chain_takes_few_rounds(spark):
    n = 300
    calls = spark.createDataFrame([(1, i, f"k{i}", "answer", None, [f"k{i + 1}"]) for i in range(n)] + [(2, i, f"k{i}", "answer", None, [f"k{(i + 1) % n}"]) for i in range(n)], "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    began = time.time()
    got = {(r["conv_id"], r["call_id"]): r["position"] for r in toolchat.positions(calls, Scratch(spark, "t")).collect()}
    assert got == {(1, f"k{i}"): n - 1 + (n - 1 - i) for i in range(n)} | {(2, f"k{i}"): None for i in range(n)}
    assert time.time() - began < 60


def test_op8_numbers_have_one_form(spark):
    forms = {"1.0": "1", "1e0": "1", "1E2": "100", "-0.0": "0", "1.50": "1.5", "0.000123": "0.000123", "1e-7": "1e-7", "12345678.25": "12345678.25", "1e20": "100000000000000000000", "1e21": "1e+21", "-2.50e-3": "-0.0025", "7": "7", "0.1": "0.1", "123456789012": "123456789012", "0.0012345678901234567": "0.0012345678901234567"}
    text = '{"s": "1.0 and \\" 2e0", "n": [%s], "x1.0": {"y": 1.0}}' % ", ".join(forms)
    got = spark.createDataFrame([(text,)], "t string").select(toolchat.canonical_numbers(F.col("t"))).first()[0]
    assert got == '{"s": "1.0 and \\" 2e0", "n": [%s], "x1.0": {"y": 1}}' % ", ".join(forms.values())
    rows = [(1, None, "a", "instruct", '{"prompt":"p","turn":1.0}', []), (1, 0, "b", "instruct", '{"prompt":"p","turn":1e0}', ["a"]), (1, 0, "c", "instruct", '{"prompt":"p","turn":1.5}', None), (1, 0, "d", "instruct", '{"prompt":"p","turn":01.0}', [])]
    calls = spark.createDataFrame(rows, "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, 9, k, "r") for k in "abcd"], "conv_id bigint, turn bigint, call_id string, content string")
    out = {r["call_id"]: r for r in toolchat.link(calls, results, Scratch(spark, "t")).collect()}
    assert out["a"]["status"] == out["b"]["status"] == "ok" and out["c"]["errors"] == "turn: not integer" and out["d"]["errors"] == "arguments: no JSON object"
    assert '"turn":1}' in out["a"]["record"] and '"turn":1}' in out["b"]["record"] and (out["a"]["position"], out["b"]["position"]) == (0, 1)


def test_op8_query_meets_every_case(spark, tmp_path):
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}" * (60 if c == 4 else 1)) for c in range(80) for t in range(c % 9)]
    spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string").withColumn("status", F.lit("clash")).withColumn("result", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_tool_call_linking(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(toolchat.ORACLE)
    columns = [d[0] for d in found.description]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(found.fetchall())
    assert {r["status"] for r in got} == {"ok", "invalid", "unlinked", "cycle"} and any(r["position"] is not None and r["position"] > r["turn"] for r in got)
    assert {"arguments: no JSON object", "turn: not integer", "note: unexpected", "prompt: max_length"} <= {e for r in got for e in r["errors"].split("; ")}


# 9: mixing


def poisson_inverse(u, mean):
    k, p = 0, np.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p = p * mean / k
        total += p
    return k


def brute_copies(docs):
    """Counts of (doc_id, source, replica) for rows (doc_id, text, source), by inverting the distribution row by row."""
    n = Counter(s for _, _, s in docs)
    weight = {s: np.sqrt(c) for s, c in n.items()}
    want = Counter()
    for d, t, s in docs:
        mean = weight[s] / sum(weight.values()) * len(docs) / n[s]
        who = str(d) if d is not None else "text:" + (t or "")
        u = (int(hashlib.md5(f"{mixing.SEED}:{who}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        for k in range(poisson_inverse(u, mean)):
            want[(d, s, k + 1)] += 1
    return want


def test_op9(spark, awkward):
    docs = [tuple(r) for r in spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text", "source").collect()]
    want = brute_copies(docs)
    got = queries.op9_source_mixing(spark, awkward)
    assert rows(got, "doc_id", "source", "replica") == want and None in {s for _, _, s in docs}
    keys = [r["shuffle_key"] for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_op9_reaches_the_weights_and_large_means(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("none", 5.0)], "source string, weight double")
    n = {r["source"]: r["n"] for r in mixing.replicate(docs, weights).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 1000) < 150
    few = docs.limit(50)
    many = mixing.replicate(few, epochs=200.0).groupBy("doc_id").count().agg(F.avg("count"), F.min("count")).first()
    assert abs(many[0] - 200) < 15 and many[1] > 100
    assert mixing.replicate(docs, spark.createDataFrame([("a", 0.0)], "source string, weight double")).count() == 0


# 10: TIFF


def test_op10(spark, awkward, documents):
    want = Counter()
    for d, t in documents:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))
        want[(d, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))] += 1
    got = queries.op10_tiff_media(spark, awkward)
    assert rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    by_payload = defaultdict(set)
    for r in got.collect():
        by_payload[(r["n_bytes"], r["payload_sha256"])].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{}, {"rows_per_strip": 3}, {"tile": (16, 32)}])
@pytest.mark.parametrize("order", ["<", ">"])
def test_op10_formats(compression, predictor, layout, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 256, (37, 53), dtype=np.uint8), np.repeat(rng.integers(0, 4, (20, 5, 3), dtype=np.uint8), 13, axis=1), np.zeros((1, 1), np.uint8), np.tile(np.arange(256, dtype=np.uint8), (40, 1))]
    data = tiff.encode_tiff(pages, compression, predictor, byte_order=order, **layout)
    found = list(tiff.decode_pages(data))
    assert [(p.height, p.width) for p in found] == [p.shape[:2] for p in pages]
    assert [p.data for p in found] == [p.tobytes() for p in pages]


def test_op10_packbits_and_lzw():
    # The example of Apple's technical note on PackBits.
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    rng = random.Random(2)
    for data in (b"", b"a", b"ab" * 9000, rng.randbytes(20_000), bytes(rng.choices(b"abc", k=50_000))):
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_op10_rows_and_faults(spark):
    two = tiff.encode_tiff([np.zeros((2, 3), np.uint8), np.ones((4, 5), np.uint8)])
    loop = bytearray(tiff.encode_tiff([np.zeros((2, 3), np.uint8)], tiff.NONE))
    loop[-4:] = loop[4:8]
    media = [(1, bytearray(two)), (2, None), (3, bytearray(b"junk")), (4, bytearray(two[:40])), (5, loop), (1, bytearray(two))]
    got = tiff.tiff_pages(spark.createDataFrame([(i, m, "clash") for i, m in media], "k int, media binary, width string")).collect()
    assert Counter((r["k"], r["page"], r["width"]) for r in got) == Counter({(1, 0, 3): 2, (1, 1, 5): 2, (3, None, None): 1, (4, None, None): 1, (5, 0, 3): 1, (5, None, None): 1})
    assert all((r["error"] is None) == (r["page"] is not None) for r in got)


def test_op10_forged_sizes_are_faults(spark):
    good = tiff.encode_tiff([np.zeros((2, 3), np.uint8), np.ones((4, 5), np.uint8)], tiff.NONE)
    media = [(0, good)]
    for k, (tag, value) in enumerate([(tiff.WIDTH, 2**32 - 1), (tiff.LENGTH, 2**32 - 1), (tiff.SAMPLES, 65535), (tiff.WIDTH, 0), (tiff.STRIP_COUNTS, 2**31), (tiff.STRIP_OFFSETS, 2**32 - 1), (tiff.BITS, 7), (tiff.COMPRESSION, 99), (tiff.ROWS_PER_STRIP, 0)], 1):
        forged = bytearray(good)
        at = forged.rindex(struct.pack("<H", tag) + struct.pack("<H", 3 if tag in (tiff.SAMPLES, tiff.BITS, tiff.COMPRESSION) else 4))
        struct.pack_into("<I", forged, at + 8, value)
        media.append((k, bytes(forged)))
    media.append((98, good[:2] + b"\x2a\x00" + struct.pack("<I", 2**32 - 1)))
    media.append((99, b""))
    got = tiff.tiff_pages(spark.createDataFrame(media, "k int, media binary")).collect()
    pages = defaultdict(list)
    for r in got:
        pages[r["k"]].append((r["page"], r["error"] is not None))
    assert pages[0] == [(0, False), (1, False)]
    # A count beyond the file is cut by it, which is enough for an uncompressed strip only if its bytes are there.
    for k in range(1, 10):
        assert pages[k] in ([(0, False), (None, True)], [(0, False), (1, False)]), k
    assert sum(pages[k] == [(0, False), (1, False)] for k in range(1, 10)) <= 1
    assert pages[98] == pages[99] == [(None, True)]


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("layout", [{}, {"rows_per_strip": 4}, {"tile": (16, 16)}])
@pytest.mark.parametrize("order", ["<", ">"])
def test_op10_depths_planes_and_big_files(big, planar, compression, layout, order):
    rng = np.random.default_rng(5)
    for predictor, page in ((1, rng.random((19, 21)) < 0.3), (2, rng.integers(0, 1 << 16, (19, 21, 3), dtype=np.uint16)), (1, rng.integers(0, 256, (5, 33, 4), dtype=np.uint8)), (2, rng.integers(0, 256, (5, 33, 2), dtype=np.uint8))):
        data = tiff.encode_tiff([page, page], compression, predictor, byte_order=order, planar=planar, big=big, **layout)
        found = list(tiff.decode_pages(data))
        want = page.astype("<u2").tobytes() if page.dtype == np.uint16 else page.astype(np.uint8).tobytes()
        assert [p.data for p in found] == [want, want] and found[0].bits == {"b": 1, "u": 8 * page.dtype.itemsize}[page.dtype.kind]


def test_op10_lzw_is_linear():
    data = bytes(random.Random(1).choices(b"abcd", k=3_000_000))
    packed = tiff.lzw_encode(data)
    began = time.time()
    assert tiff.lzw_decode(packed, len(data)) == data and time.time() - began < 5
