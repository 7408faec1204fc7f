"""The corpus operators against brute force, on small tables with every awkward row."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import common, gbt, licenses, media, mixing, packing, quality, sharding, simhash, topk, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"
BASE = " ".join(f"word{i}" for i in range(400))


def corpus():
    rng = random.Random(3)
    texts = [None, "", "   \n", "one two", "One TWO", BASE, BASE + " more", BASE.replace("word7 ", "Word7 "), "<|endoftext|> x  \n\n y z \U0001f600", "a" * 3000, " ".join(rng.choice("abcdefgh") * 3 for _ in range(5000))]
    texts += [" ".join(rng.choice("red green blue tin iron gold".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, None, 0.5, 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, "src1", 1, None, None), (None, "no id", None, "src1", 1, None, None)]
    return rows + [(100 + i, BASE, "en", "src0", 1, 1.0, 2) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3, F.xxhash64("doc_id", "text"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(spark, docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = corpus()

    def brute(text):
        b = (text or "").encode().lower() if (text or "").isascii() else "".join(c.lower() if c < "\x7f" else c for c in text).encode()
        w = b.split()
        runs = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(r, 42) >> k & 1 for r in runs) for k in range(64)]
        return sum(1 << k for k in range(64) if 2 * ones[k] > len(runs))

    fps = [brute(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    expected = Counter((rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows)))
    found = simhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_near_copies_of_four_fifths(spark, docs, empty):
    assert simhash.keep_dissimilar(empty).count() == 0
    rng = random.Random(9)
    rows = corpus()
    for i in range(30):  # near copies with one to four words changed
        words = [f"w{rng.randrange(500)}" for _ in range(150)]
        rows += [(1000 + 10 * i, " ".join(words), "en", "src0", 1, 1.0, 2)]
        for j in range(1, 4):
            again = list(words)
            for at in rng.sample(range(150), rng.randrange(1, 5)):
                again[at] = "changed"
            rows += [(1000 + 10 * i + j, " ".join(again), "en", "src0", 1, 1.0, 2)]
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    expected = {min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in group}
    kept = simhash.keep_dissimilar(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(expected)


def test_near_dedup_compares_simhash_fingerprints(spark):
    rng = random.Random(3)
    sets = []
    for _ in range(40):  # families of sets around the similarity, of four shingles and more
        base = [rng.getrandbits(64) for _ in range(rng.choice((4, 5, 9, 40, 300)))]
        for _ in range(rng.randrange(1, 6)):
            sets.append(np.unique(np.array([h if rng.random() > 0.1 else rng.getrandbits(64) for h in base] + [rng.getrandbits(64)] * rng.randrange(2), np.uint64)))
    fps = [simhash.wide_fingerprint(s) for s in sets]
    salts = [int(s) for s in simhash._salts(8)]

    def mix(h, salt):
        h = (h ^ salt) * 0xFF51AFD7ED558CCD % 2**64
        h = (h ^ h >> 32) * 0xC4CEB9FE1A85EC53 % 2**64
        return h ^ h >> 29

    for s, fp in zip(sets[:30], fps):
        ones = [sum(mix(int(h), salt) >> k & 1 for h in s) for salt in salts for k in range(64)]
        assert [int(b) for b in np.unpackbits(fp, bitorder="little")] == [int(2 * o > len(s)) for o in ones]
    values = [int.from_bytes(f.tobytes(), "little") for f in fps]
    expected, beside = set(), set()
    for a in range(len(sets)):
        for b in range(a):
            bits = values[a] ^ values[b]
            sizes = sorted((len(sets[a]), len(sets[b])))
            if sizes[0] >= 0.8 * sizes[1] and (bits % 2**128).bit_count() <= simhash.FAR_HALF and (bits % 2**256).bit_count() <= simhash.FAR and (fps[a] == fps[b]).any():
                expected.add((b, a))
                beside |= {a, b}
            if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                assert (b, a) in expected
    nodes = spark.createDataFrame([(k, len(s), bytearray(f.tobytes()), k) for k, (s, f) in enumerate(zip(sets, fps))], "key long, n long, fp binary, root long").repartition(3)
    assert len(expected) > 40 and {tuple(r) for r in simhash.close_pairs(nodes, rooted=True).collect()} == expected
    first = {tuple(r) for r in simhash.close_pairs(nodes).collect()}
    assert first <= expected and {k for pair in first for k in pair} == beside


def test_near_dedup_moves_each_set_once_to_a_place(spark):
    rng = random.Random(11)
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(sc.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(False).size()))

    # Variations of one text that share five eighths: all pairs are close, none is similar but those of a copy.
    base, rows = [f"w{rng.randrange(900)}" for _ in range(300)], []
    for i in range(150):
        own = [f"v{rng.randrange(900)}" for _ in range(90)]
        rows.append((2 * i, " ".join(base + own), "en", "src0", 1, 1.0, 2))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(base + own[:-1] + ["changed"]), "en", "src0", 1, 1.0, 2))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the sets are many
    try:
        before = moved()
        kept = simhash.keep_dissimilar(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 300, 2))
        assert moved() - before < 3_000_000  # 6.9 MB with a set for each pair
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_similar_pairs_wherever_sets_are(spark):
    rng = random.Random(12)
    sets = []
    for _ in range(12):
        family = [rng.getrandbits(63) for _ in range(rng.choice((4, 30, 200)))]
        for _ in range(rng.randrange(1, 14)):
            sets.append({h if rng.random() > 0.08 else rng.getrandbits(63) for h in family})
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if rng.random() < 0.5 or len(sets[a] & sets[b])]
    expected = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b])]  # links from which families come; other pairs lie across
    nodes = spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "key long, n long")
    held = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "key long, held array<long>").repartition(3)
    assert len(expected) > 20
    for room in (1, 3000, simhash.SPOT):
        where = {r.key: r.spot for r in simhash.spots(nodes, spark.createDataFrame(near, "a long, b long"), room).collect()}
        assert len(where) == len(sets) and (len(set(where.values())) > 12) == (room < simhash.SPOT)
        rows = [(a, b, hash((min(where[a], where[b]), max(where[a], where[b])))) for a, b in pairs]
        found = simhash.similar_pairs(spark.createDataFrame(rows, "a long, b long, place long").repartition(3), held).collect()
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_covering_masks_and_long_runs(spark):
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    rng = random.Random(1)
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & bits for m in masks)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 4))) for b in base for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    joined = [{r[0]: r[1] for r in simhash.components(simhash.links(df, longest=n)).collect()} for n in (3, 2048)]
    label = {v: v for v in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if x == old else x for k, x in label.items()}
    for found in joined:
        assert {v: found.get(v, v) for v in signed} == label


def test_media(docs, empty, tmp_path):
    assert media.media_columns(empty).count() == 0
    by = defaultdict(set)
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(corpus())
    expected = Counter()
    for doc_id, text, *_ in corpus():
        own = (text or "").encode()
        whole = own + b"\xff" * (-len(own) % 576 if own else 576)
        image = media.png(whole)
        v = np.frombuffer(whole, np.uint8).astype(float)
        steps = np.abs(np.diff(v.reshape(-1, 576), axis=1)).sum() / (len(v) // 576 * 575)
        bins = ",".join(str(int(((v >= 32 * k) & (v < 32 * k + 32)).sum())) for k in range(8))
        text_of = f"h={len(v) // 576};mean={v.mean():.4f};std={v.std():.4f};step={steps:.4f};hist={bins}"
        expected[doc_id, len(own), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(image), hashlib.sha256(image).hexdigest(), text_of] += 1
    assert Counter(tuple(r) for r in rows) == expected
    for r in rows:
        by[r.payload_sha256].add((r.media_sha256, r.feature))
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > 0
    assert all(len(v) == 1 for v in by.values())
    writer = media.ArchiveWriter(str(tmp_path))
    for i in (5, None, -3):
        writer.add(i, media.png(media.padded(b"text %d" % (i or 0))))
    path = writer.close()
    at, n = media.directory(path)
    assert writer.line().split() == [path.rpartition("/")[2], str(at), str(n)]
    got = list(media.members(path, at, at + n * (media._ENTRY.size + media.NAME)))
    assert [g[0] for g in got] == [5, None, -3] and media.samples(got[0][1]).tobytes() == media.padded(b"text 5")
    data = bytearray(open(path, "rb").read())
    data[media._LOCAL.size + media.NAME + 20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(media.members(path, at, at + media._ENTRY.size + media.NAME))
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return b"x"

    assert media.retried(flaky, pause=0) == b"x" and len(calls) == 3


def test_sharding(docs, empty):
    assert sharding.shard(empty).count() == 0
    rows = sharding.shard(docs).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, largest = sum(load.values()), max(r["size"] for r in rows)
    assert max(load.values()) <= total / 8 + largest


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    assert packing.pack(empty).count() == 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text, *_ in corpus():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    rows = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    rest: list[int] = []  # of first fit, longest first
    for r in sorted(rows, key=lambda r: -r.length):
        k = next((k for k, left in enumerate(rest) if left >= r.length), None)
        if k is None:
            rest.append(2048 - r.length)
        else:
            rest[k] -= r.length
    assert len(bins) <= len(rest)


def test_units_of_odd_texts():
    own = packing.units()
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "1", " ", " ", "é", ".", "\0", "don't", "<|endoftext|>", "\n\n", "   ", "\x1c", "日本"]) for _ in range(rng.randrange(30)))
        assert own.text(text) == own.encode(text)


def test_bins_against_all_combinations():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randrange(1, 40) for _ in range(9)]
        room = rng.randrange(1, 120)
        best = max(sum(c) for k in range(10) for c in combinations(lengths, k) if sum(c) <= room)
        got = packing.fullest(sorted(Counter(lengths).items(), reverse=True), room)
        assert sum(a * b for a, b in got) == best and all(b <= lengths.count(a) for a, b in got)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(3000)]
    rows += [(5, None), (7, [1.0, None]), (9, [float("nan")] * 8), (20, rows[20][1]), (None, rows[0][1]), (3000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    sound = [(i, np.floor(64 * np.array(v)).astype(int).tolist()) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for k, (i, v) in enumerate(sound):
        if i is not None and i % 20 == 0:
            all_ = sorted((-sum(a * b for a, b in zip(v, w)), (1 << 63) if j is None else j) for m, (j, w) in enumerate(sound) if m != k)[:20]
            expected.update((i, r + 1, j, -s) for r, (s, j) in enumerate(all_))
    got = topk.top_k(df, chunk=64)
    assert Counter((r.query_id, r["rank"], (1 << 63) if r.vec_id is None else r.vec_id, r.score) for r in got.collect()) == expected
    assert topk.top_k(df.limit(0)).count() == 0


def test_mixing(docs, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(docs).collect()
    sizes = Counter((r[0], len((r[1] or "").encode().split())) for r in corpus())
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    per = Counter()
    for r in rows:
        per[r.source] += r["size"]
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(per.values())), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * per[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * per[s]
            left -= target[s]
        open_ -= full
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert again == Counter(tuple(r) for r in rows)
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_urls(spark):
    urls = [None, "", "nothing", "http://www.Example.com/en/x?y", "http://example.com/en/", "http://a.example.com/en", "https://x.net/es/1#t", "https://net/fr/", "http://foo.org/en/", "ftp://EXAMPLE.com", "http://u@b.com:80/", "http://a.com/\nb", "http://" + "a." * 2000 + "com/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    expected = [(None, "allow")] * 3 + [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("com/", "allow")]
    assert [got[i] for i in range(len(urls))] == expected
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_without_a_path_that_carries_another(spark):
    urls = ["https://shop.net?u=https://x.org/es/", "http://b.net#http://c.net/fr/", "https://shop.net/es/?u=https://x.org/fr/", "x://"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got == {0: ("shop.net", "", None, "allow"), 1: ("b.net", "", None, "allow"), 2: ("shop.net", "/es/", "net/es/", "block"), 3: ("", "", None, "allow")}


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(4000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = universe.where("substring(key, -1, 1) = '7'")
    levels = urlfilter.cascade(universe, listed, 1)
    assert len(levels) > 1
    wrong = universe.where(urlfilter.listed_in(levels, F.col("key")) != (F.substring("key", -1, 1) == "7"))
    assert wrong.count() == 0


def test_licenses(spark, empty):
    assert licenses.scan(empty).count() == 0
    texts = [None, "", "plain prose\nmore", "x\nLicensed under the Apache License, Version 2.0.\ny", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "a driver must carry a valid license at all times", "This work is licensed under the GNU General Public License, version 3. " + BASE]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].family for i in (0, 1, 2)] == ["none"] * 3
    assert got[3].family == "apache-2.0" and got[3].confirmed
    assert got[4].families == "cc-by-nc-4.0,mit" and got[4].paragraphs == 2
    assert got[5].family == "unknown" and not got[5].confirmed
    assert got[6].family == "gpl-3.0" and got[6].confirmed


def test_wrapped_licence_notice(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software, subject to the\ncopyright notice and this\npermission notice"
    gpl = "This work is licensed under the GNU General\nPublic License,\nversion 3."
    texts = [mit, "some prose\n\n" + gpl + "\n\nmore prose", mit + "\n\n" + gpl, "a driver must carry\na valid license", "Proprietary and confidential. All rights\n  reserved. No licence\nis granted."]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].families, got[i].confirmed, got[i].paragraphs) for i in range(5)] == [("mit", True, 1), ("gpl-3.0", True, 1), ("gpl-3.0,mit", True, 2), ("unknown", False, 1), ("proprietary", True, 1)]


def test_licence_notices_wrapped_at_eighty_columns(spark):
    import textwrap

    notices = {f: [t for t in ts if len(t.split()) > 20 or "Rechte" in t or t == "GPLv3"] for f, ts in licenses.TEMPLATES.items()}
    rows = [(f, "Some words before.\n\n" + textwrap.fill(t, 80) + "\n\nand after it.") for f, ts in notices.items() for t in ts]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert len(rows) >= 8
    for i, (family, text) in enumerate(rows):
        assert family in got[i].families.split(",") and got[i].confirmed, text


def test_licence_scores_against_numpy(spark):
    model = licenses.train()
    assert all(any(a in t.lower() for a in licenses.ANCHORS) for ts in licenses.TEMPLATES.values() for t in ts)
    rng = random.Random(8)
    vocabulary = [w for g in model.weights for w in g.split(" ")]
    texts = ["license " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in licenses.grams(licenses.plain_words(texts[r.doc_id])) if g in model.weights), np.zeros(len(model.bias)))
        p = licenses.softmax(z[None])[0][:-1]
        assert r.score == pytest.approx(p.max(), abs=2e-6) and r.paragraphs == 1
        assert r.family == (model.families[int(p.argmax())] if p.max() >= model.bar else "unknown")


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = gbt.fit(x, y)
    assert ((model.margin(x) > 0) == y).mean() > 0.97
    walked = np.array([sum(_walk(model, t, row) for t in range(len(model.feature))) + model.base for row in x[:50]])
    assert np.allclose(walked, model.margin(x[:50]))
    score, p = gbt.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(p) > 0).all() and p.tolist() == [0.0, 0.5, 1.0]


def _walk(model, tree, row):
    node, inner = 0, model.feature.shape[1]
    while node < inner:
        node = 2 * node + 1 + (row[model.feature[tree, node]] > model.threshold[tree, node])
    return model.leaf[tree, node - inner]


@pytest.mark.parametrize("module,label,mod,out", [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_classifiers_on_awkward_rows(spark, docs, empty, module, label, mod, out):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = module.score(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus())
    by = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
        assert r.held_out == (zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % mod == out)
        by[r.doc_id] = r.score
    assert module.score(empty, labels).count() == 0
    assert module.keep(docs, labels.limit(0)).count() == len(corpus())
    assert module.keep(docs, labels).columns == docs.columns


@pytest.mark.parametrize("module,label,floor", [(quality, "quality", 0.97), (toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, module, label, floor):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = module.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("score", label).toPandas()
    order = rows["score"].rank()
    p = rows[label] == 1
    auc = (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())
    assert auc > floor, auc


def test_lines_of_a_very_long_text():
    at = quality.FEATURES.index("repeated_lines")
    lines = [b"line %d" % i for i in range(250_000)]
    assert quality.statistics(b"\n".join(lines))[at] < 1e-3
    # Cuts between parts may split a line or leave an empty one; those are few.
    assert quality.statistics(b"\n".join(lines + lines))[at] == pytest.approx(0.5, abs=1e-3)


def test_obfuscated_words():
    judge = toxicity.Judge(toxicity.SEED)
    for text in ("you idiot", "an 1d10t", "i d i o t now", "IDIOT!!", "id​iot", "ID.IOT"):
        assert toxicity.features(text.encode(), judge)[0] >= 1, text
    assert toxicity.features(b"a fine day, all in all", judge)[0] == 0


def test_toxic_words_of_a_small_language(spark):
    rng = random.Random(4)
    plain = lambda: [f"wort{rng.randrange(300)}" for _ in range(60)]
    rows = []
    for i in range(1200):
        words = plain()
        if i % 6 == 0:  # few documents hold the same form
            words[rng.randrange(50)] = (*["idiot"] * 16, "reeuxan", "achlichen", "achlichung", "bocoes")[i // 6 % 20]
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert {"reeuxan", "achlichen", "achlichung", "bocoes"} <= model.lexicon and "wort7" not in model.lexicon
    marked, clean = (model.scores([" ".join([*plain(), *extra]).encode()])[0] for extra in (["achlichung"], []))
    assert marked >= toxicity.THRESHOLD > clean


def test_workers_let_go_of_other_operators_words(spark):
    rows = [(i, f"wort{i} " * 40) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)], pa.int64())], names=["n"])

    packing.pack(docs).count()
    judged = quality.keep_rows(docs, lambda texts: np.array([len(texts) <= common.SLICE] * len(texts)))
    assert sorted(r.doc_id for r in judged.collect()) == list(range(1200))
    assert {r.n for r in docs.mapInArrow(common.lean(held), "n long").collect()} == {0}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", None])], names=["doc_id", "text"])
    own = packing.units()
    assert sum(b.num_rows for b in packing._tokenize(iter([batch]), 2048, packing.VOCABULARY)) == 2
    assert packing.units() is own
    assert list(common.lean(held)(iter([batch]))) and packing.units() is not own


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        at = stage(spark, at, d)
        assert at.columns == docs.columns
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in out.select("doc_id").collect()} <= ids and out.count() > 50
