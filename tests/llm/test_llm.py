"""The training-data operators against brute force, exact round trips and odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshwright.llm import bpe, lines, media, nearmin, neighbours, packing, secretscan, sharding, toxicity, urls
from meshwright.llm.common import components, gapless_rank

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
ODD = [None, "", " ", "\n\n", "a", "the the the", "é" * 300, "word " * 3000, "same text here with some words", "same text here with some words"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 2 else "en", None, None, i) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioutnrsldm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(1)][0]


# --- media -----------------------------------------------------------------------------------------


def test_media_round_trip(spark, odd, empty):
    shared = prose(900)
    rows = spark.createDataFrame([(100, shared), (101, shared + " tail"), (102, shared), (103, "head " + shared)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(rows)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = media.store_media(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        payload, n = media.read_back(bytes(r.medium))
        assert payload == media.payload_of(texts[r.doc_id]) and len(payload) % 192 == 0 and payload
        assert r.n_bytes == len(texts[r.doc_id].encode())
    by = {r.doc_id: bytes(r.medium) for r in found}
    assert by[100] == by[102] != by[101]
    assert media.store_media(empty).count() == 0


def test_cuts_follow_content():
    data = random.Random(1).randbytes(60_000)
    one, two = media.chunks(data), media.chunks(b"xyz" + data)
    assert b"".join(one) == data and len(set(one) & set(two)) > 0.8 * len(one)
    assert all(len(c) <= media.MOST for c in one)
    broken = bytearray(media.MAGIC)
    with pytest.raises(Exception):
        media.read_back(bytes(broken) + b"\0" * 40)


# --- byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(reference_bpe):
    own = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = "abcdeé 日本🙂\n\t  '!1234ing tion the<|>▁\x00\xa0\x85\x1c²½ªß"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = own.encode(text)
        assert ids == reference_bpe.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_bpe_query_rows(odd, empty, reference_bpe):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for r in bpe.digests(odd, path).collect():
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = reference_bpe.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(empty, path).count() == 0


# --- packing ---------------------------------------------------------------------------------------


def test_word_ids_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, theirs = packing.WordIds(path), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeéİΣς日本🙂\n\t  '!1234 ing tion.,. the<|>_%%%ǅ") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    want = [x.ids for x in theirs.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_packing_is_whole_and_tight(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, 512).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert -(-total // 512) <= len(sequences) <= -(-total // 512) + 1
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert packing.pack_documents(empty, path).count() == 0


def test_plan_holds_the_histogram():
    rng = random.Random(4)
    histogram = collections.Counter(rng.choice([100, 512, rng.randint(1, 511), rng.randint(200, 350)]) for _ in range(4000))
    used = packing.plan(dict(histogram), 512)
    held = collections.Counter()
    for config, times in used:
        assert sum(k * v for k, v in config.items()) <= 512
        for length, k in config.items():
            held[length] += k * times
    assert held == histogram
    sequences = sum(n for _, n in used)
    assert sequences <= 1.02 * -(-sum(k * v for k, v in histogram.items()) // 512) + 1


def test_program_covers_every_length():
    rng = random.Random(11)
    for lengths in (list(range(1, 1024)), sorted(rng.sample(range(1, 1024), 300))):
        counts = np.array([rng.choice([1, 1, 2, 5]) for _ in lengths])
        found, _ = packing.solve(np.array(lengths), counts, 1024)
        covered = collections.Counter()
        for config, times in found:
            assert sum(k * lengths[i] for i, k in config.items()) <= 1024 and all(k <= counts[i] for i, k in config.items())
            for i, k in config.items():
                covered[i] += k * times
        assert all(covered[i] >= 0.999 * n for i, n in enumerate(counts))
        used = packing.plan({int(x): int(n) for x, n in zip(lengths, counts, strict=True)}, 1024)
        held = collections.Counter()
        for config, times in used:
            for length, k in config.items():
                held[length] += k * times
        assert held == collections.Counter(dict(zip(lengths, counts.tolist(), strict=True)))
        assert sum(n for _, n in used) <= 1.02 * -(-int(np.dot(lengths, counts)) // 1024) + 1


# --- secrets ---------------------------------------------------------------------------------------


def test_secrets_base_entropy_and_mask(spark, empty):
    texts = ['x password: "hunter22" y', "日本 token=short", "AKIA" + "A" * 16 + " AKIA123", "f" * 23 + " " + "0a" * 12, "key dGhpc0lzQVNlY3JldEtleTEyMzQ1Njc4OTA= end", "123e4567-e89b-12d3-a456-426614174000 some-long-path/with/words-2024", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in secretscan.scan(docs).select("doc_id", secretscan.listed(F.col("__spans")).alias("s")).collect()}
    assert found[0].s == "assign:2:21" and found[1].s == "" or found[1].s == "assign:3:14"
    assert found[1].s == ""  # five characters are too few
    assert found[2].s == "access:0:20"
    assert found[3].s == "hex:24:48"
    assert found[4].s.startswith("entropy:4:")
    assert found[5].s == found[6].s == found[7].s == ""
    masked = {r.doc_id: r.text for r in secretscan.redact(docs).collect()}
    assert masked[0] == 'x [secret]" y' and masked[6] is None and masked[7] == ""
    assert secretscan.scan(empty).count() == 0


# --- sharding --------------------------------------------------------------------------------------


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark, odd, empty):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(i).getrandbits(64) - 2**63 for i in range(300))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[sharding.jump_shard(F.col("k"), n).alias(f"s{n}") for n in (1, 8, 9)]).collect()
    assert all(r[f"s{n}"] == jump(r.k, n) for r in rows for n in (1, 8, 9))
    placed = sharding.shard(odd, "doc_id", ["text"]).collect()
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(placed) == len(ODD) + 1
    assert sharding.shard(empty, "doc_id", ["text"]).count() == 0


def test_gapless_rank_of_repeated_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 50 + [("a", 2), ("b", 1), (None, None)], "g string, k int")
    ranks = collections.defaultdict(list)
    for r in gapless_rank(rows, "g", ["k"]).collect():
        ranks[r.g].append(r["rank"])
    assert {g: sorted(v) for g, v in ranks.items()} == {"a": list(range(51)), "b": [0], None: [0]}


# --- lines -----------------------------------------------------------------------------------------


def test_line_dedup(spark, odd, empty):
    base = prose(60, 8)
    near = base.replace(base.split()[30], "zzzzz", 1)
    docs = spark.createDataFrame([(1, f"{base}\nshort\n{prose(30, 9)}"), (2, f"{near}\nshort"), (3, base), (4, None), (None, base)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: f"{base}\nshort\n{prose(30, 9)}", 2: "short", 3: "", 4: None, None: base}
    kept = lines.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert {r.doc_id: r.text for r in kept.collect()}[9] == ""
    assert lines.dedup_lines(empty).count() == 0


def test_lines_of_few_words_meet(spark):
    """Lines of fewer than five words, or without blanks, and short lines with one edit."""
    pairs = [("A thonnd in. Onwhingon and.", "Thonnd in. Onwhingon and."), ("x" + "abcdefghij" * 2 + "klmnopqrstuvwxyz0123456789", "abcdefghij" * 2 + "klmnopqrstuvwxyz0123456789"), ("一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥", "二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥")]
    docs = spark.createDataFrame([(2 * i + j, line) for i, p in enumerate(pairs) for j, line in enumerate(p)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {2 * i + j: "" if j else line for i, p in enumerate(pairs) for j, line in enumerate(p)}


def test_repetitive_lines_meet(spark):
    """One sentence repeated a different number of times, and repeated 25 times with an edit."""
    one = "the quick river runs by the old stone mill at dawn, and nobody minds. "
    many = "over the hill and far away, where seven sleepy shepherds count their sheep. "
    docs = spark.createDataFrame([(1, one * 3), (2, one * 6), (3, many * 25), (4, "Q" + many * 25)], "doc_id long, text string")
    assert {r.doc_id for r in lines.dedup_lines(docs).where("text = ''").collect()} == {2, 4}


def test_line_links_near_the_threshold(spark):
    rng = random.Random(12)
    rows, want = [], 0
    while want < 150:
        line = prose(rng.choice([5, 8, 20, 60, 150]), 5000 + len(rows))
        chars = list(line)
        for _ in range(max(1, len(chars) // rng.randint(45, 70))):
            chars[rng.randrange(len(chars))] = "#"
        grams = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (line, "".join(chars))]
        if len(line) >= 20 and 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.85:
            rows += [(2 * want, line), (2 * want + 1, "".join(chars))]
            want += 1
    gone = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text = ''").count()
    assert gone >= 0.97 * want


def test_short_copies_go(spark, tmp_path):
    spark.createDataFrame([(1, "Les.\n\n \nAnd ornd."), (2, "Les.\n\n \nLos."), (3, "And ornd.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed for r in lines.op6_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0", 3: "0"}


def test_line_signatures_stay_small(spark):
    """Shingles as plain longs without a pattern, band rows with 64-bit ids, which lists give back whole; counts by hash."""
    texts = ["aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijabcdefghij", "語" * 3 + "😀éb" * 9, "abcd", prose(90, 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sets = rows.select("id", lines.shingles(F.col("line")).alias("s"))
    assert not sets.schema["s"].dataType.containsNull and "regexp" not in sets._jdf.queryExecution().toString()
    got = {r.id: r.s for r in sets.collect()}
    for i, x in enumerate(texts):
        grams = [x[k : k + 5] for k in range(len(x) - 4)]
        assert len(got[i] or []) == len(grams) and len(set(got[i] or [])) == len(set(grams))
    assert {r.id: r["count"] for r in lines.with_bands(rows).groupBy("id").count().collect()} == {0: 12, 1: 12, 2: 12, 4: 12}
    docs = rows.select(F.col("id").alias("doc_id"), F.col("line").alias("text"))
    counts = lines.line_counts(docs, 1)
    ids = [r.id for r in counts.orderBy("id").collect()]
    lists = counts.select(F.xxhash64("id").alias("id"), F.lit(7).alias("n"), F.lit(1).cast("long").alias("key"), F.lit(5).cast("long").alias("c"))
    assert sorted(r.id for r in lines.with_whole_ids(lists, counts).collect()) == ids


def test_sketches_keep_each_hash_once(spark):
    """What the longer sketch shares with the sketch is not kept again, and comes back from it."""
    texts = ["", "one", prose(40, 1), prose(900, 2)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string").select("id", nearmin.sketches(F.col("text"), 2).alias("s")).select("id", "s.*")
    for r in rows.withColumn("longer", nearmin.longer()).collect():
        known = nearmin.hashes_of(texts[r.id], 2)
        assert len(r.rest) == max(0, min(len(known), nearmin.LONG) - nearmin.K)
        assert r.longer == [(int(h) >> 32) - 2**31 for h in known[: nearmin.LONG]] and r.sketch == [int(h) - 2**63 for h in known[: nearmin.K]]


# --- neighbours ------------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0, 2.0]), (5004, [None] * 32)]
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert df.count() == 1500
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits, y = 0, x.astype(np.float64)
    for q in range(0, 1500, 100):
        far = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), far)) if i != q][:10]
        hits += len(set(order) & {v for _, v, _ in got[q]})
        assert sorted(r for r, _, _ in got[q]) == list(range(1, 11))
    assert hits >= 0.9 * 150
    assert neighbours.search(df.where("false"), df.where("false")).count() == 0


# --- toxicity --------------------------------------------------------------------------------------


def test_grammar():
    m = toxicity.Model({"idiot": 3.0}, {"vequ": 4.0})
    plain, aimed, denied, quoted = (m.total(x) for x in ("an idiot.", "you are an idiot.", "that is not an idiot.", "as he wrote once in the paper there, idiot."))
    assert aimed > plain > quoted > denied > 0
    assert m.total("I will kill you.") == toxicity.MENACE_WEIGHT and m.total("I kill time.") == 0
    assert m.total("Vequatre, la") == 4.0 and m.total("unidiotic idiots") == 0 and m.total("") == 0
    assert m.score(9.0) > m.score(3.0) > m.score(0.0) >= 0


def test_learning_held_out(spark, odd, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        words = prose(40, i).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = "xubo" + rng.choice(["ta", "lin", "re", "mos", "da"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(toxicity.labelled_rows(docs, marks))
    assert any(b.startswith("xub") for b in model.beginnings)
    scored = toxicity.score_documents(docs, model).join(marks, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.97 * len(scored) > 200
    every = toxicity.score_documents(odd, model).collect()
    assert len(every) == odd.count() and all(0 <= r.score <= 1 for r in every)
    none = toxicity.learn(toxicity.labelled_rows(empty, marks))
    assert none.words and toxicity.score_documents(empty, none).count() == 0


# --- near duplicates -------------------------------------------------------------------------------


def brute(texts, size, percent):
    sets = {i: nearmin.shingles_of(t or "", size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def test_near_duplicates_equal_brute_force(spark, odd, empty):
    rng = random.Random(7)
    texts = {}
    for g in range(12):
        base = prose(rng.choice([4, 5, 6, 30, 60, 120]), 100 + g).split()
        for k in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(["zig", "zag", "zug"])
            texts[100 * g + k] = " ".join(words)
    for size in (2, 5):
        roots, sets = brute(texts, size, 80)
        found = nearmin.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size, 80).collect()
        assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in found} == {i: (roots[i], len(sets[i]), roots[i] == i) for i in texts}
    rows = {r.doc_id: r for r in nearmin.near_duplicates(odd).collect()}
    assert rows[0].n_shingles == 0 and rows[0].component_id == 0 and rows[9].component_id == 8 and not rows[9].kept
    assert rows[None].component_id is None and rows[None].kept
    assert nearmin.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root == (0 if node <= 40 else 100) for node, root in found.items()) and len(found) == 101


# --- URLs ------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "http://a.Example.com/en/725?x": ("a.example.com", "/en/725", "example.com/en/7", "allow"),
        "https://x.com/en/1#t": ("x.com", "/en/1", "com/en/", "block"),
        "http://example.net/de/85": ("example.net", "/de/85", "example.net/de/8", "block"),
        "http://notexample.net/de/85": ("notexample.net", "/de/85", "net/de/", "allow"),
        "http://x.org?/es/": ("x.org", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "s://": ("", "", None, "allow"),
        "a://b.com/en/é\n/": ("b.com", "/en/é\n/", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)] * 2, "page_id long, url string, host int")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    found = urls.judge(pages, rules).collect()
    assert len(found) == 2 * len(cases)
    want = list(cases.values())
    assert all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in found)
    assert {r.verdict for r in urls.judge(pages, rules.where("false")).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), rules).count() == 0


def test_crc_fold(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
