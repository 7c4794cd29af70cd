"""Operators on texts against brute force, with odd rows and on the smallest tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterel.llm import bpe, decontam, line_dedup, quality, queries, shard, simhash, substring_dedup
from rasterel.llm.components import connected_components

NO_ID = 2**63 - 1
sha = lambda b: hashlib.sha256(b).hexdigest()
order = lambda d: NO_ID if d is None else d
rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "table"])
def docs(request, spark, odd, sf_dir):
    return odd if request.param == "odd" else table(spark, sf_dir)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# Lines -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(docs, least):
    data = texts(docs)
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for d, t in data:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(d))
    want = []
    for d, t in data:
        lines = (t or "").split("\n")
        drop = [len(k := key(x)) >= 10 and len(holders[k]) >= least and min(holders[k]) != order(d) for x in lines]
        want.append((d, len(lines), sum(drop), sha("\n".join(x for x, y in zip(lines, drop) if not y).encode())))
    out = line_dedup.dedup_lines(docs, min_docs=least)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert rows_of(got) == sorted(want, key=repr)


def test_line_dedup_keeps_columns(odd, empty):
    out = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("x")))
    assert set(odd.columns) < set(out.columns) and out.count() == odd.count() and out.schema["n_lines"].dataType.simpleString() == "bigint"
    assert line_dedup.digest(empty).count() == 0


# Shards ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500}, {"bucket_rows": 3, "n_shards": 3}])
def test_sharding(docs, options):
    out = shard.shuffle_into_shards(docs, **options).collect()
    n = options.get("n_shards", 8)
    assert sorted(map(repr, [(r.doc_id, r.text) for r in out])) == sorted(map(repr, texts(docs)))
    slots = {k: sorted(r.slot for r in out if r.shard == k) for k in range(n)}
    assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(r.size == len((r.text or "").encode()) + 1 for r in out)


def test_sharding_is_repeatable_and_uniform(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one = {r.doc_id: (r.shard, r.slot) for r in shard.shuffle_into_shards(df.repartition(3), bucket_rows=700).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in shard.shuffle_into_shards(df.repartition(5), bucket_rows=700).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in shard.shuffle_into_shards(df, bucket_rows=700, seed=18).collect()}
    assert one == two and one != other
    place = np.array([one[i][1] for i in range(4000)])
    assert abs(np.corrcoef(place, np.arange(4000))[0, 1]) < 0.06


def test_sharding_spreads_repeated_rows(spark, empty, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = shard.shuffle_into_shards(df, bucket_rows=200)
    assert out.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] == 0
    assert shard.digest(empty).count() == 0
    shard.write_shards(df, str(tmp_path / "s"), n_shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4


# Repeats ---------------------------------------------------------------------------------------------


def brute_repeats(data, window):
    first = {}
    split = [((t or "").encode().split(), order(d), d) for d, t in data]
    for words, o, _ in split:
        for i in range(len(words) - window + 1):
            k = b" ".join(words[i : i + window])
            first[k] = min(first.get(k, NO_ID + 1), o)
    out = []
    for words, o, d in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[b" ".join(words[i : i + window])] < o:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(words) - len(kept), sha(b" ".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 20])
def test_substring_dedup(docs, window):
    got = substring_dedup.remove_repeats(docs, window=window)
    assert rows_of(got.drop("kept_text")) == brute_repeats(texts(docs), window)
    assert all(sha(r.kept_text.encode()) == r.kept_sha256 for r in got.collect())


def test_substring_dedup_of_periodic_texts(spark, empty):
    rng = np.random.default_rng(2)
    data = []
    for i in range(60):
        parts = [" ".join(rng.choice(["a", "b", "ab"], 30)) for _ in range(3)] + ["x " * 70, "a b " * 40, "p q r " * 30]
        data.append((i, " ".join(parts[j] for j in rng.integers(0, 6, 5))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows_of(substring_dedup.digest(df)) == brute_repeats(data, 50)
    assert substring_dedup.digest(empty).count() == 0


def test_recompression_is_consistent():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 5, 200).astype(np.uint64)
    docs = [np.r_[rng.integers(0, 5, 30).astype(np.uint64), common, rng.integers(0, 5, 40).astype(np.uint64)] for _ in range(2)]
    for rounds in range(1, 7):
        found = []
        for d in docs:
            sym, _, b, e, f, t = substring_dedup.recompress(d, np.zeros(len(d), np.int64), rounds)
            assert b[0] == 0 and e[-1] == len(d) and (b[1:] == e[:-1]).all()
            inside = (f >= 30) & (t <= 230)
            found.append(set(zip(sym[inside].tolist(), b[inside].tolist())))
        assert found[0] == found[1]


# SimHash ---------------------------------------------------------------------------------------------


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    data = [(d, brute_print(t)) for d, t in texts(docs)]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (data[i][1] ^ data[j][1]).bit_count() <= 4:
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(data):
        low[root(i)] = min(low.get(root(i), NO_ID), order(d))
    want = [(d, f"{f:016x}", None if low[root(i)] == NO_ID else low[root(i)]) for i, (d, f) in enumerate(data)]
    assert rows_of(simhash.digest(docs)) == sorted(want, key=repr)


def test_simhash_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_one_of_each_group(odd, empty):
    kept = simhash.one_of_each_group(odd)
    groups = {(r.component_id, r.fp if r.component_id is None else None) for r in simhash.near_duplicate_groups(odd).collect()}
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert simhash.digest(empty).count() == simhash.one_of_each_group(empty).count() == 0


@pytest.mark.parametrize("rows, sample", [(40, 16), (40, 400), (100000, 16)])
def test_vantage_point_shards_find_all_links(spark, rows, sample):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 700).astype(np.uint64)
    points = np.unique(np.concatenate([base] + [base[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) for _ in range(3)] + [np.arange(300, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r.fp: r.root for r in simhash.link_components(df, shard_rows=rows, sample_rows=sample).collect()}
    close = np.bitwise_count(points[:, None] ^ points[None]) <= 4
    label = np.arange(len(points))
    while True:
        new = np.where(close, label[None], len(points)).min(axis=1)
        if np.array_equal(new, label):
            break
        label = new
    groups = {}
    for p, g in zip(points.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(g, set()).add(p)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = {}
    for p, r in got.items():
        found.setdefault(r, set()).add(p)
    assert {frozenset(g) for g in found.values()} == want and all(r == min(g) for r, g in found.items())


def test_shards_beyond_the_sample():
    points = np.random.default_rng(6).integers(0, 2**63, 20000).astype(np.uint64)
    nodes = simhash.plant(points[:200], 8)
    home = {}
    for shard, own, at_home in simhash.route(points, nodes, 4, 5):
        if at_home:
            assert shard not in home
            home[shard] = len(own)
    assert sum(home.values()) == len(points) and len(home) > 200 and max(home.values()) < 500


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, 300)] + [(1000 + i, 1000) for i in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0 and got[201] == got[200] == 200 and got[1049] == 1000 and 300 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(docs, reference):
    want = []
    for d, t in texts(docs):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha(reference.decode(ids, skip_special_tokens=False).encode())))
    assert rows_of(bpe.digest(docs, queries.tokenizer_path())) == sorted(want, key=repr)


def test_bpe_full_output(odd, empty, reference):
    out = bpe.encode(odd.withColumn("n_tokens", F.lit("x")), queries.tokenizer_path())
    assert set(odd.columns) < set(out.columns)
    for r in out.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == reference.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)
    assert bpe.digest(empty, queries.tokenizer_path()).count() == 0


ODD_TEXTS = ["İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "<|endoftext|>hi<|startoftext|>", "\0<|ENDOFTEXT|> <|endoftext|>", "it's we'LL ''s '''", "é ẛ̣ ﬁ ½ १२३", "a\x1c\x1d b\x85c\xa0d​e　f᠎", "😀👍🏽 👨‍👩‍👧 🇩🇪", "ẞ Ǆ ŉ", "a" * 700, "한국어 日本語 ไทย"]


@pytest.mark.parametrize("text", ODD_TEXTS)
@pytest.mark.parametrize("lexicon", [True, False])
def test_bpe_of_odd_texts(text, lexicon, reference):
    model = bpe.Model(open(queries.tokenizer_path(), "rb").read())
    words = model.words(text)
    own = bpe.Transducer(bpe.Transducer.compile({w.encode(): model.merge(w) for w in words if w[0] != " "})) if lexicon else None
    encoder, chunks = bpe.Encoder(model, own), model.chunks(text)
    encoder.learn(set(chunks))
    ids = reference.encode(text, add_special_tokens=False).ids
    assert encoder.encode(chunks) == (" ".join(map(str, ids)), reference.decode(ids, skip_special_tokens=False))


def test_transducer(tmp_path):
    rng = np.random.default_rng(3)
    lexicon = {bytes(rng.choice(list(b"abc"), rng.integers(1, 9)).astype(np.uint8)): rng.integers(0, 99, rng.integers(1, 4)).tolist() for _ in range(2000)}
    (tmp_path / "x").write_bytes(bpe.Transducer.compile(lexicon))
    t = bpe.Transducer.open(str(tmp_path / "x"))
    assert all(t.ids(int(k)) == lexicon[w] for w, k in zip(lexicon, t.find(list(lexicon))))
    assert t.find([b"", b"zz", b"abcabcabcabc"]).tolist() == [-1] * 3
    # minimal: no two states have the same future
    future, arcs = {}, {}
    for key, target in zip(t.keys.tolist(), t.targets.tolist()):
        arcs.setdefault(key >> 8, []).append((key & 255, target))
    form = lambda s: future.setdefault(s, (bool(t.finals[s]), tuple((b, form(x)) for b, x in arcs.get(s, []))))
    assert len({form(s) for s in range(len(t.finals))}) == len(t.finals)
    assert bpe.Transducer(bpe.Transducer.compile({})).find([b"a"]).tolist() == [-1]


# Decontamination ---------------------------------------------------------------------------------------

ITEM = "If Anna buys 12 apples at 3 dollars each and gives 4 to Bernd then how many apples does Anna keep"
LEAKS = {
    1: ("Intro. If Peter buys 15 apples at 7 dollars each and gives 2 to Clara then how many apples does Peter keep", True),
    2: ("If Peter buys 15 apples at 7 dollars each and gives 2 to Clara then how many apples does Hans keep", False),
    3: (f"Before it, {ITEM.upper()} and after", True),
    4: (ITEM + " and so on", True),
    5: ("some words of the item then how many apples does Anna keep and others", False),
    6: (None, False),
    7: ("", False),
    8: (ITEM.replace(" ", "\n ", 3).replace("each", "each,") + "!", True),
}


def test_template_leaks(spark):
    docs = spark.createDataFrame([(d, t) for d, (t, _) in LEAKS.items()] + [(None, ITEM), (4, LEAKS[4][0])], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, "null ids are items as well, and this one has enough words")], "item_id long, text string")
    out = decontam.leaks(docs, items).collect()
    assert {r.doc_id for r in out} == {d for d, (_, hit) in LEAKS.items() if hit} | {None} and len(out) == 6
    n = {r.doc_id: (r.n_windows, r.n_matched, r.n_verbatim) for r in out}
    assert n[4] == n[3] == (17, 17, 17) and n[1][:2] == (17, 17) and n[1][2] < 8
    assert decontam.without_leaks(docs, items).count() == docs.count() - 6
    split = decontam.leaks(docs, items, block_windows=3)
    assert rows_of(split) == rows_of(decontam.leaks(docs, items))


def leaked(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = decontam.leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id) for r in out}, out


def test_names_that_lead_sentences(spark):
    item = "Natalia sold 48 clips to friends in April. Natalia then sold half as many in May. How many clips did Natalia sell in all?"
    docs = [item.replace("Natalia", "Peter"), item.lower(), f'"{item.replace("Natalia", "Eva").replace("48", "12")}"', item.replace("Natalia", "Peter", 1)]
    assert leaked(spark, docs, [item])[0] == {(0, 0), (1, 0), (2, 0), (3, 0)}  # the last one is verbatim but for a word


def test_values_may_become_equal_or_differ(spark):
    item = "A farmer has 3 cows in one field and then 4 sheep in the other field so how many animals graze on the farm today"
    equal = item.replace("3", "4")
    twins = "A farmer has 5 cows in one field and then 5 sheep in the other field so how many animals graze on the farm today"
    differ = twins.replace("5 cows", "6 cows")
    assert leaked(spark, [equal], [item])[0] == {(0, 0)}
    assert leaked(spark, [differ], [twins])[0] == {(0, 0)}  # all but the windows around one number are verbatim
    names = "Then Anna met Bernd and Anna gave Bernd some of the bread that Anna had while Bernd gave Anna some of the milk"
    mixed = names.replace("Anna", "Clara").replace("Bernd", "Doris")
    assert leaked(spark, [mixed, mixed.replace("that Clara", "that Emma").replace("while Doris", "while Frida")], [names])[0] == {(0, 0)}


def test_items_without_plain_words_and_short_ones(spark):
    items = ["Add 3 and 5", "1 2 3 4 5 6 7 8", "Hund Katze Maus Vogel Fisch Pferd Kuh", "Bern"]
    docs = ["please add 3 and 5 now", "0 1 2 3 4 5 6 7 8 9", "HUND KATZE MAUS VOGEL FISCH PFERD KUH", "add 4 and 5", "2 3 4 5 6 7 8 9 10 11", "Hase Katze Huhn Vogel Ente Pferd Ross", "from bern", None]
    assert leaked(spark, docs, items)[0] == {(0, 0), (1, 1), (2, 2), (6, 3)}


def test_many_items_of_one_form(spark):
    items = [f"If a train leaves the station at {i} and runs for {i + 7} hours how far does the train run before it stops" for i in range(10000)]
    found, out = leaked(spark, [items[5], items[5].replace("5", "70000"), "how far does the train run before it stops"] * 20, items)
    assert found == {(d, 0) for d in range(60) if d % 3 < 2} and {r.n_items for r in out} == {10000}


def test_leaks_of_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8")], "item_id long, text string")
    assert {r.doc_id for r in decontam.digest(odd, items).collect()} == {-3, 1, 2, 7, None}
    assert decontam.digest(empty, items).count() == decontam.digest(odd, items.limit(0)).count() == 0
    assert decontam.without_leaks(odd, items).columns == odd.columns


def test_planted_passages(spark, sf_dir):
    docs, items = table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    for i, t in [tuple(r) for r in items.select("item_id", "text").collect()]:
        own = words(t)
        grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for d, x in texts(docs):
            w = words(x)
            if grams and len(grams & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) >= 0.8 * len(grams):
                want.add((d, i))
    assert want and {(r.doc_id, r.item_id) for r in decontam.digest(docs, items).collect()} == want


# Quality -----------------------------------------------------------------------------------------------


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    out = quality.digest(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 40 and ((held.score >= 0) & (held.score <= 1)).all() and ((held.score >= 0.3) == (held.predicted == 1)).all()
    assert ((held.predicted == held.quality).mean()) > 0.9
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.95
    twisted = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.digest(docs, twisted).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(again, quality.digest(docs.repartition(3), labels).toPandas().sort_values("doc_id").score.to_numpy(), atol=1e-6)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (None, 1, 1), (7, None, 0), (8, 0, 0), (8, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd.withColumn("score", F.lit("x")), quality.fit(odd, labels))
    assert out.count() == odd.count() and out.where("score between 0 and 1").count() == odd.count() and set(odd.columns) < set(out.columns)
    none = quality.digest(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.digest(empty, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_shape_of_the_whole_word():
    assert quality.shape("A" * 50 + "b1") == "Xx9" and quality.shape("") == "" and quality.shape("ab--Cd12.5") == "x-Xx9.9"
    assert quality.shape("x" * 41 + "9") != quality.shape("x" * 41)


def test_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma " * 30), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert "gamma" in quality.fit(docs, labels).vocabulary.words


def test_held_out_rule(spark):
    import zlib

    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), quality.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_counter_of_words(odd):
    counts = {bytes(r.word).decode(): r.n for r in bpe.word_counts(odd, queries.tokenizer_path()).collect()}
    model = bpe.Model(open(queries.tokenizer_path(), "rb").read())
    assert counts == Counter(w for _, t in texts(odd) for w in model.words(t))
