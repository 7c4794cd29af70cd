"""Stages of the corpus pipeline where they do more than the thin queries."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterel.llm import jaccard

NO_ID = 2**63 - 1


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_groups(data):
    sets = [grams(t) for _, t in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or 5 * both >= 4 * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, t) in enumerate(data):
        d = NO_ID if d is None else d
        low[root(i)] = min(low.get(root(i), NO_ID), d)
    return sorted(low.values())


def near_copies():
    """Texts of 5 to 200 words with 0 to 20 changed words each, some chained, around the bound."""
    rng = np.random.default_rng(4)
    data = []
    for base in range(25):
        words = [f"w{base}x{k}" for k in range(int(rng.integers(5, 200)))] + ["one", "common", "end", "of", "all", "these", "texts"]
        for _ in range(6):
            own = list(words)
            for k in rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 20))):
                own[k] = f"new{rng.integers(10**9)}"
            data.append((len(data), " ".join(own)))
    return data


@pytest.mark.parametrize("kind", ["made", "odd", "table"])
def test_near_duplicates_against_brute_force(spark, odd, sf_dir, kind):
    docs = {"made": lambda: spark.createDataFrame(near_copies(), "doc_id long, text string"), "odd": lambda: odd, "table": lambda: spark.read.parquet(f"{sf_dir}/documents.parquet")}[kind]()
    out = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    want = first_of_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(NO_ID if r.doc_id is None else r.doc_id for r in out.collect()) == want
    assert out.columns == docs.columns


def test_marks_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, differ = int(rng.integers(1, 700)), rng.random() * 0.4
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        two = np.unique(np.r_[one[rng.random(len(one)) >= differ], rng.integers(0, 2**63, int(n * differ * rng.random())).astype(np.uint64)])
        same = len(np.intersect1d(one, two)) / max(1, len(np.union1d(one, two)))
        if same >= 0.8:
            assert jaccard._may_be_similar(jaccard._mark(one), jaccard._mark(two), len(one), len(two), 0.8)
    far = [np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(20)]
    assert not any(jaccard._may_be_similar(jaccard._mark(far[0]), jaccard._mark(f), 500, 500, 0.8) for f in far[1:])
    assert jaccard._may_be_similar(jaccard._mark(far[0][:0]), jaccard._mark(far[0][:0]), 0, 0, 0.8)


def test_near_duplicates_of_an_empty_table(spark, empty, sf_dir):
    assert corpus_pipeline.one_of_each(spark, empty, sf_dir).count() == 0


def test_near_duplicates_beyond_four_bits(spark, sf_dir):
    words = [f"word{k}" for k in range(120)]
    copy = [*words[:60], "changed", *words[61:90], "twice", *words[91:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()] == [1]
    assert corpus_pipeline.one_of_each(spark, docs.where(F.col("doc_id") == 2), sf_dir).count() == 1


ITEM = "If Anna buys 12 apples at 3 dollars each and gives 4 to Bernd then how many apples does Anna keep"


def decontaminated(spark, tmp_path, docs, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.decontaminate(spark, df, str(tmp_path)).collect()}


def test_decontamination_in_any_case(spark, tmp_path):
    docs = [
        f"Before it, {ITEM.upper()} and after",
        f"before it, {ITEM.lower()} and after",
        ITEM[:50] + ITEM[50:].upper(),
        ITEM.replace("Anna", "Peter").replace("12", "15"),
        ITEM.replace("Anna keep", "Hans keep").replace("Anna", "Peter").replace("12", "15").replace("Bernd", "Clara"),
        "SOME WORDS OF THE ITEM THEN HOW MANY APPLES DOES ANNA KEEP AND OTHERS",
        None,
        "",
    ]
    assert decontaminated(spark, tmp_path, docs, [(1, ITEM), (2, None), (3, "")]) == {4, 5, 6, 7}
