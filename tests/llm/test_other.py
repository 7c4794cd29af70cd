"""Operators on pages and vectors, the pipeline, and the queries' SQL."""

import gzip
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterel.llm import ann, html_extract, queries, warc

PAGES = [
    (1, "http://a.example/x", "<p>" + "hello " * 40), (2, "http://a.example/y\r\nX: 1", "<p>" + "hello " * 40), (3, None, None), (4, "http://ü.example/ ä", ""), (None, "u", "<p>" + "hello " * 40),
    (5, "v", "short"), (6, "w", "short"), (7, "z", "WARC/1.0\r\n\r\n" * 30 + "é "), (7, "z", "WARC/1.0\r\n\r\n" * 30 + "é "), (None, None, "only nulls " * 20), (8, "big", "x1 " * 70000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")


def brute_records():
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, math.inf), math.inf if i is None else i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        f = first.get(b, math.inf)
        again = f < (math.inf if i is None else i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, pages, tmp_path):
    assert sorted(map(tuple, warc.digest(pages).collect()), key=repr) == brute_records()
    files = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=3000)
    found = warc.listed(spark, f"file://{tmp_path}/w")
    assert found.count() == files.count() > 1
    for size in (64, 1000, 1 << 24):
        rows = warc.read_archives(found, range_bytes=size).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == brute_records()
        urls = {r.page_id: r.url for r in rows}
        assert urls[2] == "http://a.example/y\r\nX: 1" and urls[4] == "http://ü.example/ ä" and urls[3] is None
        assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in rows)
    parts = warc.read_archives(found, range_bytes=64).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3  # ranges are read side by side
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert data.count(b"WARC-Type: ") == len(PAGES)
    assert warc.digest(pages.limit(0)).count() == 0


def test_warc_of_others_and_archives_within(spark, tmp_path):
    record = lambda i, body: b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(body) + 4) + b"H\r\n\r\n"[1:] + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "foreign.warc.gz").write_bytes(gzip.compress(info) + b"".join(gzip.compress(record(i, bytes([i]) * 50)) for i in range(20)))
    inner = spark.createDataFrame([(i, "u", "y" * 300) for i in range(3)], "page_id long, url string, html string")
    warc.write_archives(inner, f"file://{tmp_path}/inner")
    stored = next((tmp_path / "inner").iterdir()).read_bytes()
    raw = warc.record_bytes(5, "u", stored, hashlib.sha256(stored).hexdigest(), None)
    pack = zlib.compressobj(0, zlib.DEFLATED, -15)
    mark = b"outer"
    member = warc.MAGIC + b"\x10\0\0\0\0\0\xff" + mark + b"\0" + pack.compress(raw) + pack.flush() + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")
    (tmp_path / "outer.warc.gz").write_bytes(member)
    for size in (50, 1 << 20):
        assert sorted(r.page_id for r in warc.read_archives(warc.listed(spark, f"file://{tmp_path}/foreign.warc.gz"), size).collect()) == list(range(20))
        assert [r.page_id for r in warc.read_archives(warc.listed(spark, f"file://{tmp_path}/outer.warc.gz"), size).collect()] == [5]


def test_damaged_payload(spark, tmp_path):
    data = warc.record_bytes(1, "u", b"abc", "0" * 64, None)
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(warc.listed(spark, f"file://{tmp_path}/d.warc.gz")).collect()


HTML = [
    ("<article><h1>A &amp; B</h1><p>One\n  two<br>three</p><p>x<b>y</b>z &lt;tag&gt; &nbsp;end</article><footer>foot</footer>", "A & B\nOne two three\nxyz <tag> end"),
    ("<nav><a>menu</a></nav><main><p>first<p>second<ul><li>a<li>b</ul><aside>skip me</aside><p>third</main>", "first\nsecond\na\nb\nthird"),
    ("<div class='header'>top</div><div><p>Some text stands here for a reader.</p></div><div class=\"cookie-notice\">We use cookies</div><div id=comments><p>Nice!</p></div>", "Some text stands here for a reader."),
    ("<article><p>kept</p><div class='ad banner'>buy</div><form><input>name</form><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>also</p><section class='comments'><p>me too</p></section></article>", "kept\nalso"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("plain words only", "plain words only"), ("", ""), (None, ""), ("<p>", ""), ("<nav>only menu</nav>", ""), ("<article><p>cut of", "cut of"), ("a < b & c", "a < b & c"),
    ("<article><h2 class='section-header'>Head</h2><div id='social-history'><p>Some history.</p></div><p class='search'>The search went on.</p></article>", "Head\nSome history.\nThe search went on."),
    ("<article><header><h1>Headline</h1></header><p>Text.</p></article>", "Headline\nText."), ("<div>Site</div><article><p>Some words here are the text.</p></article><div>Copyright 2020</div>", "Some words here are the text."),
    ("<div><p>The story is long and stands in a div without a name.</p></div><article><p>short one</p></article>", "The story is long and stands in a div without a name.\nshort one"),
    ("<ul><li><a>Home</a><li><a>News</a></ul><div class=post-content><p>Words.</p><p><a>A link at the end</a></p></div><div class='comment-list'><p>Well said.</p></div>", "Words.\nA link at the end"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
]


def test_html_extraction(spark):
    rows = [(i, None if i % 2 else f"u{i}", h, "clash") for i, (h, _) in enumerate(HTML)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    for (h, want), r in zip(HTML, out):
        assert (r.text, r.n_chars) == (want, len(want)), h
    assert [r.url for r in out][:2] == ["u0", None]


def test_html_of_the_table(spark, sf_dir):
    import re

    for r in queries.op6_html_extraction(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search("(?s)<article>(.*)</article>", r.html)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_html_empty_repeated_and_long(spark):
    page = "<article>" + "<p>some words of it</p>" * 30000 + "</article><footer>foot</footer>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, "<p>x</p>"), (2, None, "<p>x</p>")], "page_id long, url string, html string")
    out = html_extract.extract_pages(df).collect()
    assert sorted(r.n_chars for r in out) == [1, 1, 30000 * 17 - 1, 30000 * 17 - 1]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_time_is_linear():
    import time

    for form in ("<div>{}</span>", "<li><ul>{}</li>", "<li><ul>{}<li></li>", "<p>{}<div>", "<x>{}</y>"):
        begin, end = form.split("{}")
        n = 40000
        began = time.perf_counter()
        html_extract.extract(begin * n + "text" + end * n)
        assert time.perf_counter() - began < 10  # minutes, if each tag looked at all that are open


def test_layouts_are_told_apart():
    weights = html_extract.weights_of_labelled()
    for page in html_extract.labelled_pages()[::7]:
        told = html_extract._told(page)
        plain = html_extract.re.sub(r"\s*data-(?:main|aside)", "", page)
        scored = html_extract.scored(plain, weights)
        sums = np.r_[0, np.cumsum([s for *_, s in scored])]
        begin, end = html_extract.best_stretch([s for *_, s in scored])
        assert sums[end] - sums[begin] == pytest.approx((sums[None] - sums[:, None])[np.triu_indices(len(sums))].max())  # all stretches of the page
        kept = [begin <= i < end and not bad for i, (_, _, bad, _) in enumerate(scored)]
        assert all(k == label for k, (tag, text, *_, label) in zip(kept, told) if not tag and text.strip())


def test_scan_finds_the_best_stretch():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(0, 12)).tolist()
        b, e = html_extract.best_stretch(s)
        assert sum(s[b:e]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def brute_nearest(ids, v, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = v @ v[i]
        other = ids != ids[i]
        order = np.lexsort((ids[other], -s[other]))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[other][order], s[other][order])]
    return out


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_nearest_neighbours(spark, sf_dir, shard_rows):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pdf = df.toPandas()
    want = brute_nearest(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float), 20, 20)
    got = {}
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = [len({a for a, _ in got[q]} & {a for a, _ in w}) / len(w) for q, w in want.items()]
    assert np.mean(hits) >= 0.95 and got.keys() == want.keys()
    scores = {(q, a): b for q, w in brute_nearest(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float), 10**6, 20).items() for a, b in w}
    assert all(abs(scores[q, a] - b) < 1e-12 for q, w in got.items() for a, b in w)


def test_nearest_of_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    same = [0.6, 0.8, 0.0]
    rows = [(i, same) for i in range(0, 90)] + [(i, (rng.normal(size=3) * 0.2).tolist()) for i in range(100, 160)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [float("nan"), 1.0, 1.0]), (260, [float("inf"), 1.0, 1.0]), (280, [None, 1.0, 2.0]), (None, same), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (0, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, shard int")
    got = {}
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df, shard_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids, v = np.array([i for i, x in rows[:150]]), np.array([x for i, x in rows[:150]])
    want = {q: [a for a, _ in w] for q, w in brute_nearest(ids, v, 20, 20).items()}
    assert got.pop(300) == [301] and got.keys() == want.keys()
    assert got[0] == want[0] == list(range(1, 21))
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95
    assert ann.digest(df.limit(0)).count() == 0 and ann.digest(df.where("vec_id = 0")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() <= stage.count()
        stage = out
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert ids == {r.doc_id for r in stage.collect()} and len(ids) > 100


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    for rows in (odd, odd.limit(0)):
        stage = rows
        for name, f in corpus_pipeline.STAGES:
            stage = f(spark, stage, sf_dir)
        assert stage.count() <= rows.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(found.columns)
    assert sorted(map(tuple, got.select(*found.columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_hashes_of_unused_columns(spark, sf_dir):
    renamed = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("block", F.lit(1)).withColumn("id", F.lit("x"))
    assert ann.digest(renamed).count() == queries.op9_ann(spark, sf_dir).count()
