"""Benchmark decontamination (operator 3), built from DataFrame functions only.

Benchmark items and documents are brought to template form: numbers, units after numbers, and
capitalised words become typed placeholders, one token each, so that raw and template tokens stay
aligned. Windows of tokens are hashed and joined in two forms: as templates, and as the lower-cased
raw tokens, so that copies in other case are found as well. Per text, item and alignment the slots are
compared: values may differ, as in a question asked anew with other numbers, but a value of the item must
always stand for the same one; windows with a slot that doesn't are left out, unless they are verbatim.
A text leaks an item if enough of the item's windows are found.

Items that differ in their values only are one form: the same template, with equal values in the
same slots. Thousands of questions of one form are joined as one. Of each form only the windows that
fewest forms share look for candidates; the others are compared for candidates alone. Equal texts are
compared once. Only hashes of the benchmark's windows are broadcast, 8 bytes each, in blocks of
``BLOCK_WINDOWS``, each over all documents; documents are never shuffled, only what they share with
the benchmark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash128, written

#: Tokens in a window; share of an item's windows that makes a leak; plain words a template window needs.
WINDOW, COVERAGE, PLAIN = 5, 0.8, 3
#: Most hashes of benchmark windows broadcast at a time.
BLOCK_WINDOWS = 500_000
#: Units, in lower case, that a number may have.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degree degrees kmh mph w kw v a hz kb mb gb tb"

_NAME = r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll}+)"


def _spaced(text: Column) -> Column:
    """Cleaned text: tokens with a space on each side, names led by a mark, no punctuation."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, "$1\x01$2")
    digits = text
    for _ in range(2):  # a second time for what overlaps
        digits = F.regexp_replace(digits, r"(\p{N})[.,:](\p{N})", "$1$2")
    digits = F.regexp_replace(digits, r"(\p{N})(\p{L})", "$1 $2")
    text = F.when(text.rlike(r"\p{N}"), digits).otherwise(text)
    words = F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}\x01]+", " "))
    return F.concat(F.lit(" "), F.replace(F.lower(words), F.lit(" "), F.lit("  ")), F.lit(" "))


def _template(spaced: Column) -> Column:
    named = F.regexp_replace(spaced, " \x01[^ ]* ", " <c> ")
    numbered = F.regexp_replace(named, r" \p{N}+ ", " <n> ")
    units = F.regexp_replace(numbered, f" <n>  ({UNITS.replace(' ', '|')}) ", " <n>  <u> ")
    return F.when(spaced.rlike(r"\p{N}"), units).otherwise(named)


def _tokens(spaced: Column) -> Column:
    return F.split(F.btrim(spaced), "  ", -1)


def _tokenised(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep, and the raw and template tokens of each text with a token."""
    spaced = df.select(*keep, _spaced(F.col(text_col)).alias("_s"))
    return spaced.select(*keep, _tokens(F.replace("_s", F.lit("\x01"))).alias("_raw"), _tokens(_template(F.col("_s"))).alias("_tpl"))


def _at(tokens: str, length: Column | int) -> Column:
    return F.slice(tokens, F.col("_at") + 1, length)


def forms_of(benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """Forms (_form, item_id, n_items, _n) and their windows (_form, _n, _j, _h, _len, _verbatim, _usable, _slots), both written.

    Each of a form's _n windows comes by its raw tokens, and by its template where that differs. Templates of
    fewer than ``PLAIN`` plain words don't look for candidates (_usable), and don't count for a form that
    has too few others for that. _slots: per token the number of its slot, null for plain words. An item
    shorter than a window is one window.
    """
    items = _tokenised(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("_text")).distinct(), ["item_id"], "_text").where(F.get("_raw", F.lit(0)) != "")
    valued = items.withColumn("_both", F.zip_with("_tpl", "_raw", lambda t, r: F.concat(t, r)))
    is_slot = lambda t: t.startswith("<")
    numbered = valued.withColumn("_slot", F.transform("_both", lambda b: F.when(is_slot(b), F.array_position("_both", b).cast("int"))))
    form = F.zip_with("_tpl", "_slot", lambda t, k: F.concat(t, F.coalesce(k.cast("string"), F.lit(""))))
    length = F.least(F.lit(window), F.size("_tpl"))
    placed = numbered.select("item_id", F.xxhash64(form).alias("_form"), "_raw", "_tpl", "_slot", length.alias("_len"), F.explode(F.sequence(F.lit(0), F.size("_tpl") - length)).alias("_at"))
    plain = F.size(F.filter(_at("_tpl", window), lambda t: ~is_slot(t)))
    raw, template = F.xxhash64(_at("_raw", F.col("_len"))), F.xxhash64(_at("_tpl", F.col("_len")))
    verbatim = F.struct(raw.alias("h"), F.lit(True).alias("v"))
    hashes = F.when((F.col("_len") == window) & (raw != template), F.array(verbatim, F.struct(template.alias("h"), F.lit(False).alias("v")))).otherwise(F.array(verbatim))
    rows = placed.select("item_id", "_form", F.col("_at").alias("_j"), "_len", ((plain >= PLAIN) & (F.col("_len") == window)).alias("_usable"), _at("_slot", F.col("_len")).alias("_slots"), F.explode(hashes).alias("_w"))
    rows = written(rows.select("item_id", "_form", "_j", "_len", "_usable", "_slots", F.col("_w.h").alias("_h"), F.col("_w.v").alias("_verbatim")))
    windows = rows.groupBy("_form", "_j", "_h", "_verbatim").agg(F.first("_slots").alias("_slots"), F.first("_usable").alias("_usable"), F.first("_len").alias("_len"))
    sizes = windows.groupBy("_form").agg(F.count_distinct("_j").alias("_n"), F.count_distinct(F.when(F.col("_usable"), F.col("_j"))).alias("_good"))
    held = windows.join(sizes, "_form").where(F.col("_verbatim") | F.col("_usable") | (F.col("_good") >= _seeking(coverage))).drop("_good")
    named = rows.select("_form", "item_id").distinct().groupBy("_form").agg(F.min("item_id").alias("item_id"), F.count("item_id").alias("n_items"))
    return written(named), written(held)


def _seeking(coverage: float) -> Column:
    """How many windows of a form have one among them that any leak matches."""
    return (F.col("_n") - F.ceil(F.lit(coverage) * F.col("_n") - 1e-9) + 1).cast("int")


def _seekers(windows: DataFrame, coverage: float) -> DataFrame:
    """(_form, _h) for enough windows of each form that a leak matches one of them: usable ones first, those that fewest forms share."""
    strong = windows.where(F.col("_verbatim") | F.col("_usable"))
    shared = strong.groupBy("_h").agg(F.count_distinct("_form").alias("_forms"))
    ranked = strong.join(shared, "_h").groupBy("_form", "_n", "_j", "_usable").agg(F.max("_forms").alias("_forms"), F.collect_set("_h").alias("_hs"))
    few = ranked.groupBy("_form", "_n").agg(F.array_sort(F.collect_list(F.struct((~F.col("_usable")).alias("_weak"), "_forms", "_j", "_hs"))).alias("_all"))
    return few.select("_form", F.explode(F.slice("_all", F.lit(1), _seeking(coverage))).alias("_s")).select("_form", F.explode("_s._hs").alias("_h"))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(_t1, _t2, item_id, n_items, n_windows, n_matched, n_verbatim) for each text that leaks and form of items; written.

    _t1 and _t2 are the hash of the text. The benchmark is (item_id, text). Null and empty texts leak nothing,
    null and empty items are none. An empty table on either side gives no rows.
    """
    forms, windows = forms_of(benchmark, window, coverage)
    # The few lengths of windows there are: that of a window, and shorter ones of short items.
    lengths = sorted(r[0] for r in windows.select("_len").distinct().collect())
    if not lengths:
        lengths = [window]
    hashes = written(windows.select("_h").distinct())
    blocks = max(1, -(-hashes.count() // block_windows))
    text = F.col(text_col).cast("string")
    t1, t2 = hash128(F.coalesce(text, F.lit("")))
    rows = docs.select(t1.alias("_t1"), t2.alias("_t2"), text.alias("_text"))
    own = _tokenised(rows, ["_t1", "_t2"], "_text")
    # The outer form keeps the optimizer from computing templates once more in a filter below.
    placed = own.select("_t1", "_t2", "_raw", "_tpl", F.explode_outer(F.when(F.size("_tpl") >= lengths[0], F.sequence(F.lit(0), F.size("_tpl") - lengths[0]))).alias("_at"))
    forms_at = [F.when(F.col("_at") + k <= F.size("_raw"), F.xxhash64(_at("_raw", k))) for k in lengths]
    forms_at += [F.when(F.col("_at") + window <= F.size("_raw"), F.xxhash64(_at("_tpl", window)))] if window in lengths else []
    hashed = placed.select("_t1", "_t2", "_raw", "_at", F.explode(F.array_distinct(F.array(*forms_at))).alias("_h"))

    def hits(block: int) -> DataFrame:
        part = hashes if blocks == 1 else hashes.where(F.pmod(F.xxhash64("_h"), F.lit(blocks)) == block)
        return hashed.join(F.broadcast(part), "_h", "left_semi").select("_t1", "_t2", "_at", "_h", F.transform(_at("_raw", window), lambda t: F.xxhash64(t)).alias("_values"))

    # Equal texts share their hits from here on.
    found = written(reduce(DataFrame.union, map(hits, range(blocks))).groupBy("_t1", "_t2", "_at", "_h").agg(F.first("_values").alias("_values")))
    candidates = written(found.select("_t1", "_t2", "_h").join(_seekers(windows, coverage), "_h").select("_t1", "_t2", "_form").distinct())
    wanted = candidates.join(windows, "_form").join(found, ["_t1", "_t2", "_h"])
    slots = F.filter(F.arrays_zip(F.col("_slots").alias("s"), F.slice("_values", F.lit(1), F.size("_slots")).alias("v")), lambda p: p.s.isNotNull())
    matched = wanted.select("_t1", "_t2", "_form", "_n", (F.col("_at") - F.col("_j")).alias("_shift"), "_j", "_verbatim", slots.alias("_pairs"))
    # An alignment has at most two rows a window of the item.
    aligned = matched.groupBy("_t1", "_t2", "_form", "_n", "_shift").agg(F.collect_list(F.struct("_j", "_verbatim", "_pairs")).alias("_w"))
    aligned = aligned.withColumn("_p", F.array_distinct(F.flatten("_w._pairs")))
    twice = F.transform(F.filter("_p", lambda p: F.size(F.filter("_p", lambda q: q.s == p.s)) > 1), lambda p: p.s)
    good = F.filter("_w", lambda w: w["_verbatim"] | ~F.arrays_overlap(F.transform(w["_pairs"], lambda p: p.s), F.col("_bad")))
    windows_found = aligned.withColumn("_bad", twice).select("_t1", "_t2", "_form", "_n", F.explode(good).alias("_w"))
    per_window = windows_found.groupBy("_t1", "_t2", "_form", "_n", F.col("_w._j").alias("_j")).agg(F.max(F.col("_w._verbatim").cast("int")).alias("_v"))
    per_form = per_window.groupBy("_t1", "_t2", "_form", "_n").agg(F.count("*").alias("n_matched"), F.sum("_v").alias("n_verbatim")).where(F.col("n_matched") >= coverage * F.col("_n"))
    return written(per_form.join(forms, "_form").select("_t1", "_t2", "item_id", "n_items", F.col("_n").cast("long").alias("n_windows"), "n_matched", F.col("n_verbatim").cast("long").alias("n_verbatim")))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, n_items, n_windows, n_matched, n_verbatim) for each leak.

    A leak is a document and a form of items: item_id is the form's smallest, n_items how many share
    it (rows of the benchmark that repeat count once). n_verbatim counts the windows found by
    their raw tokens, in any case. Every item with a token is found where it stands verbatim; items
    shorter than a window wherever their tokens stand in a row. Items with hardly any window of
    ``PLAIN`` plain words are found verbatim, or changed in those few. Null and empty texts leak
    nothing; texts of any length are read whole. Rows of ``docs`` that repeat give their leaks again,
    a missing id is kept. An empty table on either side gives no rows. Other columns aren't read.
    """
    bad = leaking_texts(docs, benchmark, text_col, **options)
    t1, t2 = hash128(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("_t1"), t2.alias("_t2"))
    return own.join(bad, ["_t1", "_t2"]).drop("_t1", "_t2")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, all columns kept."""
    a, b = fresh(docs, "_t1", "_t2")
    bad = leaking_texts(docs, benchmark, text_col, **options).select(F.col("_t1").alias(a), F.col("_t2").alias(b)).distinct()
    t1, t2 = hash128(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumns({a: t1, b: t2}).join(bad, [a, b], "left_anti").drop(a, b)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leak: document, form of items, its windows, those found, and those found verbatim."""
    return leaks(docs, benchmark)


def _sql_spaced(text: str) -> str:
    out = rf"regexp_replace(coalesce({text}, ''), '{_NAME}', '\1' || chr(1) || '\2', 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '(\p{{N}})[.,:](\p{{N}})', '\1\2', 'g')"
    out = rf"regexp_replace({out}, '(\p{{N}})(\p{{L}})', '\1 \2', 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}\x01]+', ' ', 'g'))"
    return f"' ' || replace(lower({out}), ' ', '  ') || ' '"


#: DuckDB form of ``digest``: windows, forms and slots are compared as text, every window with every other.
SQL = rf"""
WITH t AS (
  SELECT src, id, string_split(trim(replace(s, chr(1), '')), '  ') AS raw,
    string_split(trim(regexp_replace(regexp_replace(regexp_replace(s, ' \x01[^ ]* ', ' <c> ', 'g'), ' \p{{N}}+ ', ' <n> ', 'g'),
      ' <n>  ({UNITS.replace(' ', '|')}) ', ' <n>  <u> ', 'g')), '  ') AS tpl
  FROM (SELECT 'd' AS src, doc_id AS id, {_sql_spaced('text')} AS s FROM documents
        UNION ALL SELECT DISTINCT 'b', item_id, {_sql_spaced('text')} FROM benchmark) x
), z AS (
  SELECT id, raw, tpl, least({WINDOW}, len(tpl)) AS k, [tpl[i] || raw[i] FOR i IN range(1, len(tpl) + 1)] AS pair FROM t WHERE src = 'b' AND raw[1] <> ''
), n AS (
  SELECT id, raw, tpl, k, [CASE WHEN tpl[i][1] = '<' THEN list_position(pair, pair[i]) END FOR i IN range(1, len(tpl) + 1)] AS slot FROM z
), i AS (
  SELECT id, raw, tpl, k, slot, array_to_string([tpl[i] || coalesce(CAST(slot[i] AS VARCHAR), '') FOR i IN range(1, len(tpl) + 1)], ' ') AS form FROM n
), f AS (SELECT form, min(id) AS item_id, count(DISTINCT id) AS n_items FROM i GROUP BY form),
iw AS (
  SELECT form, j, k, slot[j + 1:j + k] AS slots, array_to_string(raw[j + 1:j + k], ' ') AS rk, array_to_string(tpl[j + 1:j + k], ' ') AS tk,
    k = {WINDOW} AND len([x FOR x IN tpl[j + 1:j + k] IF x[1] <> '<']) >= {PLAIN} AS usable
  FROM (SELECT *, unnest(range(0, len(tpl) - k + 1)) AS j FROM i) y
), c AS (
  SELECT form, n, good >= n - ceil({COVERAGE} * n - 1e-9) + 1 AS rich
  FROM (SELECT form, count(DISTINCT j) AS n, count(DISTINCT j) FILTER (WHERE usable) AS good FROM iw GROUP BY form) y
), b AS (
  SELECT DISTINCT form, n, j, k, slots, key, verbatim FROM (
    SELECT form, j, k, slots, usable, rk AS key, true AS verbatim FROM iw
    UNION ALL SELECT form, j, k, slots, usable, tk, false FROM iw WHERE k = {WINDOW} AND rk <> tk) y JOIN c USING (form) WHERE verbatim OR usable OR rich
), dt AS (SELECT id, raw, tpl, unnest(range(0, len(tpl))) AS pos FROM t WHERE src = 'd'),
d AS (
  SELECT id, pos, k, raw[pos + 1:pos + k] AS vals, array_to_string(raw[pos + 1:pos + k], ' ') AS key FROM dt, (SELECT DISTINCT k FROM b) l WHERE pos + k <= len(raw)
  UNION SELECT id, pos, {WINDOW}, raw[pos + 1:pos + {WINDOW}], array_to_string(tpl[pos + 1:pos + {WINDOW}], ' ') FROM dt WHERE pos + {WINDOW} <= len(raw)
), h AS (
  SELECT d.id AS doc_id, b.form, b.n, b.j, d.pos - b.j AS shift, b.verbatim, b.slots, d.vals FROM d JOIN b ON d.key = b.key AND d.k = b.k
), bad AS (
  SELECT doc_id, form, shift, s FROM (SELECT doc_id, form, shift, unnest(slots) AS s, unnest(vals) AS v FROM h) y WHERE s IS NOT NULL
  GROUP BY ALL HAVING count(DISTINCT v) > 1
), badly AS (SELECT doc_id, form, shift, list(s) AS bad FROM bad GROUP BY ALL),
w AS (
  SELECT h.doc_id, h.form, h.n, h.j, max(CAST(h.verbatim AS INT)) AS verbatim FROM h LEFT JOIN badly USING (doc_id, form, shift)
  WHERE h.verbatim OR bad IS NULL OR NOT list_has_any(h.slots, bad) GROUP BY ALL
), m AS (SELECT doc_id, form, n, count(*) AS n_matched, CAST(sum(verbatim) AS BIGINT) AS n_verbatim FROM w GROUP BY ALL HAVING count(*) >= {COVERAGE} * n)
SELECT doc_id, item_id, n_items, CAST(n AS BIGINT) AS n_windows, n_matched, n_verbatim FROM m JOIN f USING (form)
"""
