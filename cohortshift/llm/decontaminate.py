r"""Benchmark decontamination, native: a positional inverted index of the training words, phrase matches from
the rarest words of each test window outwards.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. A window is 13 consecutive
words of an item, or a shorter item as a whole. The corpus is split into words once, into a saved table. Terms
are counted there by partial aggregates before any join. Each window's two rarest terms in the corpus are looked
up: the stored index holds the postings (term, row, position) of these terms only. The rarest term's postings
give a window's start, the list of the other is intersected at the adjusted offset, and the words left are
compared last, a document's candidates at once. A document word inside any occurrence is hit.

There is one plan for every size, without hints: tables of the test side are saved, so Spark knows their sizes and
broadcasts those under its own threshold. A term with over 1/`HOT_SHARE` of all words is hot (at most HOT_SHARE terms
are, whatever the corpus); its postings are dealt over `SALTS` salts, and its rows of the test side copied to each.
Hits are few (they are real occurrences), and what is grouped is bounded by one document's own words.

Defined cases: null and empty texts have no words (n_words 0, nothing hit); items without words match nothing;
repeated items and items of equal windows each count by item_id; rows without a doc_id are left out; rows that
share a doc_id are rows of their own; an empty benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

WINDOW = 13
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HOT_SHARE, SALTS = 1000, 32


def words(text: str) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NON_WORD, -1), lambda w: w != "")


def split_words(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, doc_id, words), saved; uid names a row."""
    rows = docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("uid"), "doc_id", words("text").alias("words"))
    return scratch.save(rows, "words")


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows, as arrays of words, and the items that have them."""
    items = benchmark.where("item_id is not null").select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    cut = f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))"
    windows = items.select(F.col("item_id").cast("string").alias("item"), F.explode(F.expr(cut)).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items"))


def term_frequencies(corpus: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n, hot): postings in the corpus of each term of the test side that it has."""
    total = corpus.agg(F.sum(F.size("words"))).first()[0] or 0
    n = corpus.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # an inner join: a semi-join would be pushed below the counts and deal all words by term
    known = n.join(windows.select(F.explode("window").alias("term")).distinct(), "term")
    return known.select("term", "n", (F.col("n") * HOT_SHARE > total).alias("hot"))


def anchored(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(term, off, hot, term2, off2, window, len, items): windows at their two rarest terms; those with an absent term can't occur."""
    t = windows.select("window", F.posexplode("window").alias("off", "term")).join(frequencies, "term")
    ranked = t.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term", "hot"))).alias("r")).where("size(r) = size(window)")
    at = "r[least(1, size(r) - 1)]"
    ranked = ranked.selectExpr("r[0].term AS term", "r[0].off AS off", "r[0].hot AS hot", f"{at}.term AS term2", f"{at}.off AS off2", "window", "size(window) AS len")
    return ranked.join(windows, "window")


def _salted(terms: DataFrame) -> DataFrame:
    """Rows of the test side, those of hot terms once for each salt."""
    return terms.withColumn("salt", F.explode(F.expr(f"if(hot, sequence(0, {SALTS - 1}), array(0))")))


def postings(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, salt, uid, pos): the index, restricted to the given terms (term, hot)."""
    hot = [r["term"] for r in terms.where("hot").select("term").collect()]  # at most HOT_SHARE
    salt = F.pmod(F.xxhash64("uid", "pos"), F.lit(SALTS)).cast("int")
    p = corpus.select("uid", F.posexplode("words").alias("pos", "term"))
    p = p.withColumn("salt", F.when(F.col("term").isin(hot), salt).otherwise(0) if hot else F.lit(0))
    return p.join(_salted(terms).select("term", "salt"), ["term", "salt"], "left_semi").select("term", "salt", "uid", "pos")


def phrase_matches(corpus: DataFrame, windows: DataFrame, frequencies: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, start, len, items): each occurrence of each test window."""
    anchors = scratch.save(anchored(windows, frequencies), "anchors")
    needed = anchors.select("term").union(anchors.select("term2")).distinct()
    index = scratch.save(postings(corpus, scratch.save(frequencies.join(needed, "term", "left_semi"), "terms")), "index")
    first = index.join(_salted(anchors).drop("hot"), ["term", "salt"]).withColumn("start", F.expr("pos - off")).where("start >= 0")
    second = index.select("uid", F.col("term").alias("term2"), (F.col("pos")).alias("at2"))
    both = first.withColumn("at2", F.expr("start + off2")).join(second, ["uid", "term2", "at2"], "left_semi")
    found = both.groupBy("uid").agg(F.collect_list(F.struct("start", "len", "window", "items")).alias("found"))
    # words hold no space: a string takes less than half of an array's place in the shuffle
    texts = corpus.select("uid", F.array_join("words", " ").alias("text")).join(found, "uid")
    texts = texts.select("uid", "found", F.explode(F.array(F.split("text", " ", -1))).alias("words"))
    exact = F.expr("filter(found, c -> slice(words, c.start + 1, c.len) = c.window)")
    return texts.select("uid", F.explode(exact).alias("c")).select("uid", "c.start", "c.len", "c.items")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = 4, within: int = 30, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, at): places where an item's rarest terms all stand within so many words, in any order."""
    scratch = Scratch(docs.sparkSession)
    corpus, windows = split_words(docs, scratch), scratch.save(test_windows(benchmark, size), "windows")
    freq = scratch.save(term_frequencies(corpus, windows), "terms")
    items = benchmark.where("item_id is not null").select("item_id", F.explode(words("text")).alias("term")).distinct().join(freq, "term")
    rare = items.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("n", "term"))).where(F.col("k") <= terms)
    rare = scratch.save(rare.withColumn("need", F.count("*").over(Window.partitionBy("item_id"))), "rare")
    index = postings(corpus, rare.select("term", "hot").distinct())
    p = index.join(_salted(rare), ["term", "salt"]).select("uid", "item_id", "need", "pos", "term")
    near = Window.partitionBy("uid", "item_id").orderBy("pos").rangeBetween(-within, 0)
    at = p.withColumn("have", F.size(F.collect_set("term").over(near))).where("have = need")
    return at.join(corpus.select("uid", "doc_id"), "uid").select("doc_id", "item_id", F.col("pos").alias("at")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, items (sorted as strings) and contaminated."""
    scratch = Scratch(docs.sparkSession)
    corpus, windows = split_words(docs, scratch), scratch.save(test_windows(benchmark, size), "windows")
    freq = scratch.save(term_frequencies(corpus, windows), "terms")
    hits = scratch.save(phrase_matches(corpus, windows, freq, scratch), "hits")  # read twice
    order = Window.partitionBy("uid").orderBy("start", "len")
    spans = hits.select("uid", "start", "len").distinct()
    reached = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", F.coalesce(reached, F.col("start"))))
    covered = spans.withColumn("g", gained).groupBy("uid").agg(F.sum("g").cast("long").alias("n_hit"))
    items = hits.select("uid", F.explode("items").alias("item")).groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = corpus.select("uid", "doc_id", F.size("words").cast("long").alias("n_words")).join(covered.join(items, "uid"), "uid", "left")
    none = F.expr("cast(array() as array<string>)")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = contamination(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
