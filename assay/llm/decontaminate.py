"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each task turns its own documents into one segment of postings (term key, document,
position) sorted by term, without a shuffle of tokens. Test items are cut into windows of consecutive words. A window's
terms are ranked by how often they occur in the corpus. The postings of its rarest term, shifted by the term's offset, are
the candidate starts; the shifted postings of the second rarest are intersected with these, and then those of the other
terms with the few that are left. With ``slop`` a term may stand so many words away from its place (proximity matches);
without, matches are exact phrases. All of this is DataFrame operations: no Python runs on executors.

Only terms that some test item holds can be looked up. Where these are few (counted, see common.BROADCAST_ROWS) they are
broadcast and other tokens leave the pipeline right where they are split; where they are many, a shuffle join does that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, dropped, stored, tidy, unused

#: Words are runs of other characters than these.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: Column) -> Column:
    """The words of a whole text; none for null."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the 128-bit key (d, t) of id and text: rows that share it have the same text, and so the same result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(id_col).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"), F.col(id_col).alias("id"))


def windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(item, phrase) for each window of ``size`` consecutive words, or all words of an item that has fewer; none for no words."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, size).alias("phrase")).distinct()


def vocabulary(phrases: DataFrame) -> DataFrame:
    """(term, key): the distinct words of the phrases under 64-bit keys that are distinct too (another seed is taken until they are)."""
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    seed = 0
    while True:
        found = stored(terms.select("term", F.xxhash64("term", F.lit(seed)).alias("key")), "vocabulary")
        n, keys = found.agg(F.count("key"), F.count_distinct("key")).first()
        if n == keys:
            return found
        seed += 1


def build_index(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (key, d, t, pos) of every occurrence of the vocabulary's terms in whole texts, sorted by term in each segment."""
    tokens = _keyed(docs, id_col, text_col).select("d", "t", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    found = tokens.join(broadcast_if_small(vocab), "term").select("key", "d", "t", "pos")
    return stored(found.sortWithinPartitions("key", "d", "t", "pos"), "postings")


def _ranked(phrases: DataFrame, vocab: DataFrame, index: DataFrame) -> DataFrame:
    """(wid, m, terms): a window's terms (n, off, key) from the rarest; windows with a term that the corpus lacks are out."""
    counts = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
    # a frequent term is in very many windows: a row a term is joined where the windows are, if that is small
    terms = phrases.select("wid", F.size("phrase").alias("m"), F.posexplode("phrase").alias("off", "term")).join(broadcast_if_small(vocab), "term")
    ranked = terms.join(broadcast_if_small(counts), "key").groupBy("wid", "m").agg(F.sort_array(F.collect_list(F.struct("n", "off", "key"))).alias("terms"))
    return ranked.where(F.size("terms") == F.col("m"))


def _near(start: Column, slop: int) -> Column:
    return F.explode(F.sequence(start - slop, start + slop)) if slop else start


def matches(index: DataFrame, phrases: DataFrame, vocab: DataFrame, slop: int = 0) -> DataFrame:
    """(d, t, wid, start, m): every place where all words of a window stand, each at most ``slop`` words off its place.

    ``phrases`` has (wid, phrase), phrases of any number of words. ``start`` is where the rarest term puts the window.
    """
    ranked = stored(_ranked(phrases, vocab, index), "windows")
    longest = ranked.agg(F.max("m")).first()[0] or 0
    place = ["d", "t", "wid", "m", "start"]
    first = ranked.select("wid", "m", F.col("terms")[0]["key"].alias("key"), F.col("terms")[0]["off"].alias("off"), F.get("terms", F.lit(1)).alias("next"))
    first = first.select("wid", "m", "key", "off", F.col("next.key").alias("key2"), F.col("next.off").alias("off2"))
    found = index.join(broadcast_if_small(first), "key").select("d", "t", "wid", "m", (F.col("pos") - F.col("off")).alias("start"), "key2", "off2")
    found = found.where("start >= 0") if not slop else found
    alone = found.where("m = 1").select(place)
    # the second rarest
    some = index.join(broadcast_if_small(first.where("m > 1").select(F.col("key2").alias("key")).distinct()), "key", "left_semi")
    asked = found.where("m > 1").select(*place, F.col("key2").alias("key"), _near(F.col("start") + F.col("off2"), slop).alias("pos"))
    two = stored(asked.join(some, ["d", "t", "key", "pos"], "left_semi").select(place).distinct(), "intersected")
    # all others at once, in the documents that are left
    left = stored(two.where("m > 2").select("d", "t").distinct(), "candidates")
    some = index.join(broadcast_if_small(left), ["d", "t"], "left_semi")
    others = ranked.where("m > 2").select("wid", F.explode(F.expr("slice(terms, 3, m)")).alias("x")).select("wid", "x.key", "x.off")
    asked = two.where("m > 2").join(broadcast_if_small(others), "wid").select(*place, "key", "off", _near(F.col("start") + F.col("off"), slop).alias("pos"))
    # a bit for each term found, 62 to a number; repeated rows of the corpus set the same bits
    bits = [F.bit_or(F.when(F.expr(f"off div 62 = {k}"), F.expr("shiftleft(1L, off % 62)")).otherwise(0)) for k in range(-(-longest // 62))]
    seen = asked.join(some, ["d", "t", "key", "pos"]).groupBy(place).agg(sum(map(F.bit_count, bits), F.lit(0)).alias("n"))
    rest = seen.where("n = m - 2").select(place)
    return alone.distinct().unionByName(two.where("m = 2")).unionByName(rest).select("d", "t", "wid", "start", "m")


def _matched(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, slop: int) -> tuple[DataFrame, DataFrame]:
    """The matches of windows (item, phrase) in documents, and the windows (wid, phrase), both stored."""
    phrases = stored(found.select("phrase").distinct().withColumn("wid", F.monotonically_increasing_id()), "phrases")
    vocab = vocabulary(phrases)
    index = build_index(docs, vocab, id_col, text_col)
    hits = stored(matches(index, phrases, vocab, slop), "matches")
    dropped(index)
    return hits, phrases


@tidy
def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: id, d, t, n_words, n_hit, items (the ids found, as sorted strings).

    A word inside any occurrence of a window is hit, once however many windows hold it. Null and empty texts have no words
    and no hits; null ids keep their rows, repeated rows are judged alike. Items without words match nothing, items with a
    null id match but name no item. Other columns of either table are not looked at. Empty tables give no rows or no hits.
    """
    found = stored(windows(items, item_col, item_text_col, size), "phrases")
    hits, phrases = _matched(docs, found, id_col, text_col, slop)
    before = Window.partitionBy("d", "t").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("d", "t", "start").agg(F.max("m").alias("m"))
    spans = spans.select("d", "t", "start", (F.col("start") + F.col("m")).alias("end")).withColumn("from", F.greatest("start", F.max("end").over(before)))
    n_hit = spans.where("end > from").groupBy("d", "t").agg(F.sum(F.col("end") - F.col("from")).alias("n_hit"))
    names = found.join(phrases, "phrase").select("wid", "item")
    named = hits.select("d", "t", "wid").distinct().join(broadcast_if_small(names), "wid").select("d", "t", "item").distinct()
    named = named.groupBy("d", "t").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = _keyed(docs, id_col, text_col).select("id", "d", "t", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    judged = judged.join(n_hit.join(named, ["d", "t"], "left"), ["d", "t"], "left")
    none = F.array().cast("array<string>")
    return judged.select("id", "d", "t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


@tidy
def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """The rows of ``docs``, as they are, in which no window of an item occurs."""
    hits, _ = _matched(docs, windows(items, item_col, item_text_col, size), id_col, text_col, slop)
    d, t = unused(docs, "d", "t")
    bad = stored(hits.select("d", "t").distinct().toDF(d, t), "contaminated")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(broadcast_if_small(bad), (F.xxhash64(docs[id_col]) == F.col(d)) & (F.xxhash64(text) == F.col(t)), "left_anti")


@tidy
def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of each document that occurrences of 10-word windows of the benchmark hit, and whose windows these are."""
    got = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same rows for DuckDB: all windows of the documents, of every length that items' windows have, joined by their text.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
q AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT q.doc_id, q.s, p.m, p.item_id FROM q JOIN p ON q.phrase = p.phrase AND q.m = p.m),
n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS spot FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
