"""Benchmark decontamination over a distributed positional inverted index of training text, in Spark expressions only.

Index. A word is a run of characters other than ASCII separators, with A-Z in lower case. Every task writes a segment of
postings (term, document, position) for all words that any test item holds, sorted by term, and the lengths of its
documents. Segments need no shuffle, so building is one scan however skewed words or documents are; since they are sorted,
a look-up of some terms skips the pages of others. Terms are numbered from the most to the least frequent in the test
items, so that the rare ones, with which look-ups begin, stand together at the end. The index is a table in the shared
folder; collection frequencies are counted from it once.

Exact phrases. A window of an item is WINDOW consecutive words (a shorter item is one window). Its list of starts is the
intersection of its terms' position lists, each shifted by the term's offset. Frequencies order the intersection: the two
rarest terms of each window come first and leave few (document, item, diagonal) candidates, where a diagonal is position
minus offset. Windows with a term that no document has are dropped at once. A candidate then asks for all words of its
item at their places, and meets the postings by equality of document, term and position; runs of consecutive offsets at
least a window long are what occurs. All windows of an item on a diagonal share that work, so a passage costs its length,
not its length times the window, and a document that repeats a passage costs what the repeats are long.

Proximity. proximity_matches() relaxes the shift: every term of a phrase within SLOP positions of where the rarest one
puts it. contamination() counts the items whose PROBE rarest words stand so. Positions meet by blocks of 2 SLOP + 1, so a
word that a document repeats meets only its neighbourhood.

Rows are told apart by id and a hash of the text, so repeated ids with different texts keep their own results and equal
rows get equal results. A null text or a text without words has no words and no hits; items without words have no
windows; a null item_id can hit but is not listed; empty tables give no hits or no rows. Test terms and candidates are
broadcast only if their measured bytes are few, and meet the postings in a shuffled join beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.shared import fresh, measured_broadcast, written

WINDOW = 10
#: How far from its place a word may stand, and of how many of an item's rarest words, for a proximity match.
SLOP = 5
PROBE = 3
#: Separators between words, as a Java pattern; A-Z are words' letters here and lower-cased after.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word put after every text: its last place is the number of the text's words.
_END = "\ue000"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def lowered(word: Column) -> Column:
    """A-Z in lower case and no other letter; lower() alone where the word is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


@dataclass
class Index:
    """postings: term_id, doc_id, doc_hash, pos, with a row of term_id -1 for each document at its length.

    terms: term, term_id. frequencies: term_id, cf of the terms that some document has.
    """

    postings: DataFrame
    terms: DataFrame
    frequencies: DataFrame

    def lengths(self) -> DataFrame:
        return self.postings.where("term_id = -1").select("doc_id", "doc_hash", F.col("pos").alias("n_words"))

    def of_terms(self, ids: DataFrame) -> DataFrame:
        """Postings of the given term_id, by a scan from the first page that can have one."""
        least = ids.agg(F.min("term_id")).first()[0]
        return self.postings.where(F.col("term_id") >= (0 if least is None else least)).join(measured_broadcast(ids.select("term_id").distinct()), "term_id", "left_semi")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item (tells equal ids with other texts apart), n, off, term."""
    own = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("item")).dropDuplicates(["item_id", "item"])
    return own.select("item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("off", "term")).withColumn("term", lowered(F.col("term")))


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings over all documents of the terms (column term) of the given item words."""
    ordered = items.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term")
    known = written(ordered.select("term", F.monotonically_increasing_id().alias("term_id")).unionAll(docs.sparkSession.range(1).select(F.lit(_END), F.lit(-1).cast("long"))), "terms")
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.hash(text_col).alias("doc_hash"), (F.octet_length(text) == F.char_length(text)).alias("ascii"), F.split(F.concat(text, F.lit(f" {_END}")), SEPARATORS).alias("w"))
    # Only the first part of a split can be empty: where the text begins with a separator.
    split = split.select("doc_id", "doc_hash", "ascii", "w", F.size("w").alias("n"), F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0).alias("skip"))
    rows = split.select("doc_id", "doc_hash", "ascii", "n", "skip", F.posexplode("w").alias("at", "word"))
    word = F.when(F.col("ascii"), F.lower("word")).otherwise(lowered(F.col("word")))
    found = rows.withColumn("word", word).join(measured_broadcast(known), F.col("word") == F.col("term"))
    # The end word may be a word of texts and items as well: its last place is the end, and nothing else is.
    found = found.where((F.col("term_id") >= 0) == (F.col("at") < F.col("n") - 1)).withColumn("pos", F.col("at") - F.col("skip"))
    postings = written(found.select("term_id", "doc_id", "doc_hash", "pos").sortWithinPartitions("term_id"), "postings")
    cf = written(postings.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("cf")), "frequencies")
    return Index(postings, known.where("term_id >= 0"), cf)


def _with_frequencies(items: DataFrame, index: Index) -> DataFrame:
    """Item words with term_id and cf; cf is 0 where no document has the term."""
    held = items.join(measured_broadcast(index.terms), "term")
    return held.join(measured_broadcast(index.frequencies), "term_id", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))


_ITEM = ["item_id", "item", "n"]


def _same(a: str, b: str, *names: str) -> Column:
    """Equality of columns of two sides, of which ids can be null."""
    out = F.lit(True)
    for n in names:
        x, y = F.col(f"{a}.{n}"), F.col(f"{b}.{n}")
        out = out & (x.eqNullSafe(y) if n in ("doc_id", "item_id") else x == y)
    return out


def phrase_runs(index: Index, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_hash, item_id, item, first_pos, last_pos of every maximal run of an item's words that holds a window.

    `items` are item words with frequencies.
    """
    size = F.least(F.lit(window), F.col("n"))
    per_window = items.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - size + 1), F.least(F.col("off"), F.col("n") - size))))
    of_window = Window.partitionBy("item_id", "item", "start")
    ranked = per_window.withColumn("least", F.min("cf").over(of_window)).withColumn("rank", F.row_number().over(of_window.orderBy("cf", "off")))
    rarest = written(ranked.where("least > 0 AND rank <= 2").select(*_ITEM, "off", "term_id").distinct(), "rarest")
    hits = index.of_terms(rarest).join(measured_broadcast(rarest), "term_id").select("doc_id", "doc_hash", *_ITEM, (F.col("pos") - F.col("off")).alias("diagonal"), "off")
    both = hits.groupBy("doc_id", "doc_hash", *_ITEM, "diagonal").agg(F.min("off").alias("lo"), F.max("off").alias("hi")).where(f"lo < hi OR least(n, {int(window)}) = 1")
    candidates = written(both.drop("lo", "hi"), "candidates").alias("c")
    # A candidate asks for each word of its item at its place.
    held = items.select("item_id", "item", "off", "term_id").alias("i")
    wanted = candidates.join(measured_broadcast(held), _same("c", "i", "item_id", "item"))
    wanted = wanted.select("c.doc_id", "c.doc_hash", "i.term_id", (F.col("c.diagonal") + F.col("i.off")).alias("pos"), "c.item_id", "c.item", "c.n", "c.diagonal", "i.off").where("pos >= 0")
    p, w = index.postings.where("term_id >= 0").alias("p"), measured_broadcast(wanted).alias("w")
    matched = p.join(w, _same("p", "w", "doc_id", "doc_hash", "term_id", "pos")).select("w.doc_id", "w.doc_hash", "w.item_id", "w.item", "w.n", "w.diagonal", "w.off").distinct()
    on = Window.partitionBy("doc_id", "doc_hash", *_ITEM, "diagonal").orderBy("off")
    runs = matched.repartition("doc_id", "doc_hash").withColumn("island", F.col("off") - F.row_number().over(on))
    runs = runs.groupBy("doc_id", "doc_hash", *_ITEM, "diagonal", "island").agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    runs = runs.where(F.col("hi") - F.col("lo") + 1 >= size)
    return runs.select("doc_id", "doc_hash", "item_id", "item", (F.col("diagonal") + F.col("lo")).alias("first_pos"), (F.col("diagonal") + F.col("hi")).alias("last_pos"))


def proximity_matches(index: Index, phrases: DataFrame, slop: int = SLOP, probe: int | None = None) -> DataFrame:
    """doc_id, doc_hash, item_id, item, pos: places of a phrase's rarest word with every other word near its place.

    A word is near if it stands within `slop` positions of where the phrase, laid over the rarest word, has it. With
    `probe` only so many of a phrase's rarest words count. `phrases` are item words with frequencies.
    """
    by_item = Window.partitionBy("item_id", "item")
    ranked = phrases.withColumn("least", F.min("cf").over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("cf", "off"))).where("least > 0")
    ranked = written(ranked if probe is None else ranked.where(F.col("rank") <= probe), "phrases")
    first = ranked.where("rank = 1").select("item_id", "item", F.col("off").alias("first_off"), "term_id")
    held = ranked.groupBy("item_id", "item").agg(F.max("rank").alias("words"))
    rest = ranked.where("rank > 1").select("item_id", "item", "off", "term_id")
    at = index.of_terms(first).join(measured_broadcast(first), "term_id").select("doc_id", "doc_hash", "item_id", "item", F.col("pos").alias("at"), "first_off").distinct().alias("a")
    single = at.join(measured_broadcast(held.where("words = 1")).alias("h"), _same("a", "h", "item_id", "item"), "left_semi")
    wanted = at.join(measured_broadcast(rest).alias("r"), _same("a", "r", "item_id", "item"))
    place = F.col("a.at") + F.col("r.off") - F.col("a.first_off")
    block = 2 * slop + 1
    wanted = wanted.select("a.doc_id", "a.doc_hash", "r.term_id", "a.item_id", "a.item", "a.at", "r.off", place.alias("place"))
    wanted = wanted.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col("place") - slop) / block), F.floor((F.col("place") + slop) / block))))).alias("w")
    p = index.of_terms(rest).withColumn("block", F.floor(F.col("pos") / block)).alias("p")
    met = p.join(wanted, _same("p", "w", "doc_id", "doc_hash", "term_id", "block") & (F.abs(F.col("p.pos") - F.col("w.place")) <= slop))
    met = met.select("w.doc_id", "w.doc_hash", "w.item_id", "w.item", "w.at", "w.off").distinct()
    full = met.groupBy("doc_id", "doc_hash", "item_id", "item", "at").agg((F.count("*") + 1).alias("words")).alias("f")
    full = full.join(measured_broadcast(held).alias("h"), _same("f", "h", "item_id", "item", "words"), "left_semi")
    return full.select("doc_id", "doc_hash", "item_id", "item", F.col("at").alias("pos")).unionByName(single.select("doc_id", "doc_hash", "item_id", "item", F.col("at").alias("pos")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", near: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, n_near for every row of `docs`.

    n_near counts the items with a proximity match of their PROBE rarest words.
    """
    items = item_words(benchmark, item_col, item_text_col)
    index = build_index(docs, items, id_col, text_col)
    items = written(_with_frequencies(items, index), "items")
    runs = phrase_runs(index, items, window)
    of_doc = Window.partitionBy("doc_id", "doc_hash").orderBy("first_pos", "last_pos")
    before = F.max("last_pos").over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last_pos") - F.greatest(F.col("first_pos"), F.coalesce(before + 1, F.lit(0))) + 1)
    per_doc = runs.withColumn("fresh", fresh).groupBy("doc_id", "doc_hash").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    joined = index.lengths().alias("d").join(per_doc.alias("h"), _same("d", "h", "doc_id", "doc_hash"), "left")
    ids = F.coalesce("h.ids", F.array().cast("array<string>"))
    columns = [
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.n_words").cast("long").alias("n_words"),
        F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("h.n_hit") > 0, F.lit(False)).alias("contaminated"),
    ]
    if not near:
        return joined.select(columns)
    close = proximity_matches(index, items, probe=PROBE).select("doc_id", "doc_hash", "item_id", "item").distinct()
    close = close.groupBy("doc_id", "doc_hash").agg(F.count("*").alias("n_near"))
    return joined.join(close.alias("c"), _same("d", "c", "doc_id", "doc_hash"), "left").select(*columns, F.coalesce("c.n_near", F.lit(0)).alias("n_near"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs; all rows of an id go if one of them is hit."""
    (name,) = fresh(docs, "hit_id")
    hit = contamination(docs, benchmark, id_col=id_col, text_col=text_col, near=False).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
