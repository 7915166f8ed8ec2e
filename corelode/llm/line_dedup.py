"""Removal of near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct lower-cased words, ordered by rarity: a word's hash falls into one
of 65,536 buckets, and the key of a word is the logarithm of its bucket's count over the whole corpus
above twice the median bucket's, then its length, longer ones first, then 52 bits of the hash.  Words too rare to stand out
of their buckets, which in a large corpus are nearly all, are so told apart by length, which follows rarity.  The order is total and
needs a table of fixed size (64 KB) only.

Equal lines are one class (SHA-256); its first line stands for it.  Two sets of Jaccard similarity of
at least 0.8 share a key of their prefixes, so each class posts its prefix by key, and pairs under one key are
held against the length, positional and bitmap filters.  A large family of near-copies is not joined
with itself: under a key of many classes each is first held against the earliest alone, and only
classes that found no match anywhere are then held against all others.  What passes is verified
on the words themselves.

A line goes if it equals an earlier line or its words are similar to those of one; earlier means a
smaller (id, row, line number), where rows of one id are ordered by the hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import ship, written

#: Similarity as a fraction: numerator, denominator.
SIMILARITY = (4, 5)
BUCKET_BITS = 16
#: Keys hold so many bits of the word's hash below those of its length, and these below the level of rarity.
HASH_BITS, LENGTH_BITS = 52, 6
#: Sets of more words than this spread their bitmap over 128 bits.
LARGE_SET = 80
#: Postings of a key up to which all its pairs are formed at once.
GROUP = 512
#: Row hash and line number in one number.
NUMBER_BITS = 31


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): ``row`` tells rows of one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.where("id is not null and text is not null").select("id", F.xxhash64("text").alias("row"), "text")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, line_no, at, line): lower-cased lines; (id, at) is a line's address and its place in the order."""
    cut = F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line")
    lines = _rows(docs, id_col, text_col).select("id", "row", cut)
    at = F.shiftleft(F.col("row").bitwiseAND(F.lit((1 << 32) - 1)), NUMBER_BITS).bitwiseOR(F.col("line_no").cast("long"))
    return lines.select("id", "row", "line_no", at.alias("at"), "line")


def _words(text: Column, blanks: str = "\t\x0b\x0c\r") -> Column:
    """Words between blanks; replacing blanks first lets the split take its path for one plain character."""
    for b in blanks:
        text = F.replace(text, F.lit(b), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _digest(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line.cast("binary"), 256)), 1, 16)


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def rarity_levels(docs: DataFrame, text_col: str = "text") -> bytes:
    """One printable character for each bucket (a fixed number): thirds of the base-2 logarithm of its words' count over all texts.

    It is 0 up to twice the median count, which words that fill a bucket by chance do not exceed by much.
    """
    words = docs.select(F.explode(_words(F.lower(text_col), "\n\t\x0b\x0c\r")).alias("word"))
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).count()
    dense = docs.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    dense = dense.select("bucket", F.coalesce("count", F.lit(0)).cast("double").alias("count"))
    found = dense.agg(F.sort_array(F.collect_list(F.struct("bucket", "count"))).alias("all"), F.greatest(F.lit(1.0), 2 * F.median("count")).alias("floor"))
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(31), F.floor(3 * F.log2(F.greatest(x["count"], F.lit(1.0)) / F.col("floor"))) + 1))
    listed = found.select(F.transform("all", lambda x: F.char(33 + level(x))).alias("all"))
    return listed.select(F.array_join("all", "")).first()[0].encode()


def _folded(keys: Column, taken) -> Column:
    """Each key that ``taken`` admits flips one bit of 64."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    flip = (lambda k: F.when(taken(k), bit(k)).otherwise(F.lit(0).cast("long"))) if taken else bit
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(flip(k)))


def class_sets(docs: DataFrame, id_col: str, text_col: str, similarity) -> DataFrame:
    """(id, at, n, low, high, prefix) of the first line of each class of equal lines that have a word."""
    num, den = similarity
    levels = F.lit(rarity_levels(docs, text_col))
    lines = _lines(docs, id_col, text_col)
    cut, longest = 64 - HASH_BITS, (1 << LENGTH_BITS) - 1
    level = lambda h: F.ascii(F.substring(levels, _bucket(h) + 1, F.lit(1)).cast("string")) - 33
    short = lambda w: longest - F.least(F.octet_length(w), F.lit(longest))
    high = lambda w, h: F.shiftleft(level(h), LENGTH_BITS).bitwiseOR(short(w)).cast("long")
    key = lambda w, h: F.shiftleft(high(w, h), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, cut))
    keys = F.transform(_words(F.col("line")), lambda w: key(w, F.xxhash64(w)))
    keyed = lines.select("id", "at", _digest(F.col("line")).alias("digest"), F.sort_array(F.array_distinct(keys)).alias("keys"))
    n, many = F.size("keys"), F.size("keys") > LARGE_SET
    second = lambda k: k.bitwiseAND(F.lit(64).cast("long")) != 0
    low = F.when(many, _folded(F.col("keys"), lambda k: ~second(k))).otherwise(_folded(F.col("keys"), None))
    high = F.when(many, _folded(F.col("keys"), second)).otherwise(F.lit(0).cast("long"))
    take = n - F.ceil(n * num / den).cast("int") + 1
    sets = keyed.select(
        "digest", "id", "at", n.alias("n"), low.alias("low"), high.alias("high"), F.slice("keys", F.lit(1), take).alias("prefix")
    )
    first = F.min(F.struct("id", "at", "n", "low", "high", "prefix"))
    # Asked here, as a filter on the keys before would compute them twice.
    return sets.groupBy("digest").agg(first.alias("f")).select("f.*").where("n > 0")


def _similar_enough(a: dict, b: dict, similarity) -> Column:
    """Bitmap, length and positional filters of two postings of one key, in whole numbers.

    The bitmaps of two sets that share enough differ in (n + m) / 9 bits at most, for a similarity of 4 / 5.
    The positional filter takes the key as the first that both sets share; a pair is not lost where
    it is not, since it is also posted under the first.
    """
    num, den = similarity
    # No column is null; said so, no filter on one side is inferred, which would take its exchange from the other.
    a, b = ({c: v if c in ("low", "high") else F.coalesce(v, F.lit(0)) for c, v in s.items()} for s in (a, b))
    both = a["n"] + b["n"]
    low, high = a["low"].bitwiseXOR(b["low"]), a["high"].bitwiseXOR(b["high"])
    wide = F.bit_count(low) + F.bit_count(high)
    differ = F.when((a["n"] > LARGE_SET) == (b["n"] > LARGE_SET), wide).otherwise(F.bit_count(low.bitwiseXOR(high)))
    lengths = (a["n"] * den >= b["n"] * num) & (b["n"] * den >= a["n"] * num)
    places = ((a["n"] - a["pos"]) * (num + den) >= both * num) & ((b["n"] - b["pos"]) * (num + den) >= both * num)
    return (differ * (num + den) <= both * (den - num)) & lengths & places


def _before(a: str, b: str) -> Column:
    """Is address ``a`` earlier than ``b``?  Prefixes of the columns id and at; no structs are made for each pair."""
    ids, ats = [F.col(f"{s}id") for s in (a, b)], [F.col(f"{s}at") for s in (a, b)]
    return (ids[0] < ids[1]) | ((ids[0] == ids[1]) & (ats[0] < ats[1]))


def _postings(sets: DataFrame, similarity) -> DataFrame:
    """Written candidates and the postings of large groups, from one exchange of the postings by key.

    Rows with ``a_id, a_at`` are pairs that pass the filters: all those of a key of at most GROUP postings, and those with the earliest
    posting of a larger one.  The other rows are the postings of larger groups.
    """
    fields = ("id", "at", "n", "pos", "low", "high")
    posted = sets.select("id", "at", "n", "low", "high", F.posexplode("prefix").alias("pos", "key")).select("key", *fields)
    told = posted.withColumn("many", F.count("*").over(Window.partitionBy("key")))
    none = [F.lit(None).cast("long").alias(c) for c in ("a_id", "a_at")]
    side = lambda s: {c: F.col(f"{s}.{c}") for c in fields}
    x, y = posted.alias("a"), told.where(F.col("many").between(2, GROUP)).alias("b")
    pairs = x.join(y, (F.col("a.key") == F.col("b.key")) & _similar_enough(side("a"), side("b"), similarity) & _before("a.", "b."))
    # Of a pair only the addresses are kept.
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in posted.schema}
    kept = [F.col(f"b.{c}") if c in ("id", "at") else blank[c] for c in fields]
    pairs = pairs.select(blank["key"], *kept, F.col("a.id").alias("a_id"), F.col("a.at").alias("a_at"))
    # Only the few large groups are ordered.
    upto = Window.partitionBy("key").orderBy("id", "at").rowsBetween(Window.unboundedPreceding, 0)
    large = told.where(F.col("many") > GROUP).select("key", *fields, *[F.first(c).over(upto).alias(f"first_{c}") for c in fields])
    near = _similar_enough({c: F.col(f"first_{c}") for c in fields}, {c: F.col(c) for c in fields}, similarity)
    later = _before("first_", "")
    led = F.array(F.struct(*none), F.when(near & later, F.struct(F.col("first_id").alias("a_id"), F.col("first_at").alias("a_at"))))
    large = large.select("key", *fields, F.explode(F.filter(led, lambda v: v.isNotNull())).alias("led")).select("key", *fields, "led.*")
    return written(pairs.union(large), "line-postings")


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, similarity) -> DataFrame:
    """(id, at) of the later lines of the pairs (written: a_id, a_at, id, at) whose words really are similar.

    The lines are fetched once; Spark broadcasts the addresses only where their table is small.
    """
    num, den = similarity
    wanted = written(pairs.select("id", "at").union(pairs.select("a_id", "a_at")).distinct(), "line-addresses")
    told = written(_lines(docs, id_col, text_col).join(wanted, ["id", "at"], "left_semi").select("id", "at", "line"), "line-texts")
    both = pairs.join(told.withColumnRenamed("line", "line_b"), ["id", "at"]).join(
        told.select(F.col("id").alias("a_id"), F.col("at").alias("a_at"), F.col("line").alias("line_a")), ["a_id", "a_at"]
    )
    own = lambda c: F.array_distinct(_words(F.col(c)))
    both = both.select("id", "at", own("line_a").alias("words_a"), own("line_b").alias("words_b"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    similar = shared * (num + den) >= (F.size("words_a") + F.size("words_b")) * num
    return written(both.where(similar).select("id", "at").distinct(), "lines-matched")


def matched_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity=SIMILARITY) -> DataFrame:
    """(id, at) of the first lines of classes whose words are similar to those of an earlier class."""
    posted = _postings(class_sets(docs, id_col, text_col, similarity), similarity)
    led = posted.where("a_id is not null").select("a_id", "a_at", "id", "at")
    easy = _verified(docs, written(led.distinct(), "line-leaders"), id_col, text_col, similarity)
    # Matched classes still stand for themselves as the earlier one; the sign of n tells them apart.
    rest = posted.where("a_id is null").join(easy.withColumn("easy", F.lit(True)), ["id", "at"], "left")
    rest = rest.withColumn("n", F.when(F.col("easy"), -F.col("n")).otherwise(F.col("n"))).select("key", "id", "at", "n", "pos", "low", "high")
    a, b = rest.alias("a"), rest.alias("b")
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("pos", "low", "high")} | {"n": F.abs(F.col(f"{s}.n"))}
    # Both sides are the same rows, so that one exchange serves them: no condition names one side only.
    earlier = _before("a.", "b.") & (F.col("b.n") > F.col("a.pos") * 0)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & _similar_enough(side("a"), side("b"), similarity) & earlier)
    pairs = pairs.select(F.col("a.id").alias("a_id"), F.col("a.at").alias("a_at"), F.col("b.id").alias("id"), F.col("b.at").alias("at"))
    hard = _verified(docs, written(pairs.distinct(), "line-pairs"), id_col, text_col, similarity)
    return easy.union(hard)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity=SIMILARITY) -> DataFrame:
    """(id, row, removed_lines): the numbers, from 0, of each row's lines that go; rows that lose none are left out."""
    matched = matched_classes(docs, id_col, text_col, similarity).withColumn("matched", F.lit(True))
    lines = _lines(docs, id_col, text_col)
    lines = lines.select("id", "row", "line_no", "at", _digest(F.col("line")).alias("digest"), (F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "").alias("worded"))
    lines = lines.where("worded").drop("worded")
    classes = lines.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("many"))
    classes = classes.select("digest", "first.*", "many").join(matched, ["id", "at"], "left")
    # Only classes of which a line goes are told: repeated or matched ones.
    told = classes.where("many > 1 or matched").select("digest", F.struct("id", "at").alias("first"), F.coalesce("matched", F.lit(False)).alias("matched"))
    gone = lines.join(written(told, "line-classes"), "digest").where((F.struct("id", "at") != F.col("first")) | F.col("matched"))
    by_row = gone.groupBy("id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    return written(by_row, "lines-removed")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` that has an id: the id, n_lines, n_removed, removed_lines.

    Every line that has a word takes part; lines without words stay.  A null text has no lines and shows 0; an empty text
    is one empty line.  Rows equal in id and text are one document and lose the same lines.  Other
    columns are not read.  Words are compared by 52 bits of their hash (and their length) when candidates are sought and as text when
    a pair is verified: no line goes wrongly, and a match could be missed only where two words of
    the same pair of lines share those bits.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__row"),
        F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"), F.col(text_col).isNull().alias("__null"),
    )
    found = removed_lines(docs, id_col, text_col).select(F.col("id").alias("__id"), F.col("row").alias("__row"), "removed_lines")
    both = rows.join(found, ["__id", "__row"], "left")
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return both.select(
        F.col(id_col), F.when(F.col("__null"), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of ``text_col``; all rows and other columns stay.

    Rows without an id or a text stay as they are; a text all of whose lines go becomes empty.
    """
    ship(docs.sparkSession)
    found = removed_lines(docs, id_col, text_col).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("removed_lines").alias("__gone"))
    keyed = docs.select("*", F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__row"))
    both = keyed.join(found, ["__id", "__row"], "left").withColumn("__lines", F.split(text_col, "\n"))
    kept = F.array_except(F.sequence(F.lit(1), F.size("__lines")), F.transform("__gone", lambda k: k + 1))
    text = F.array_join(F.transform(kept, lambda k: F.element_at("__lines", k)), "\n")
    return both.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)
