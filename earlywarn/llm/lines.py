"""Line deduplication by an exact set-similarity join (DataFrame only).

A line is the set of its lower-cased words.  A line goes if an earlier line
(by document id, then place) has a Jaccard similarity of ``threshold`` or
more; equal sets have similarity one.

1. Corpus counts of hashed words give every word a rarity class; a word's key
   is (class, hash), so sorting keys puts rare words first, in one order for
   all lines.
2. Lines of equal sets form a class; its first line stands for it.
3. Each class posts the keys of its prefix: sets that are similar enough
   share one.  A self-semi-join of the postings keeps those that meet another
   class within the length filter, the positional filter and a bound on the
   symmetric difference from 64 parity bits.
4. The classes left are numbered in the order of their first lines and get
   256 more parity bits, which leave hardly a pair that is not similar; they
   are verified by their whole sets: each against the
   first classes of its posting lists and, where that finds none, against
   every earlier class it meets.  So in a dense group of n variants most are
   settled by a multiple of n pairs, not by their square.
5. Documents keep the first lines of the classes without an earlier match.

Words are compared by 57-bit and, where sets are verified, 64-bit hashes, classes and texts of one id by 128 bits.

Defined results: a null text stays null, blank lines stay; a document all of
whose lines go has an empty text; rows of equal id and equal text are the
same document listed twice and get the same text, rows of equal id and other
text are ordered by a hash of it; null ids come first, and name no document:
of their rows of equal text one is the first and the others are copies, which
lose all but their blank lines; an empty table gives
an empty result; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import util

BLANKS = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 17  # hashed words counted; also the length of the rarity table
LEADERS = 2  # first classes of a posting list that the others are verified against at once
SENT_ITEMS = 4_000_000  # documents and places of lines, together, that a broadcast may hold
ID, MARK, COPY = "__line_id", "__line_mark", "__line_copy"


def _blanks(text: Column) -> Column:
    """What splits the lines of a text into words: a single blank, which needs
    no regular expression, where the text holds no other white space."""
    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.lit(BLANKS)).otherwise(F.lit(" "))


def rarity_table(df: DataFrame, text_col: str) -> list[int]:
    """Class (0 to 63, rarest first) of every bucket of hashed words, from all
    words of all texts: two classes for each doubling of the count."""
    plain = F.replace(F.lower(F.col(text_col)), F.lit("\n"), F.lit(" "))
    words = df.select(F.explode(F.split(plain, _blanks(F.col(text_col)))).alias("w"))
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select("b", F.least(F.lit(63), F.floor(2 * F.log2(F.col("n") + 1))).cast("int").alias("c"))
    # BUCKETS numbers, however large the corpus is
    table = [0] * BUCKETS
    for r in classes.groupBy("c").agg(F.collect_list("b").alias("bs")).collect():
        for b in r.bs:
            table[b] = r.c
    return table


def _hashes(line: Column, blanks: Column) -> Column:
    """Hashes of the distinct words of a lower-cased line."""
    # only what is below a function with a lambda is interpreted, so empty words are dropped last
    hashes = F.array_distinct(F.transform(F.split(line, blanks), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def _ranks(table: list[int]) -> Column:
    """The classes of ``rarity_table`` as an array; folded to one literal
    before tasks read it."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")


def _keys(hashes: Column, ranks: Column) -> Column:
    """Sorted word keys, rarest first."""

    def key(h: Column) -> Column:
        cls = F.shiftleft(ranks[h.bitwiseAND(F.lit(BUCKETS - 1))].cast("long"), 57)
        # never null, so that whole numbers are sorted and not objects
        return F.coalesce(cls, F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 7))

    return F.sort_array(F.transform(hashes, key))


def checked(small: DataFrame, places: str) -> DataFrame:
    """A written table of documents with lists of places is sent to all tasks
    if it holds at most ``SENT_ITEMS`` of both; a larger one is joined by a
    shuffle on both sides."""
    items = small.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(places)), F.lit(0))).first()[0]
    return F.broadcast(small) if items <= SENT_ITEMS else small


def _lines(df: DataFrame, text_col: str) -> DataFrame:
    """A row for every line: document (id, mark), blanks, pos, line in lower case."""
    text = F.col(text_col)
    docs = df.select(ID, MARK, F.lower(text).alias("text"), _blanks(text).alias("blanks"))
    return docs.select(ID, MARK, "blanks", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


TOP = 4095  # greatest size and place a posting can hold; filters let larger sets pass


def _postings(classes: DataFrame) -> DataFrame:
    """One row per class and prefix key: ``at`` packs 40 bits of the key, the
    size of the set and the place of the key in it, 12 bits each."""
    p, key = F.col("p"), F.col("key")
    packed = F.shiftleft(key, 24).bitwiseOR(
        F.shiftleft(F.least("n", F.lit(TOP)).cast("long"), 12).bitwiseOR(F.least(p, F.lit(TOP)).cast("long"))
    )
    rows = classes.select("cid", "n", "bits", F.posexplode("prefix").alias("p", "key"))
    return rows.select(packed.alias("at"), "bits", "cid")


def _same_key(a: str, b: str) -> Column:
    return F.shiftrightunsigned(F.col(f"{a}.at"), 24) == F.shiftrightunsigned(F.col(f"{b}.at"), 24)


def _may_match(a: str, b: str, t: Fraction) -> Column:
    """Length, positional and parity filter on two postings of the same key."""
    n, d = t.numerator, t.denominator
    size = {x: F.shiftrightunsigned(F.col(f"{x}.at"), 12).bitwiseAND(F.lit(TOP)) for x in (a, b)}
    place = {x: F.col(f"{x}.at").bitwiseAND(F.lit(TOP)) for x in (a, b)}
    both = size[a] + size[b]
    # the least overlap is n / (n + d) of both sizes, rounded up; no division is needed
    after = F.least(size[a] - place[a], size[b] - place[b])
    apart = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    fits = (
        (size[a] * d >= size[b] * n)
        & (size[b] * d >= size[a] * n)
        & (after * (n + d) >= both * n)
        & ((both - apart) * (n + d) >= both * (2 * n))
    )
    return (size[a] == TOP) | (size[b] == TOP) | fits


def _sketch(keys: Column) -> list[Column]:
    """256 more parity bits, from other bits of the hashes: two of them choose
    one of four words, six a bit of it."""

    def bit(k: Column) -> Column:
        place = F.shiftrightunsigned(k, 13).bitwiseAND(63).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    def word(i: int) -> Column:
        mine = F.filter(keys, lambda k: F.shiftrightunsigned(k, 19).bitwiseAND(3) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(bit(k)))

    return [word(i).alias(f"w{i}") for i in range(4)]


def _sketches_match(a: str, b: str, t: Fraction) -> Column:
    """The differing bits of all words bound the symmetric difference of two
    similar sets: a word in one set only changes one bit."""
    n, d = t.numerator, t.denominator
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    apart = F.lit(0)
    for i in range(4):
        apart = apart + F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}")))
    return (both - apart) * (n + d) >= both * (2 * n)


def _matched(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Later classes of the (later, earlier) ``pairs`` that are similar.  Only
    the sets of few pairs are shuffled."""
    pairs = util.cut(pairs.distinct(), "line-pairs")
    if 2 * pairs.count() <= SENT_ITEMS:
        named = pairs.select(F.explode(F.array("later", "earlier")).alias("seq")).distinct()
        sets = sets.join(F.broadcast(named), "seq", "left_semi")
    a = sets.select(F.col("seq").alias("later"), F.col("keys").alias("ka"))
    b = sets.select(F.col("seq").alias("earlier"), F.col("keys").alias("kb"))
    both = pairs.join(a, "later").join(b, "earlier")
    shared = F.size(F.array_intersect("ka", "kb"))
    union = F.size("ka") + F.size("kb") - shared
    return both.filter(shared * t.denominator >= union * t.numerator).select("later").distinct()


def _mark(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(1), text).alias("m2"))


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ID, MARK and COPY: whether a row without id repeats the text
    of another one.  Only rows without id are written and numbered; the first
    of each text is joined by its row number, so copies never meet in a task."""
    docs = df.withColumns({ID: F.col(id_col).cast("long"), MARK: _mark(F.col(text_col)), COPY: F.lit(False)})
    unnamed = docs.filter(F.col(ID).isNull())
    if unnamed.isEmpty():
        return docs
    unnamed = util.cut(unnamed.withColumn("__line_row", F.monotonically_increasing_id()), "line-unnamed")
    firsts = unnamed.groupBy(MARK).agg(F.min("__line_row").alias("__line_first")).select("__line_first")
    unnamed = unnamed.join(firsts, F.col("__line_row") == F.col("__line_first"), "left")
    unnamed = unnamed.withColumn(COPY, F.col("__line_first").isNull()).select(*docs.columns)
    return docs.filter(F.col(ID).isNotNull()).unionByName(util.cut(unnamed, "line-unnamed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``df`` with the lines removed from ``text_col``, and the counts
    ``lines_in`` and ``lines_out``."""
    util.require(df, id_col, text_col)
    t = Fraction(threshold).limit_denominator(1000)
    n, d = t.numerator, t.denominator
    docs = _named(df, id_col, text_col)
    ranks = _ranks(rarity_table(df, text_col))

    # classes of equal sets
    lines = _lines(docs.filter(~F.col(COPY)), text_col)
    lines = lines.select(ID, MARK, "pos", _keys(_hashes(F.col("line"), F.col("blanks")), ranks).alias("keys"))
    lines = lines.withColumn("n", F.size("keys"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    parity = F.aggregate("keys", F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(bit(k)))
    prefix = F.slice("keys", 1, F.greatest(F.lit(0), F.col("n") - F.expr(f"({n} * n + {d - 1}) div {d}").cast("int") + 1))
    classes = (
        lines.select(
            F.xxhash64("keys").alias("k1"),
            F.xxhash64(F.lit(1), "keys").alias("k2"),
            F.struct(F.col(ID).alias("id"), F.col(MARK).alias("mark"), "pos").alias("e"),
            F.struct("n", parity.alias("bits"), F.transform(prefix, lambda k: F.shiftrightunsigned(k, 23)).alias("prefix")).alias("s"),
        )
        .groupBy("k1", "k2")
        .agg(F.min("e").alias("e"), F.first("s").alias("s"))
        .select("e", "s.*", F.monotonically_increasing_id().alias("cid"))
        .filter("n > 0")
    )
    classes = util.cut(classes, "line-classes")

    # postings that meet a possible match
    posts = _postings(classes)
    live = posts.alias("a").join(
        posts.alias("b"), _same_key("a", "b") & (F.col("a.cid") != F.col("b.cid")) & _may_match("a", "b", t), "left_semi"
    )
    live = util.cut(live, "line-live")
    named = classes.select("cid", "e").join(live.select("cid").distinct(), "cid", "left_semi")
    # numbers that grow with the order of the first lines; written, so they stay
    named = util.cut(named.orderBy("e").select("cid", "e", F.monotonically_increasing_id().alias("seq")), "line-named")

    # whole sets of the classes left
    where = named.select("seq", F.col("e.id").alias("id"), F.col("e.mark").alias("mark"), F.col("e.pos").alias("pos"))
    wanted = util.cut(where.groupBy("id", "mark").agg(F.collect_list(F.struct("pos", "seq")).alias("at")), "line-wanted")
    held = docs.filter(~F.col(COPY)).select(ID, MARK, F.col(text_col).alias("__line_text"))
    held = held.join(checked(wanted, "at"), F.col("id").eqNullSafe(F.col(ID)) & (F.col("mark") == F.col(MARK)))
    held = held.withColumn("lines", F.split("__line_text", "\n", -1)).select("lines", F.explode("at").alias("x"))
    held = held.select(F.col("x.seq").alias("seq"), F.element_at("lines", F.col("x.pos") + 1).alias("line"))
    sets = held.select("seq", _hashes(F.lower("line"), _blanks(F.col("line"))).alias("keys"))
    sets = sets.select("seq", "keys", F.size("keys").alias("size"), *_sketch(F.col("keys")))
    sets = util.cut(sets, "line-sets")

    numbers = named.select("cid", "seq")
    facts = sets.drop("keys").join(numbers, "seq")
    posts = util.cut(live.join(facts, "cid").drop("cid"), "line-posts")

    # each class against the first ones of its lists, then the rest against all earlier ones
    first = Window.partitionBy(F.shiftrightunsigned("at", 24)).orderBy("seq")
    leaders = posts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= LEADERS).drop("rank")
    meet = _same_key("a", "b") & _may_match("a", "b", t) & (F.col("a.seq") > F.col("b.seq")) & _sketches_match("a", "b", t)
    pair = [F.col("a.seq").alias("later"), F.col("b.seq").alias("earlier")]
    found = util.cut(_matched(posts.alias("a").join(leaders.alias("b"), meet).select(*pair), sets, t), "line-first")
    open_ = posts.join(found, F.col("seq") == F.col("later"), "left_anti")
    rest = _matched(open_.alias("a").join(posts.alias("b"), meet).select(*pair), sets, t)
    gone = util.cut(found.union(rest).join(numbers, F.col("later") == F.col("seq")).select(F.col("cid").alias("gone")), "line-gone")

    # lines that stay, by document
    stay = classes.join(gone, F.col("cid") == F.col("gone"), "left_anti").select("e.*")
    stay = stay.groupBy(F.col("id").alias("__stay_id"), F.col("mark").alias("__stay_mark")).agg(
        F.collect_list("pos").alias("__stay")
    )
    stay = checked(util.cut(stay, "line-stay"), "__stay")
    same = F.col(ID).eqNullSafe(F.col("__stay_id")) & (F.col(MARK) == F.col("__stay_mark")) & ~F.col(COPY)
    out = docs.join(stay, same, "left")
    split = F.split(F.col(text_col), "\n", -1)
    blank = F.transform(split, lambda x, i: F.when(~x.rlike(util.NONSPACE), i))
    places = F.sort_array(F.concat(F.coalesce("__stay", F.array().cast("array<int>")), F.filter(blank, lambda i: i.isNotNull())))
    out = out.withColumn("__split", split).withColumn("__places", places)
    text = F.array_join(F.transform("__places", lambda i: F.element_at("__split", i + 1)), "\n")
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in df.columns if c not in ("lines_in", "lines_out")],
        F.coalesce(F.size("__split"), F.lit(0)).alias("lines_in"),
        F.coalesce(F.size("__places"), F.lit(0)).alias("lines_out"),
    )
