"""Line dedup by an exact set-similarity join (prefix, positional and length filters).

A line is the set of its words.  A line is removed if an earlier line, by (id, place), has the same text or a Jaccard
similarity of at least ``NUMERATOR / DENOMINATOR``.

1. Equal lines collapse first.  A narrow pass gives 128 bits per line; only lines whose bits occur twice go on to be
   grouped by their text, the rest are their own representatives.  So a line with a third of all rows costs one row.
2. Words are ordered by rarity: a sketch of 2^16 counters over all words gives each word one of 16 classes, ties go by
   hash.  Any total order is exact; rarity keeps the posting lists short.  The order is the word's 63-bit key itself,
   so a sorted set is a sorted array of longs.
3. Each representative sends its prefix (``n - ceil(t n) + 1`` rarest words).  The join on the word keeps pairs within
   the length bounds whose places leave room for enough overlap and whose parity signatures do not show too many
   differences: 128 bits, each the parity of the words that fall on it, so two sets differ in at least as many words as
   signatures in bits.
4. Candidates are verified by the whole sets, which only lines in a candidate pair send.

Membership tests that save shuffling use a bitmap of fixed size with exact handling of what it lets through; as it
fills, more rows take the exact way.  All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, drop_stored, keyed, stored, text_or_empty

#: Jaccard threshold as a fraction, so that the test is exact.
NUMERATOR, DENOMINATOR = 4, 5
SKETCH_BITS, CLASS_BITS = 16, 4
BITMAP_BITS = 23
#: Near copies of so many lines are a family, whose links are counted and not listed.
FAMILY = 64
_HASH_BITS = 63 - CLASS_BITS
#: A null id stands for a document after all others.
_LAST = (1 << 63) - 1


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, line of every line that has a word."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), text_or_empty(text_col).alias("text"))
    return base.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _bitmap(hashes: DataFrame) -> Column:
    """A set of long hashes (column h) as a one-row scalar: array of 2^BITMAP_BITS bits.  False positives only."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("b")).collect()
    bits = [0] * (1 << BITMAP_BITS - 6)
    for r in words:
        bits[r.w] = r.b
    return hashes.sparkSession.createDataFrame([(bits,)], "bits array<long>").scalar()


def _maybe(bitmap: Column, h: Column) -> Column:
    slot = F.shiftrightunsigned(h, 64 - BITMAP_BITS)
    word = F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0


def _words(text: Column) -> Column:
    """The words, and empty strings; one plain character splits faster than a pattern."""
    return F.when(text.rlike(r"[\x09-\x0D]"), F.split(text, SPACE)).otherwise(F.split(text, " "))


def rarity(docs: DataFrame, text_col: str = "text") -> Column:
    """Class of each of 2^SKETCH_BITS word buckets, 0 the rarest, as a constant array."""
    words = docs.select(F.explode(_words(F.replace(text_or_empty(text_col), F.lit("\n"), F.lit(" ")))).alias("w")).where("w != ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND((1 << SKETCH_BITS) - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # 2^16 rows
    top = max((r.n for r in counts), default=1)
    classes = [0] * (1 << SKETCH_BITS)
    for r in counts:
        classes[r.b] = min((1 << CLASS_BITS) - 1, r.n.bit_length() * ((1 << CLASS_BITS) - 1) // top.bit_length())
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<int>")  # folded once


def word_set(line: Column, classes: Column) -> Column:
    """Sorted array of the keys of the line's distinct words, rarest first."""
    hashes = F.transform(F.array_remove(_words(line), ""), lambda w: F.xxhash64(w))
    place = lambda h: F.get(classes, h.bitwiseAND((1 << SKETCH_BITS) - 1).cast("int"))
    keys = F.transform(hashes, lambda h: F.shiftleft(place(h).cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS)))
    return F.sort_array(F.array_distinct(keys))


def _parity(s: Column, half: int) -> Column:
    """64 bits: bit i is the parity of the keys whose low 7 bits are ``64 half + i``."""
    mine = F.filter(s, lambda k: F.shiftright(k, 6).bitwiseAND(1) == half)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))))


def _needed(n: Column) -> Column:
    return F.ceil(n * NUMERATOR / DENOMINATOR)


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_link: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(copies, links, sure).

    copies: id, pos of every line whose text occurs earlier.  links: (a_id, a_pos, b_id, b_pos), a before b, first
    places of two different texts whose similarity reaches the threshold; each pair once.  Without ``every_link`` the
    links are fewer: at least one for every line that has an earlier one like it, which is what removal needs.  sure, if
    there are families of near copies: id, pos, n, later of lines that have ``n`` more links in their family, which are counted
    and not listed; ``later`` if one of them is to an earlier line.
    """
    lines = _lines(docs, id_col, text_col)
    place = (F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")).cast("decimal(38,0)")
    marked = lines.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))
    twice = stored(marked.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "lines-twice")
    seen_twice = _bitmap(twice)
    drop_stored(twice)
    # Equal texts: the first place of each stays.
    again = stored(marked.where(_maybe(seen_twice, F.col("h"))).select("id", "pos", "line", "h", "h2"), "lines-again")
    first = stored(again.groupBy("h", "line").agg(F.min(place).alias("place")), "lines-first")
    copies = again.select("h", "h2", "id", "pos", place.alias("place")).join(first.select("h", F.xxhash64(F.lit(1), "line").alias("h2"), F.col("place").alias("first")), ["h", "h2"]).where("place > first").select("id", "pos")

    one = lambda c: F.floor(c / F.lit(1 << 31).cast("decimal(10,0)"))
    reps = marked.where(~_maybe(seen_twice, F.col("h"))).select("id", "pos", "line").unionByName(
        first.select(one(F.col("place")).cast("long").alias("id"), (F.col("place") - one(F.col("place")) * F.lit(1 << 31).cast("decimal(10,0)")).cast("int").alias("pos"), "line")
    )
    classes = rarity(docs, text_col)
    sets = reps.select("id", "pos", word_set(F.col("line"), classes).alias("s"))
    # Stored by line, as the prefixes are a fifth of the sets and several joins read them.
    prefixes = stored(_signed(sets).select("id", "pos_n", "p0", "p1", F.slice("s", F.lit(1), _prefix(F.size("s"))).alias("prefix")), "lines-prefixes")
    rows = _postings(prefixes)
    if every_link:
        members = _families(lines, prefixes, rows, classes)
        if members is None:
            near = rows.repartition("key")  # both sides of the join read one shuffle
            out = copies, _verified(lines, _candidates(near, near), classes), None
        else:
            inside, sure = _inside(members)
            out = copies, inside.unionByName(_verified(lines, _outside(prefixes, members), classes)), sure
        drop_stored(prefixes)
        return out
    # Most lines of a large family are like its first one.  So each line is first held against the earliest line of each
    # of its postings; only lines that this leaves open are joined with all earlier ones.
    earliest = rows.groupBy("key").agg(F.min(F.struct("id", "pos_n", "at", "p0", "p1")).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "v.*")
    settled = _verified(lines, _candidates(earliest, rows), classes)
    gone = stored(settled.select(F.col("b_id").alias("id"), F.col("b_pos").alias("pos")).distinct(), "lines-settled")
    seen = _bitmap(gone.select(F.xxhash64("id", "pos").alias("h")))
    place_of = rows.withColumn("pos", F.shiftright("pos_n", 32).cast("int"))
    maybe = _maybe(seen, F.xxhash64("id", "pos"))
    left = place_of.where(~maybe).unionByName(place_of.where(maybe).join(gone, ["id", "pos"], "left_anti")).drop("pos")
    rest = _verified(lines, _candidates(rows, left), classes)
    drop_stored(prefixes)
    drop_stored(gone)
    return copies, settled.unionByName(rest).distinct(), None


def _signed(sets: DataFrame) -> DataFrame:
    """``sets`` with pos_n (place and number of words) and the parities.

    None of them can be null: else the joins ask for rows without nulls, and that filter goes below the sets and builds them
    once more for each column.
    """
    zero = F.lit(0).cast("long")
    pos_n = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.size("s").cast("long"))
    return sets.withColumns({"pos_n": F.coalesce(pos_n, zero), "p0": F.coalesce(_parity(F.col("s"), 0), zero), "p1": F.coalesce(_parity(F.col("s"), 1), zero)})


def _prefix(n: Column) -> Column:
    return (n - _needed(n) + 1).cast("int")


def _side(rows: DataFrame, p: str, *more: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "pos_n", "at", "p0", "p1", *more)])


def _near() -> Column:
    """Length, positional and parity filters on the rows of two lines with a word in common."""
    length = lambda p: F.col(f"{p}_pos_n").bitwiseAND(F.lit((1 << 32) - 1))
    la, lb = length("a"), length("b")
    room = F.least(la - F.col("a_at"), lb - F.col("b_at"))  # words from the shared one on
    differ = F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))) + F.bit_count(F.col("a_p1").bitwiseXOR(F.col("b_p1")))
    both = NUMERATOR + DENOMINATOR
    alike, enough = (la + lb - differ) * both >= (la + lb) * (2 * NUMERATOR), room * both >= (la + lb) * NUMERATOR  # whole numbers: no quotient
    return alike & enough & (la * DENOMINATOR >= lb * NUMERATOR) & (lb * DENOMINATOR >= la * NUMERATOR)


def _before(a: str = "a", b: str = "b", pos: str = "pos_n") -> Column:
    return (F.col(f"{a}_id") < F.col(f"{b}_id")) | ((F.col(f"{a}_id") == F.col(f"{b}_id")) & (F.col(f"{a}_{pos}") < F.col(f"{b}_{pos}")))


def _place(c: str) -> Column:
    return F.shiftright(c, 32).cast("int")


def _candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of places (a before b) that share a prefix word and pass the length, positional and parity filters."""
    pairs = _side(first, "a").join(_side(second, "b"), "key").where(_before() & _near())
    return _pairs(pairs)


def _pairs(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select("a_id", _place("a_pos_n").alias("a_pos"), "b_id", _place("b_pos_n").alias("b_pos")).distinct(), "lines-pairs")


def _postings(prefixes: DataFrame, *more: str) -> DataFrame:
    """A row for each word of each prefix."""
    return prefixes.select("id", "p0", "p1", "pos_n", *more, F.posexplode("prefix").alias("at", "key"))


# Families of near copies: their links grow with the square of their size, so they are counted.
#
# With C the words of more than half of a family, D the words of C that a line lacks and E the others that it has, two lines
# are linked if and only if  w_a + w_b <= |C| + 9 (|D_a n D_b| + |E_a n E_b|),  where  w = 5 |D| + 4 |E|  (for a threshold of 4/5).
# So pairs with w_a + w_b <= |C| follow from counts by w, and others need a word that both lack or both have beside C.


def _whole(lines: DataFrame, wanted: DataFrame, classes: Column) -> DataFrame:
    """id, pos, s of the lines that ``wanted`` (id, pos) names."""
    bits = _bitmap(wanted.select(F.xxhash64("id", "pos").alias("h")))
    few = lines.where(_maybe(bits, F.xxhash64("id", "pos"))).join(wanted.select("id", "pos").distinct(), ["id", "pos"], "left_semi")
    return few.select("id", "pos", word_set(F.col("line"), classes).alias("s"))


def _families(lines: DataFrame, prefixes: DataFrame, rows: DataFrame, classes: Column, least: int | None = None) -> DataFrame | None:
    """family, c, id, pos, w, delta of the lines of families with at least ``least`` of them; None if there are none.

    Only how pairs are found depends on it, whatever lines a family has.
    """
    least = least or FAMILY
    low = F.transform("prefix", lambda k: k.bitwiseAND((1 << _HASH_BITS) - 1))
    marks = prefixes.select("id", "pos_n", F.array_min(low).alias("m0"), F.array_max(low).alias("m1"))
    often = marks.groupBy("m0", "m1").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    alike = stored(marks.join(often, ["m0", "m1"]).select("id", _place("pos_n").alias("pos"), F.struct(-F.col("m"), "m0", "m1").alias("family"), "m"), "lines-alike")
    if alike.isEmpty():
        drop_stored(alike)
        return None
    words = alike.join(_whole(lines, alike, classes), ["id", "pos"]).select("family", "m", F.explode("s").alias("k"))
    common = words.groupBy("family", "m", "k").agg(F.count(F.lit(1)).alias("n")).where("2 * n > m")
    centres = common.groupBy("family").agg(F.sort_array(F.collect_list("k")).alias("s")).groupBy("s").agg(F.min("family").alias("family"))  # at most twice a line's words
    centres = stored(centres.select("family", "s", F.size("s").alias("c")), "lines-centres")
    drop_stored(alike)
    at_centre = _signed(centres.select(F.lit(0).cast("long").alias("id"), F.lit(0).alias("pos"), "family", "s"))
    of_centre = at_centre.select("id", "p0", "p1", "pos_n", "family", F.posexplode(F.slice("s", F.lit(1), _prefix(F.size("s")))).alias("at", "key"))
    pairs = _side(rows, "a").join(_side(of_centre, "b", "family"), "key").where(_near())
    pairs = stored(pairs.select(F.col("a_id").alias("id"), _place("a_pos_n").alias("pos"), F.col("b_family").alias("family")).distinct(), "lines-near-centres")
    lacks, has = F.array_except("c_s", "s"), F.array_except("s", "c_s")
    both = pairs.join(_whole(lines, pairs, classes), ["id", "pos"]).join(centres.withColumnRenamed("s", "c_s"), "family")
    both = both.select("family", "c", "id", "pos", lacks.alias("lacks"), has.alias("has"))
    w = F.size("lacks") * DENOMINATOR + F.size("has") * NUMERATOR
    member = F.struct("family", "c", w.alias("w"), F.concat("lacks", "has").alias("delta"))
    chosen = stored(both.where(w <= F.col("c")).groupBy("id", "pos").agg(F.min(member).alias("f")).select("id", "pos", "f.*"), "lines-near")
    drop_stored(pairs)
    large = chosen.groupBy("family").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    members = stored(chosen.join(large, "family", "left_semi").select(F.xxhash64("family").alias("family"), "c", "id", "pos", "w", "delta"), "lines-members")
    drop_stored(chosen)
    drop_stored(centres)
    return None if members.isEmpty() else members


def _inside(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, sure) between lines of one family: pairs with w_a + w_b > c as links, all others counted."""
    place = F.struct("id", "pos")
    counts = members.groupBy("family", "c", "w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    # Rows of counts and, at c - w, of questions: running sums over the different w of a family.
    asked = counts.select("family", "w", (F.col("c") - F.col("w")).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(counts.schema["first"].dataType).alias("first"))
    told = counts.select("family", "w", F.col("w").alias("at"), F.lit(0).alias("kind"), "n", "first")
    upto = Window.partitionBy("family").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = told.unionByName(asked).select("family", "w", "kind", F.sum("n").over(upto).alias("upto"), F.min("first").over(upto).alias("earliest")).where("kind = 1")
    itself = (F.col("w") * 2 <= F.col("c")).cast("long")
    sure = members.join(sums.drop("kind"), ["family", "w"]).select("id", "pos", (F.col("upto") - itself).alias("n"), F.coalesce(F.col("earliest") < place, F.lit(False)).alias("later")).where("n > 0")
    zero = F.lit(0).cast("long")
    signed = members.select("family", "c", "id", "pos", "w", "delta", F.size("delta").alias("d"), *[F.coalesce(_parity(F.col("delta"), i), zero).alias(f"p{i}") for i in (0, 1)])
    each = signed.select("family", "c", "id", "pos", "w", "d", "p0", "p1", F.explode("delta").alias("k"))
    side = lambda p: each.select("family", "k", *[F.col(x).alias(f"{p}_{x}") for x in ("id", "pos", "w", "d", "p0", "p1")], *(["c"] if p == "a" else []))
    over = F.col("a_w") + F.col("b_w") - F.col("c")
    differ = F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))) + F.bit_count(F.col("a_p1").bitwiseXOR(F.col("b_p1")))
    shared = F.col("a_d") + F.col("b_d") - differ  # twice the common words, at most
    open_ = side("a").join(side("b"), ["family", "k"]).where(_before(pos="pos") & (over > 0) & (shared * (NUMERATOR + DENOMINATOR) >= over * 2))
    ends = ["a_id", "a_pos", "b_id", "b_pos"]
    links = open_.groupBy(*ends).agg(F.count(F.lit(1)).alias("n"), F.first(over).alias("over"))
    return links.where(F.col("n") * (NUMERATOR + DENOMINATOR) >= F.col("over")).select(*ends), sure


def _outside(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs but those within one family."""
    of = members.select("id", F.col("pos").alias("_pos"), "family")
    maybe = _maybe(_bitmap(of.select(F.xxhash64("id", "_pos").alias("h"))), F.xxhash64("id", "_pos"))
    placed = prefixes.withColumn("_pos", _place("pos_n"))
    plain = _postings(placed.where(~maybe).unionByName(placed.where(maybe).join(of, ["id", "_pos"], "left_anti"))).repartition("key")
    mine = _postings(placed.where(maybe).join(of, ["id", "_pos"]), "family").repartition("key")
    pair = lambda d: d.select("a_id", "a_pos_n", "b_id", "b_pos_n")
    alone = _side(plain, "a").join(_side(plain, "b"), "key").where(_before() & _near())
    mixed = _side(plain, "a").join(_side(mine, "b"), "key").where(_near())
    # Two families meet at the words that prefixes of both have.
    named = mine.select("key", "family").distinct()
    meet = named.withColumnRenamed("family", "a_family").join(named.withColumnRenamed("family", "b_family"), "key").where("a_family < b_family")
    across = _side(mine, "a", "family").join(meet, ["key", "a_family"]).join(_side(mine, "b", "family"), ["key", "b_family"]).where(_near())
    first = _before()
    ordered = [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in (("a", "b"), ("b", "a")) for c in ("id", "pos_n")]
    return _pairs(pair(alone).unionByName(pair(mixed).unionByName(pair(across)).select(*ordered)))


def _verified(lines: DataFrame, pairs: DataFrame, classes: Column) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    ends = pairs.select(F.col("a_id").alias("id"), F.col("a_pos").alias("pos")).union(pairs.select("b_id", "b_pos"))
    wanted = _bitmap(ends.select(F.xxhash64("id", "pos").alias("h")))
    # Of the lines in a candidate pair, and the few others that the bitmap lets through, the whole sets.
    whole = lines.where(_maybe(wanted, F.xxhash64("id", "pos"))).select("id", "pos", word_set(F.col("line"), classes).alias("s")).repartition("id", "pos")
    end = lambda p: whole.select(F.col("id").alias(f"{p}_id"), F.col("pos").alias(f"{p}_pos"), F.col("s").alias(f"{p}_s"))
    both = pairs.join(end("a"), ["a_id", "a_pos"]).join(end("b"), ["b_id", "b_pos"])
    shared = F.size(F.array_intersect("a_s", "b_s"))
    links = both.where(shared * (NUMERATOR + DENOMINATOR) >= (F.size("a_s") + F.size("b_s")) * NUMERATOR).select("a_id", "a_pos", "b_id", "b_pos").distinct()
    out = stored(links, "lines-links")
    drop_stored(pairs)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, every_link: bool = True) -> DataFrame:
    """One row per document: id, n_lines, n_removed, n_links and the text that stays; with ``keep``, also those columns.

    n_lines counts lines with a word; n_links the links in which a line of the document takes part, as the first place
    of its text.  Defined cases: lines without a word stay; a null text stays null and has no lines; rows that share an
    id are documents of their own, in the order of a hash of the row; null ids stand after all others; a document whose
    lines all go has the empty text; an empty table gives no rows.
    """
    docs = keyed(docs, id_col)
    copies, links, sure = similar_lines(docs, "__row", text_col, every_link)
    one = F.lit(1).cast("long").alias("n")
    found, ends = copies.union(links.select("b_id", "b_pos")), links.select(F.col("a_id").alias("id"), one).union(links.select("b_id", one))
    if sure is not None:
        found, ends = found.union(sure.where("later").select("id", "pos")), ends.union(sure.select("id", "n"))
    gone = found.groupBy("id").agg(F.collect_set("pos").alias("gone"))  # at most a document's lines
    count = ends.groupBy("id").agg(F.sum("n").alias("n"))
    about = gone.join(count, "id", "full").select(F.col("id").alias("__id"), F.col("gone").alias("__gone"), F.col("n").alias("__n"))
    all_ = docs.select(*[F.col(c) for c in dict.fromkeys([id_col, *(keep or []), text_col, "__row"])])
    joined = all_.join(about, F.col("__row") == F.col("__id"), "left")
    split = F.split(text_col, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    return joined.select(
        *[c for c in all_.columns if c not in (text_col, "__row")], F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.greatest(F.lit(0), F.coalesce(F.size("__gone"), F.lit(0))).cast("long").alias("n_removed"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), text.alias(text_col),
    )


def rewrite_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines removed and all other columns as they were."""
    shown = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(shown)}
    out = dedup_lines(docs.toDF(*at.values()), at[id_col], at[text_col], keep=list(at.values()), every_link=False)
    return out.select(*[F.col(at[c]).alias(c) for c in shown])
