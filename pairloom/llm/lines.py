"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Equal lines are folded by two 64-bit hashes first; the
earliest stands for all. Of the others a word's rarity is the number of words in its
hash cell, of 2**20 cells: a table of constant size, whatever the corpus. Any order
gives the same result; rarity only makes lists short, and a word alone in its cell is
known to be in no other line. In order of rarity a line of n words shares one of its
first n - ceil(t n) + 1 with every line of similarity t, so each line is put into the
lists of these words. Two lines of a list are a candidate pair if their lengths, the
places of the word and the parity bitmaps of their sets allow the overlap (each of
the bitmaps' differing bits is a word that only one line has). The candidates' whole
sets, of 64-bit word hashes, decide.

A line far down a long list that fits one of a few lines before it is compared with
those only, so a group of thousands of near copies costs a few pairs a line; where the sets
then say no, the line meets the whole list in a second round. Lists of words in cells
of more than LIST words are dealt out by a salt and meet across salts there as well.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import discard, join_groups, row_count, small_side, stored, whole_text

CELLS = 1 << 20
WORDS = r"[\x20\x09-\x0D]+"
#: Blanks that are rare in texts; lines without them are cut at spaces alone, which is cheaper.
RARE_BLANKS = ("\t", "\x0b", "\x0c", "\r")
#: Rows that may be broadcast (at most about 60 bytes each).
BROADCAST_ROWS = 200_000
#: Words of a cell from which its lists are salted, if that is over the mean cell's fourfold.
LIST = 4096
#: Lines of a list that are compared with all before them whatever these are like.
HEAD = 32
LEAST_ID = -(1 << 63)
LINE = ["doc", "h", "line_no"]


def words(line) -> Column:
    """The words of a line, among them empty ones."""
    c = F.col(line)
    rare = c.contains(RARE_BLANKS[0])
    for b in RARE_BLANKS[1:]:
        rare = rare | c.contains(b)
    return F.when(rare, F.split(c, WORDS)).otherwise(F.split(c, " "))


def kept_lines(docs: DataFrame, gone: DataFrame | None) -> DataFrame:
    """doc, h, line_no, line of the lines that are not in gone, in time linear in a text."""
    if gone is None:
        return docs.select("doc", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    joined = docs.join(gone, ["doc", "h"], "left")
    left = F.expr("array_except(sequence(0, size(lines) - 1), coalesce(gone, cast(array() as array<int>)))")
    rows = joined.withColumn("lines", F.split("text", "\n")).withColumn("left", left)
    return rows.select("doc", "h", F.expr("inline(transform(left, i -> struct(i as line_no, lines[i] as line)))"))


def rarity_levels(lines: DataFrame) -> tuple[DataFrame, int]:
    """A row with an array: of every hash cell four times the log2 of the words in it; and
    the number of all words. The counts are summed before the shuffle."""
    spark = lines.sparkSession
    found = lines.select(F.explode(words("line")).alias("w")).filter("w <> ''")
    cells = found.select((F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1))).alias("cell"), F.lit(1).cast("long").alias("n"))
    every = spark.range(CELLS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("n"))
    counts = cells.unionByName(every).groupBy("cell").agg(F.sum("n").alias("n"))
    level = F.when(F.col("n") > 0, F.floor(4 * F.log2(F.greatest("n", F.lit(1))))).otherwise(0).cast("tinyint")
    blocks = counts.groupBy(F.shiftright("cell", 10).alias("block")).agg(F.array_sort(F.collect_list(F.struct("cell", level.alias("level")))).alias("cells"), F.sum("n").alias("n"))
    whole = blocks.select("n", F.struct("block", F.expr("transform(cells, c -> c.level)").alias("levels")).alias("b")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("b")).alias("blocks"))
    table = stored(whole.select("n", F.expr("flatten(transform(blocks, b -> b.levels))").alias("levels")), "word-levels")
    return table.select("levels"), table.select("n").first().n or 0


def hashes(line) -> Column:
    """The distinct words of a line as 64-bit hashes."""
    return F.array_distinct(F.transform(F.array_remove(words(line), ""), lambda w: F.xxhash64(w)))


def prefixes(lines: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """doc, h, line_no, n, sig, skip, prefix: of each line's first words in order of rarity
    those that may be in another line, after `skip` that are in none. There is no filter on
    what is computed here: it would be pushed down and all of it be computed twice. The
    hashes are used once, so that they and the table of levels stay in one projection: as a
    column between two, the table would be copied to each row."""
    rows = lines.select("doc", "h", "line_no", hashes("line").alias("hs")).withColumn("levels", levels.scalar())
    code = f"shiftleft(cast(levels[cast(x & {CELLS - 1} as int)] as bigint), 56) | shiftrightunsigned(x, 8)"
    rows = rows.selectExpr(*LINE, f"sort_array(transform(hs, x -> {code})) as codes")
    sig = "aggregate(codes, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"
    rows = rows.selectExpr(*LINE, "size(codes) as n", f"{sig} as sig", f"slice(codes, 1, cast(size(codes) - ({percent}L * size(codes) + 99) div 100 + 1 as int)) as first")
    rows = rows.selectExpr(*LINE, "n", "sig", "size(first) as words", f"filter(first, c -> c >= {1 << 56}) as prefix")
    return rows.selectExpr(*LINE, "n", "sig", "words - size(prefix) as skip", "prefix")


def postings(found: DataFrame, total: int) -> DataFrame:
    """code, salt, doc, h, line_no, n, at, sig: a row for each word of each prefix, at the
    word's place in order of rarity; salts, from 1 on, deal out the lists of hot words."""
    salted_from = int(4 * log2(max(LIST, 4 * total // CELLS))) + 1
    rows = found.filter("n is not null and sig is not null")
    posts = rows.select("doc", "h", "line_no", "n", "sig", "skip", F.posexplode("prefix").alias("k", "code")).filter("code is not null")
    salts = F.expr(f"shiftleft(1L, cast((shiftright(code, 56) - {salted_from}) div 4 + 1 as int))")
    salt = F.when(F.shiftright("code", 56) >= salted_from, 1 + F.pmod(F.xxhash64("doc", "h", "line_no"), salts))
    return posts.select("code", F.coalesce(salt, F.lit(0).cast("long")).alias("salt"), "doc", "h", "line_no", "n", (F.col("k") + F.col("skip")).alias("at"), "sig")


def before(y: str, x: str) -> str:
    return f"({y}doc < {x}doc or ({y}doc = {x}doc and ({y}h < {x}h or ({y}h = {x}h and {y}line_no < {x}line_no))))"


def may_fit(y: str, x: str, percent: int) -> str:
    """Whether what is known of two lines of a list allows the similarity."""
    least = f"(({percent}L * ({x}n + {y}n) + {99 + percent}) div {100 + percent})"
    return f"(100L * least({x}n, {y}n) >= {percent}L * greatest({x}n, {y}n) and least({x}n - {x}at, {y}n - {y}at) >= {least} and bit_count({x}sig ^ {y}sig) <= {x}n + {y}n - 2 * {least})"


PARTNER = ["y_doc", "y_h", "y_line_no"]
PAIR = ("x.doc", "x.h", "x.line_no", "y.doc as y_doc", "y.h as y_h", "y.line_no as y_line_no")


def candidates(posts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs; and, with pivots in place of y, lines far down a list that fit one of a
    few lines before them, which are their only candidates there. Both sides of the join
    read one shuffle of the postings: what the one must not be null in is asked of both."""
    own = F.struct("doc", "h", "line_no", "n", "at", "sig")
    w = Window.partitionBy("code", "salt").orderBy("doc", "h", "line_no")
    pivots = (F.first(own), F.lag(own, 1))
    ranked = posts.withColumn("rank", F.row_number().over(w)).select("*", *[p.over(w).alias(f"p{k}") for k, p in enumerate(pivots)]).filter("rank > 1")
    fits = [f"coalesce({before(f'p{k}.', '')} and {may_fit(f'p{k}.', '', percent)}, false)" for k in range(len(pivots))]
    near = ranked.withColumn("settled", F.expr(f"rank > {HEAD} and ({' or '.join(fits)})"))
    on = f"not x.settled and x.code = y.code and x.salt = y.salt and {before('y.', 'x.')} and {may_fit('y.', 'x.', percent)}"
    found = near.alias("x").join(posts.alias("y"), F.expr(on), "left").filter("x.settled or y.doc is not null")
    return found.selectExpr(*PAIR, "x.settled", "x.code", "x.salt", "x.n", "x.at", "x.sig", "filter(array(x.p0, x.p1), p -> x.settled) as pivots")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(*LINE).union(pairs.select(*PARTNER)).distinct()


def meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs p with the sets x and y of their ends, which both read one shuffle of the sets."""
    one = pairs.alias("p").join(sets.alias("x"), F.expr("p.doc = x.doc and p.h = x.h and p.line_no = x.line_no"))
    return one.join(sets.alias("y"), F.expr("p.y_doc = y.doc and p.y_h = y.h and p.y_line_no = y.line_no"))


def verified(docs: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """doc, h, line_no of the lines that have a similar partner among pairs, by their whole
    sets. As each pair carries a set from one end to the other, pairs meet with the distinct
    upper 16 bits of the hashes first: two lines share at most as many words as of these,
    and as the words that fall together in either line. Of the pairs left a line's first
    one decides, and the others only where that one is not similar."""
    pairs = stored(pairs.distinct(), f"{name}-pairs")
    wanted = stored(ends(pairs).groupBy("doc", "h").agg(F.sort_array(F.collect_list("line_no")).alias("some")), f"{name}-wanted")
    rows = docs.join(small_side(wanted, row_count(wanted), BROADCAST_ROWS), ["doc", "h"])
    lines = rows.withColumn("lines", F.split("text", "\n")).select("doc", "h", F.expr("inline(transform(some, i -> struct(i as line_no, lines[i] as line)))"))
    short = "array_distinct(transform(hs, x -> cast(shiftrightunsigned(x, 48) - 32768 as smallint)))"
    sets = lines.select(*LINE, hashes("line").alias("hs")).selectExpr(*LINE, "hs", "size(hs) as n", f"{short} as short")
    sets = stored(sets, f"{name}-sets").filter("doc is not null and h is not null and line_no is not null")

    most = "(size(array_intersect(x.short, y.short)) + least(x.n - size(x.short), y.n - size(y.short)))"
    likely = meet(pairs, sets.select(*LINE, "n", "short")).filter(f"{100 + percent}L * {most} >= {percent}L * (x.n + y.n)").select("p.*")
    likely = stored(likely.withColumn("turn", F.row_number().over(Window.partitionBy(*LINE).orderBy(*PARTNER))), f"{name}-likely")

    def similar(some: DataFrame, turn: str) -> DataFrame:
        of = stored(ends(some), f"{name}-{turn}-ends")
        own = sets.select(*LINE, "hs").join(small_side(of, row_count(of), BROADCAST_ROWS), LINE, "left_semi")
        found = meet(some, own).filter(f"{100 + percent}L * size(array_intersect(x.hs, y.hs)) >= {percent}L * (size(x.hs) + size(y.hs))")
        found = stored(found.selectExpr("p.doc", "p.h", "p.line_no").distinct(), f"{name}-{turn}-repeats")
        discard(of)
        return found

    found = similar(likely.filter("turn = 1"), "first")
    others = stored(likely.filter("turn > 1").join(small_side(found, row_count(found), BROADCAST_ROWS), LINE, "left_anti"), f"{name}-others")
    if row_count(others):
        found = found.unionByName(similar(others, "others"))
    discard(pairs, wanted, sets, likely, others)
    return found


def repeated_lines(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, bool]:
    """doc, h, gone: of each text the numbers of the lines to remove: those for which an
    earlier line (by doc_id, h, line_no; a null doc_id counts as the least long) has an
    equal or similar set of words, 100 x intersection >= percent x union, whether that
    line stays or not. Lines without words are never removed. Rows with equal doc_id
    and text are one document. Where doc_ids are unique (the second result), h is 0."""
    ids = docs.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    unique = not ids.take(1)
    docs = keyed(docs, unique).select("doc", "h", "text")

    # Equal lines: the first stands for all.
    lines = kept_lines(docs, None).filter(F.expr(r"line rlike '[^\\x20\\x09-\\x0D]'"))
    lines = stored(lines.select(*LINE, F.struct(F.xxhash64("line").alias("f1"), F.xxhash64(F.lit(1), "line").alias("f2")).alias("fp")), "lines")
    several = lines.groupBy("fp").agg(F.min(F.struct(*LINE)).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    several = stored(several, "equal-lines")
    marked = join_groups(lines, several, "fp", "members", row_count(lines), row_count(several) <= BROADCAST_ROWS)
    equal = stored(marked.filter(F.col("first").isNotNull() & (F.col("first") != F.struct(*LINE))).select(*LINE), "repeats")
    discard(lines, several)

    gone = stored(equal.groupBy("doc", "h").agg(F.collect_set("line_no").alias("gone")), "equal-gone")
    left = kept_lines(docs, small_side(gone, row_count(gone), BROADCAST_ROWS))
    levels, total = rarity_levels(left)
    starts = stored(prefixes(left, levels, percent), "prefixes")
    posts = postings(starts, total)
    found = stored(candidates(posts, percent), "candidates")
    discard(gone, levels)
    settled = found.filter("settled").select(*LINE, "code", "salt", "n", "at", "sig", "pivots")
    chosen = settled.select(*LINE, "n", "at", "sig", F.explode("pivots").alias("y")).filter(f"{before('y.', '')} and {may_fit('y.', '', percent)}").selectExpr(*LINE, "y.doc as y_doc", "y.h as y_h", "y.line_no as y_line_no")
    pairs = found.filter("y_doc is not null").select(*LINE, *PARTNER).unionByName(chosen)
    first = verified(docs, pairs, percent, "first")

    # Lines that were compared with a few others of their list, or of its part, only: they
    # meet the whole lists that they are in.
    left_over = settled.drop("pivots").unionByName(posts.filter("salt > 0").select(*LINE, "code", "salt", "n", "at", "sig"))
    open_ = stored(left_over.join(small_side(first, row_count(first), BROADCAST_ROWS), LINE, "left_anti").distinct(), "open")
    words_ = stored(open_.select("code").distinct(), "open-words")
    whole = posts.join(small_side(words_, row_count(words_), BROADCAST_ROWS), "code", "left_semi")
    more = open_.alias("x").join(whole.alias("y"), F.expr(f"x.code = y.code and {before('y.', 'x.')} and {may_fit('y.', 'x.', percent)}")).selectExpr(*PAIR)
    more = stored(more, "more-candidates")
    discard(open_, words_, starts)
    parts = [equal, first] + ([verified(docs, more, percent, "second")] if row_count(more) else [])
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = stored(every.groupBy("doc", "h").agg(F.collect_set("line_no").alias("gone")), "removed-lines")
    discard(*parts, found, more)
    return out, unique


def keyed(docs: DataFrame, unique: bool) -> DataFrame:
    """docs with doc and h, by which their texts are known, and whole texts."""
    h = F.lit(0).cast("long") if unique else F.xxhash64(whole_text(), F.col("doc_id").isNull())
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc"), h.alias("h"), whole_text().alias("text"))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with text rebuilt from the lines that stay, and n_lines and n_removed added.

    Every row gives one row. Null text stays null and has no lines; an empty text has
    one empty line; an empty table gives no rows. Columns named like those added are
    replaced."""
    gone, unique = repeated_lines(docs.select("doc_id", "text"), percent)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    h = F.lit(0).cast("long") if unique else F.xxhash64(whole_text(), F.col("doc_id").isNull())
    rows = docs.select(F.struct(*names).alias("own"), F.split("text", "\n").alias("lines"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc"), h.alias("h"))
    joined = rows.join(small_side(gone, row_count(gone), BROADCAST_ROWS), ["doc", "h"], "left")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    return joined.select(
        *[F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(kept).alias("text") if c == "text" else F.col("own")[c].alias(c) for c in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
