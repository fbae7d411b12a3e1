"""Fuzzy line deduplication: MinHash bands, exact Jaccard, distributed union-find, one line kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import connected_components
from quarrylight.llm.store import Scratch, light

#: Shingles of up to SHINGLE characters of the lower-cased line, one from each character that isn't white space: the
#: sets whose similarity decides.
SHINGLE = 8
SHINGLES = rf"(?s)(?=(\S.{{0,{SHINGLE - 1}}}))"
#: The signature of a long line takes those that start at CHOSEN characters, or at any that isn't a letter or digit of
#: ASCII. The choice depends on the character alone, so what is put in or taken out moves no other shingle.
CHOSEN = "aio0369"
SAMPLED = rf"(?s)(?=([{CHOSEN}\x21-\x2F\x3A-\x60\x7B-\x7E\x{{80}}-\x{{10FFFF}}].{{0,{SHINGLE - 1}}}))"
#: Lines of up to WHOLE characters, or with few such starts, have all their shingles in a signature; those from PART on
#: have the chosen ones in another. Between the two, and between FEWEST and MOST starts, lines have both signatures, as
#: lines on both sides can be similar.
WHOLE, PART, FEWEST, MOST = 80, 52, 8, 20
#: The hashes of a line lie on a circle; a band is the run of WIDE that follow one of BANDS even starts. Runs of
#: WIDE agree with the fourth power of the similarity, so lines at the threshold of 0.8 meet in one of the ten
#: with a probability of 0.992 to 0.998, by simulation. Lines of up to SHORT shingles have runs of FEW as well: at
#: the threshold, those meet with 0.98 (five shingles) to 0.999.
BANDS, WIDE, SHORT, FEW = 10, 4, 16, 3
#: Starts are even numbers and hashes are made odd.
STARTS = [(((2 * b + 1) << 64) // (2 * BANDS) & ~1) - (1 << 63) for b in range(BANDS)]
#: Groups of up to so many lines are compared pair by pair, where not yet linked.
PAIRWISE = 16
#: Larger groups of a band, up to so many lines, are compared by sketches of SKETCH words of 64 bits.
GROUP, SKETCH = 2048, 16
#: Larger groups that share a band or a rare shingle are cut into blocks of about so many lines; a task's cell is two blocks.
BLOCK = 256


def shingle_hashes(line: Column, form: str = SHINGLES) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(line), F.lit(form), F.lit(1)), lambda s: F.xxhash64(s).bitwiseOR(F.lit(1)))


def shingle_set(line: Column) -> Column:
    """The distinct shingles as 32-bit hashes: half the size on disk, and of the few hundred of a line hardly two share one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(line), F.lit(SHINGLES), F.lit(1)), lambda s: F.hash(s)))


def _blank(line: Column) -> Column:
    """Whether nothing but white space is in the line; only what leads it is read."""
    return F.ltrim(line, F.lit(" \t\x0b\f\r")) == ""


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, pos, line) for each line that isn't blank; ``row`` hashes id and text."""
    # the hash comes before the lines, else it would be taken once for each of them
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.split(F.col(text_col), "\n").alias("lines"))
    cut = rows.select("id", "row", F.posexplode("lines").alias("pos", "line"))
    return cut.where(~_blank(F.col("line")))


def _banded(lines: DataFrame) -> DataFrame:
    """(id, row, pos, lh, bands): the line's hash and the band values of its one or two signatures."""
    none, size = F.array().cast("array<bigint>"), F.length("line")
    sampled = F.when(size >= PART, F.array_distinct(shingle_hashes(F.col("line"), SAMPLED))).otherwise(none)
    read = lines.select("id", "row", "pos", "line", F.xxhash64("line").alias("lh"), sampled.alias("part"))
    whole = F.when((size <= WHOLE) | (F.size("part") <= MOST), F.array_distinct(shingle_hashes(F.col("line")))).otherwise(none)
    part = F.when(F.size("part") >= FEWEST, F.col("part")).otherwise(none)
    hashed = read.select("id", "row", "pos", "lh", *[F.sort_array(h).alias(f"h{k}") for k, h in enumerate((whole, part))])
    # sorted in among the hashes, a start shows how many of them come before it
    starts = F.array(*[F.lit(s) for s in STARTS])
    rings = [c for k in (0, 1) for c in (F.concat(f"h{k}", F.slice(f"h{k}", 1, WIDE)).alias(f"circle{k}"), F.sort_array(F.concat(f"h{k}", starts)).alias(f"among{k}"))]
    # one pass finds the starts: searching for each in a lambda would take an exception, and a slice a copy of the circle
    turn = lambda x: F.shiftright((F.shiftright(x, 32) + (1 << 31)) * BANDS, 32)
    places = lambda k: F.filter(F.transform(f"among{k}", lambda x, at: F.when(x.bitwiseAND(F.lit(1)) == 0, (at - turn(x)).cast("int"))), lambda at: at.isNotNull())
    placed = hashed.select("id", "row", "pos", "lh", "h0", "h1", *rings)
    placed = placed.select("id", "row", "pos", "lh", *[c for k in (0, 1) for c in (f"h{k}", f"circle{k}", F.when(F.size(f"h{k}") > 0, places(k)).alias(f"at{k}"))])

    def runs(k: int, wide: int) -> Column:
        return F.transform(f"at{k}", lambda at, b: F.xxhash64(F.lit(k), b, F.lit(wide), *[F.get(f"circle{k}", at + n) for n in range(wide)]))

    bands = []
    for k in (0, 1):
        bands += [F.when(F.size(f"h{k}") > 0, runs(k, WIDE)).otherwise(none), F.when(F.size(f"h{k}").between(1, SHORT), runs(k, FEW)).otherwise(none)]
    return placed.select("id", "row", "pos", "lh", F.concat(*bands).alias("bands"))


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines' shingle sets are as similar as asked."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = sets.select(F.col("lh").alias("a"), F.col("s").alias("sa")), sets.select(F.col("lh").alias("b"), F.col("s").alias("sb"))
    near = F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb")) - 1e-9
    # bound by a lambda: named twice, what is common would be found twice
    alike = F.exists(F.array(F.size(F.array_intersect("sa", "sb"))), lambda common: common >= similarity * (F.size("sa") + F.size("sb") - common))
    return pairs.join(one, "a").join(two, "b").where(near).where(alike).select("a", "b")


def _apart(placed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of (key, lh, root), the rows of keys that hold several roots, with n, the key's rows, and its greatest line."""
    keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("lh").alias("last"), F.max_by("root", "lh").alias("last_root"))
    keys = scratch.save(keys.where("low <> high").select("key", "n", "last", "last_root"), "keys")
    return scratch.save(placed.join(F.broadcast(keys) if light(keys, 32) else keys, "key"), name)


def _pairwise(few: DataFrame, fits: Column | None = None) -> DataFrame:
    """Pairs across the components of small groups, of those that fit."""
    met = few.alias("x").join(few.alias("y"), "key").where("x.root < y.root")
    return (met if fits is None else met.where(fits)).select(F.col("x.lh").alias("a"), F.col("y.lh").alias("b"))


def _in_cells(rows: DataFrame, fits: Column) -> DataFrame:
    """Pairs across the components of groups of any size, of those that fit; each meets in one cell."""
    block = F.pmod(F.xxhash64("lh"), F.col("blocks"))
    cut = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = cut.withColumn("other", other).select(*rows.columns, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    once = F.expr("x.root < y.root and (x.block <> y.block or x.low = x.high)")
    met = cells.alias("x").join(cells.alias("y"), ["key", "low", "high"]).where(once & fits)
    return met.select(F.col("x.lh").alias("a"), F.col("y.lh").alias("b"))


def _prefix_length(similarity: float) -> Column:
    return F.col("size") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1


def _prefixes(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(lh, root, size, by): the rarest shingles of each line of ``sets`` (lh, root, s), as many as the prefix filter needs.

    Shingles of few lines come first, then the common ones by their count. Only the common ones are
    joined, so lines stay whole on one task.
    """
    tokens = sets.repartition("lh").select("lh", "root", F.size("s").alias("size"), F.explode("s").alias("key"))
    common = scratch.save(tokens.groupBy("key").agg(F.count("*").alias("seen")).where(F.col("seen") > PAIRWISE), "common")
    few = F.broadcast(common) if light(common, 16) else common
    ranked = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key")
    rare = tokens.join(few, "key", "left").groupBy("lh", "root", "size").agg(F.sort_array(F.collect_list(ranked)).alias("by"))
    return rare.select("lh", "root", "size", F.slice(F.col("by.key"), F.lit(1), _prefix_length(similarity)).alias("by"))


def _keyed(prefixes: DataFrame) -> DataFrame:
    """(key, pos, size, by, lh, root): each line under its rarest shingles.

    The prefix filter: two sets as similar as asked share one of the |s| - ceil(similarity * |s|) + 1
    first shingles of either, in whatever order all sets keep.
    """
    return prefixes.select("lh", "root", "size", "by", F.posexplode("by").alias("pos", "key")).select("key", "pos", "size", "by", "lh", "root")


def _may_be_similar(similarity: float) -> Column:
    """Whether the key is the first shingle that x and y share, and they can share enough beyond it.

    A common shingle is in both prefixes, or behind the one that ends first: beyond the prefixes'
    common ones, no more can be common than either has left. The cheap test by position comes first.
    """
    asked = (F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - 1e-9
    placed = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos")) >= asked
    left = F.greatest(F.col("x.size") - F.size("x.by"), F.col("y.size") - F.size("y.by"))
    # bound by a lambda: named twice, what is shared would be found twice
    shared = F.array(F.array_intersect("x.by", "y.by"))
    return placed & F.exists(shared, lambda by: (F.size(by) + left >= asked) & (F.get(by, F.lit(0)) == F.col("x.key")))


def _sketches(sets: DataFrame) -> DataFrame:
    """(lh, size, w0, w1, ...): the shingles of each line of ``sets`` (lh, s) as bits, and their number."""
    tokens = sets.select("lh", F.explode("s").alias("t"))
    bit = F.expr("shiftleft(1L, t & 63)")
    words = [F.bit_or(F.when(F.shiftright("t", 6).bitwiseAND(F.lit(SKETCH - 1)) == k, bit).otherwise(0)).alias(f"w{k}") for k in range(SKETCH)]
    return tokens.groupBy("lh").agg(F.count("*").alias("size"), *words)


def _may_share_enough(similarity: float) -> Column:
    """Whether the sketches of x and y leave it open that they are similar: each bit that differs is a shingle of one only."""
    apart = sum(F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(SKETCH))
    both = F.col("x.size") + F.col("y.size")
    near = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    return near & (both - apart >= 2 * similarity / (1 + similarity) * both - 1e-9)


def _exact_pairs(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) across the components of ``sets`` (lh, root, s): every similar pair is among them."""
    prefixes = scratch.save(_prefixes(sets, similarity, scratch), "prefixes")
    rare, fits = _apart(_keyed(prefixes), scratch, "rare"), _may_be_similar(similarity)
    return _pairwise(rare.where(F.col("n") <= PAIRWISE), fits).unionByName(_in_cells(rare.where(F.col("n") > PAIRWISE), fits))


def line_classes(docs: DataFrame, occurrences: DataFrame, id_col: str, text_col: str, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The lines without their bands (id, row, pos, lh), and (lh, root) for those that have a near copy of other text.

    In each band's groups, every line is compared with the group's least hash. Where a group's lines
    are in different components after that, a small group's lines are compared across components
    pair by pair, those of a large one with its greatest hash. The lines of large groups that are
    still apart are compared pair by pair by sketches that rule out only what can't be similar. The
    lines of groups beyond GROUP are grouped anew by their rarest shingles, of which similar lines
    must share one; a pair is made only under the first shingle it shares. Large groups are compared
    in cells of bounded size, so no such pair is left out and no task holds a whole group.
    """
    banded = occurrences.select("lh", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min("lh").alias("rep"), F.max("lh").alias("last"))
    groups = scratch.save(groups.where("rep <> last").select("band", "rep"), "groups")
    met = banded.join(F.broadcast(groups) if light(groups, 24) else groups, "band")
    members = scratch.save(met.select("band", "rep", "lh").distinct(), "members")
    # the bands are most of that table, and no longer needed
    places = scratch.save(occurrences.select("id", "row", "pos", "lh"), "places")
    scratch.free("lines")
    nodes = scratch.save(members.select("lh").distinct(), "nodes")
    lines = lines_of(docs, id_col, text_col).select(F.xxhash64("line").alias("lh"), "line")
    texts = lines.join(F.broadcast(nodes) if light(nodes, 16) else nodes, "lh", "left_semi").groupBy("lh").agg(F.first("line").alias("line"))
    sets = scratch.save(texts.select("lh", shingle_set(F.col("line")).alias("s")), "sets")
    scratch.free("groups", "nodes")

    def grown(links: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame, bool]:
        """All links, the components they make, and whether ``pairs`` gave a new one."""
        new = scratch.save(_verified(sets, pairs, similarity), name)
        if new.isEmpty():
            return links, roots, False
        links = links.unionByName(new) if links is not None else new
        return links, scratch.save(connected_components(links), "roots").select(F.col("node").alias("lh"), "root"), True

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "lh", "left").select("key", "lh", F.coalesce("root", "lh").alias("root"))

    roots = members.where(F.lit(False)).select("lh", F.col("lh").alias("root"))
    links, roots, _ = grown(None, members.select(F.col("rep").alias("a"), F.col("lh").alias("b")), "links")
    apart = _apart(placed(members.select(F.col("band").alias("key"), "lh")), scratch, "apart")
    scratch.free("members")
    if not apart.isEmpty():
        large = apart.where(F.col("n") > PAIRWISE)
        pairs = large.where("root <> last_root").select(F.col("last").alias("a"), F.col("lh").alias("b"))
        links, roots, _ = grown(links, _pairwise(apart.where(F.col("n") <= PAIRWISE)).unionByName(pairs), "more")
        large = _apart(placed(large.select("key", "lh")), scratch, "large")
        group = large.where(F.col("n") <= GROUP)
        some = scratch.save(group.select("lh").distinct(), "some")
        if not some.isEmpty():
            held = scratch.save(_sketches(sets.join(F.broadcast(some) if light(some, 16) else some, "lh", "left_semi")), "sketches")
            rows = group.select("key", "lh", "root", "n").join(F.broadcast(held) if light(held, 16 + 8 * SKETCH) else held, "lh")
            links, roots, _ = grown(links, _in_cells(rows, _may_share_enough(similarity)), "most")
        many = scratch.save(large.where(F.col("n") > GROUP).select("lh", "root").distinct(), "many")
        if not many.isEmpty():
            held = sets.join(F.broadcast(many) if light(many, 24) else many, "lh")
            links, roots, _ = grown(links, _exact_pairs(held, similarity, scratch), "last")
    scratch.free(*(name for name in list(scratch.paths) if name not in ("places", "roots")))
    return places, roots


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one line kept of each class of equal or near-equal lines.

    Adds n_lines (lines that aren't blank) and n_kept. Lines end at line feeds. Two lines are linked
    if they are equal or if their sets of shingles (see SHINGLES: eight characters from each that is
    no white space, lower-cased) have a Jaccard similarity of at least ``similarity``; classes are the
    links' components. The line of least id, then least text hash and place, stays, the others go
    from their texts; blank lines stay as they are. Distinct lines are told apart by 64-bit hashes.

    Null text stays null, with counts of zero. A text may lose all its lines and become empty. A
    null id comes before all others. Rows that repeat both id and text count as one document and
    keep the same lines. All columns of ``docs`` are kept in place, whatever their names, except
    that n_lines and n_kept are replaced. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    occurrences = scratch.save(_banded(lines_of(docs, id_col, text_col)), "lines")
    places, classes = line_classes(docs, occurrences, id_col, text_col, similarity, scratch)
    few = F.broadcast(classes) if light(classes, 16) else classes
    placed = places.join(few, "lh", "left").select("id", "row", "pos", F.coalesce("root", "lh").alias("class"))
    repeated = scratch.save(placed.groupBy("class").count().where("count > 1").select("class"), "repeated")
    copies = scratch.save(placed.join(F.broadcast(repeated) if light(repeated, 8) else repeated, "class"), "copies")
    scratch.free("places", "roots", "repeated")
    firsts = scratch.save(copies.groupBy("class").agg(F.min(F.struct("id", "row", "pos")).alias("first")), "firsts")
    dropped = copies.join(F.broadcast(firsts) if light(firsts, 48) else firsts, "class").where(~F.struct("id", "row", "pos").eqNullSafe(F.col("first"))).groupBy("row").agg(F.collect_set("pos").alias("gone"))
    dropped = scratch.save(dropped, "dropped")
    scratch.free("copies", "firsts")
    rows, places = dropped.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = F.broadcast(dropped) if light(dropped, 24 + 4 * places // max(rows, 1)) else dropped

    own = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))
    joined = packed.join(gone, "row", "left").select("d", F.split(F.col("d").getField(text_col), "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.filter("lines", lambda line, at: ~F.array_contains("gone", at))
    counted = joined.select("d", "lines", "gone", F.when(F.size("gone") == 0, F.col("d").getField(text_col)).otherwise(F.concat_ws("\n", left)).alias("new"))
    total = F.coalesce(F.size(F.filter("lines", lambda line: ~_blank(line))), F.lit(0)).cast("long")
    total = F.when(F.col("d").getField(text_col).isNull(), F.lit(0).cast("long")).otherwise(total)
    columns = [(F.col("new") if c == text_col else F.col("d").getField(c)).alias(c) for c in own]
    return counted.select(*columns, total.alias("n_lines"), (total - F.size("gone")).alias("n_kept"))
