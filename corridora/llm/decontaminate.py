"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become a template: numbers `#n`, units after a number `#u`, capitalised words inside a sentence `#w`, all else in
lower case. Windows of eight template tokens are hashed (pairs of pairs of pairs) and hash-joined with the benchmark's
windows; an item of fewer words is one window of its own length. An item's first word counts as a name too where it
looks like one, as it may stand inside a sentence of the document. A match is kept if its slots are consistent: over
all matched windows of one alignment, equal placeholders of the item stand for equal words of the document.

Windows with LITERALS literal words at least are telling. A document is a leak of an item if MIN_WINDOWS telling windows
match, or all telling windows that the item has, or all its windows, telling or not: so items that are mostly slots, or
short, are found by their whole template. Items without a window of FEW literal words have no template to speak of;
their windows are of plain lower-case words, and all of them must match.

The window lengths and kinds to look for (at most 16) come from the items, so texts are scanned for short and for plain
windows only where there are such items.

Nulls and edge cases: null and empty texts, and items without a word, match nothing; benchmark items with one text are
looked for once and reported under each of their ids; rows are judged by their own text even if a doc_id repeats, and
equal rows give one row per item; a null doc_id is carried along; a very long text is one row's work in the scan, whose
windows leave one by one; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bundled, written

WINDOW = 8  # a power of two: hashes are doubled up
LITERALS = 5
FEW = 2
MIN_WINDOWS = 3
#: Benchmark windows up to which they are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Units of measure.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "cl", "l", "gal", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "hz", "khz", "mhz", "ghz", "v", "w", "kw", "kwh", "j", "kj", "n", "pa", "bar", "k", "c", "f", "usd", "eur", "gbp", "dollars", "euros", "pounds", "cents", "percent", "meters", "metres", "kilometers", "miles", "feet", "inches", "grams", "kilograms", "liters", "litres", "degrees", "bytes", "kb", "mb", "gb", "tb"]
#: ASCII but letters, one by one (Java looks them up in one table), and the blocks of Unicode punctuation.
_NOT_LETTER = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalpha()) + "\\u00A0\\u00AB\\u00BB\\u2000-\\u206F\\u3000-\\u303F"
TOKEN = rf"""(?:[.!?]["')\]\x20\x09\x0A\x0D]*+)?(?:[0-9]+(?:[.,][0-9]+)*|[^{_NOT_LETTER}]+)"""
_LEAD = ".!?\"')] \n\t\r\f\u000b "


def tokens(text: Column) -> Column:
    """Words and numbers, each with the end of the sentence before it, if one ends there."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))


def words(toks: Column) -> Column:
    return F.transform(toks, lambda x: F.ltrim(x, F.lit(_LEAD)))


def template(toks: Column, plain: Column) -> Column:
    def one(w: Column, i: Column) -> Column:
        first, second = F.substring(w, 1, 1), F.substring(w, 2, 1)
        number = lambda c: c.between("0", "9")
        low = F.lower(w)
        name = (first != F.lower(first)) & (second != "") & (second == F.lower(second)) & ~F.substring(F.get(toks, i), 1, 1).isin(".", "!", "?")
        return (
            F.when(number(first), "#n")
            .when((i > 0) & name, "#w")
            .when(low.isin(UNITS) & (i > 0) & number(F.substring(F.get(plain, i - 1), 1, 1)), "#u")
            .otherwise(low)
        )

    return F.transform(plain, one)


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, and written once into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(toks: Column, size: int = WINDOW) -> Column:
    """The hash of each window of the tokens, by its start."""

    def joined(a: Column, b: Column, k: int) -> Column:
        rest = F.greatest(F.size(b) - k, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), rest), F.slice(b, F.lit(k + 1), rest), lambda x, y: F.xxhash64(x, y))

    def doubled(h: Column, k: int) -> Column:
        return h if k == size else let(joined(h, h, k), lambda x: doubled(x, 2 * k))

    def longer(h: Column, one: Column, k: int) -> Column:
        return h if k == size else let(joined(h, one, k), lambda x: longer(x, one, k + 1))

    hashed = F.transform(toks, lambda t: F.xxhash64(t))
    if size & (size - 1) == 0:
        return let(hashed, lambda h: doubled(h, 1))
    return let(hashed, lambda h: longer(h, h, 1))


def text_windows(text: Column, kinds: list[tuple[bool, int]] | None = None) -> Column:
    """(pos, w, kind) of all windows of the text, for each kind (plain words or template, length), in one array."""
    kinds = [(False, WINDOW)] if kinds is None else kinds

    def of(p: Column, m: Column, k: int) -> Column:
        plain, size = kinds[k]
        toks = F.transform(p, F.lower) if plain else m
        return F.transform(windows(toks, size), lambda w, i: F.struct(i.alias("pos"), w.alias("w"), F.lit(k).alias("kind")))

    return let(tokens(text), lambda t: let(words(t), lambda p: let(template(t, p), lambda m: F.concat(*[of(p, m, k) for k in range(len(kinds))]))))


def _items(bench: DataFrame) -> DataFrame:
    """(item, text, p, m, name, plain, size, starts): each distinct text with a word once, as words and template.

    name: the template's first token as a name, or null; plain: it has no window of FEW literal words; size: of its
    windows; starts: of its windows.
    """
    texts = bench.where("text IS NOT NULL").select("text").distinct().withColumn("item", F.xxhash64("text"))
    whole = let(tokens(F.col("text")), lambda t: let(words(t), lambda p: F.struct(p.alias("p"), template(t, p).alias("m"))))
    texts = texts.select("item", "text", whole.alias("s")).select("item", "text", "s.p", "s.m").where(F.size("p") > 0)
    first = F.col("p")[0]
    letter, second = F.substring(first, 1, 1), F.substring(first, 2, 1)
    name = F.when((letter != F.lower(letter)) & (second != "") & (second == F.lower(second)), "#w")
    size = F.least(F.size("m"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("m") - size)
    literal = lambda i: F.size(F.filter(F.slice("m", i + 1, size), lambda t: ~t.startswith("#")))
    plain = ~F.exists(starts, lambda i: literal(i) >= FEW)
    return texts.select("*", name.alias("name"), plain.alias("plain"), size.alias("size"), F.transform(starts, lambda i: F.struct(i.alias("ipos"), (literal(i) >= F.least(F.lit(LITERALS), size)).alias("telling"))).alias("starts"))


def _window_at(toks: Column, start: Column, size: int) -> Column:
    return F.get(windows(F.slice(toks, start + 1, F.lit(size)), size), F.lit(0))


def find_leaks(spark: SparkSession, docs: DataFrame, bench: DataFrame, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, item_windows, coverage): one row for each document and item that it leaks;
    coverage is the share of the item's windows that match."""
    items = written(spark, _items(bench), "items")
    kinds = sorted((r["plain"], r["size"]) for r in items.select("plain", "size").distinct().collect())  # 2 * WINDOW at most
    kinds = kinds or [(False, WINDOW)]
    parts = []
    for k, (plain, size) in enumerate(kinds):
        own = items.where((F.col("plain") == plain) & (F.col("size") == size)).select("*", F.explode("starts").alias("s"))
        toks = F.transform("p", F.lower) if plain else F.col("m")
        sets = [own.select("item", "s.ipos", "s.telling", F.lit(k).alias("kind"), _window_at(toks, F.col("s.ipos"), size).alias("w"))]
        if not plain:
            named = F.concat(F.array("name"), F.slice("m", 2, size - 1)) if size > 1 else F.array("name")
            sets.append(own.where("s.ipos = 0 AND name IS NOT NULL").select("item", "s.ipos", "s.telling", F.lit(k).alias("kind"), _window_at(named, F.lit(0), size).alias("w")))
        parts += sets
    places = parts[0]
    for x in parts[1:]:
        places = places.unionByName(x)
    places = written(spark, places, "windows")
    small = places.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    scan = keyed.select("doc_id", "th", F.explode(text_windows(F.col("text"), kinds)).alias("x")).select("doc_id", "th", "x.pos", "x.w", "x.kind")
    at = F.collect_set(F.struct("ipos", "telling")).alias("at")
    met = scan.join(hint(places), ["w", "kind"]).groupBy("doc_id", "th", "item", (F.col("pos") - F.col("ipos")).alias("shift")).agg(at)
    met = written(spark, met, "matches")

    hit = met.select("doc_id", "th").distinct().withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_h")
    texts = keyed.join(hit, (F.col("th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").dropDuplicates(["doc_id", "th"])
    texts = texts.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), words(tokens(F.col("text"))).alias("dp"))
    own = items.select("item", F.col("m").alias("im"), F.col("p").alias("ip"), "size")
    both = met.join(texts, (F.col("th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))).join(hint(own), "item")

    def steady(places: Column) -> Column:
        """Whether equal placeholders of the item stand for equal words of the document, in these windows."""
        inside = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["ipos"], p["ipos"] + F.col("size") - 1))))
        slots = F.filter(inside, lambda k: F.get("im", k).startswith("#"))
        pairs = F.array_distinct(F.transform(slots, lambda k: F.struct(F.concat(F.get("im", k), F.lower(F.get("ip", k))).alias("i"), F.lower(F.get("dp", k + F.col("shift"))).alias("d"))))
        return let(pairs, lambda x: F.size(x) == F.size(F.array_distinct(F.transform(x, lambda y: y["i"]))))

    # where the windows do not agree together, those that are telling may
    telling = F.filter("at", lambda p: p["telling"])
    good = both.select("doc_id", "th", "item", F.when(steady(F.col("at")), F.col("at")).when(steady(telling), telling).alias("at")).where("at IS NOT NULL")
    found = good.select("doc_id", "th", "item", F.explode("at").alias("p")).groupBy("doc_id", "th", "item").agg(F.count_distinct("p.ipos").alias("n_windows"), F.count_distinct(F.when(F.col("p.telling"), F.col("p.ipos"))).alias("_t"))
    sizes = items.select("item", "text", F.size("starts").cast("long").alias("item_windows"), F.size(F.filter("starts", lambda s: s["telling"])).alias("_of"), "plain")
    found = found.join(hint(sizes), "item")
    enough = (F.col("n_windows") == F.col("item_windows")) | (~F.col("plain") & (F.col("_of") > 0) & (F.col("_t") >= F.least(F.lit(min_windows), F.col("_of"))))
    named = bench.where("text IS NOT NULL").select("item_id", "text").distinct()
    out = found.where(enough).join(named, "text")
    return out.select("doc_id", F.col("th").alias("text_hash"), "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"))


def drop_leaks(spark: SparkSession, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with all columns."""
    bad = find_leaks(spark, docs, bench).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    rows = bundled(docs, "row")
    kept = rows.join(bad, (F.xxhash64("row.text") == F.col("_h")) & F.col("row.doc_id").eqNullSafe(F.col("_d")), "left_anti")
    return kept.select("row.*")
