"""Label and file-name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are read as digits, and characters that are deleted.
DIGITS_FROM, DIGITS_TO, DELETED = r"lLIi|!/\oOQDGS$BgqZz", "11111111000065589922", " -_.,~"
#: Room labels.
ROOM_LABELS = ["kitchen", "bedroom", "living room", "bathroom", "dining room", "family room", "guest room", "study", "office", "den", "lounge", "playroom", "media room", "hall", "NA"]
#: Words for vertical links and what they stand for.
TRANSITIONS = {"stairs": "stairs", "stair": "stairs", "staircase": "stairs", "elev": "elevator", "elevator": "elevator", "lift": "elevator"}
#: Floor codes.
FLOORS = {"B2": -2, "B1": -1, "GF": 0, "G": 0, "FF": 1, "SF": 2, "TF": 3, "FO": 4, "FI": 5}
FLOOR_NAMES = {-2: "B2", -1: "B1", 0: "G", 1: "FF", 2: "SF", 3: "TF", 4: "FO", 5: "FI"}
#: The text forms that the parsers accept.
MAPPING_LINE = r"^\(\s*(-?\d+)\s*,\s*([^,]+?)\s*,\s*([^)]+?)\s*\)\s*:\s*\(\s*(-?\d+)\s*,\s*([^,]+?)\s*,\s*([^)]+?)\s*\)"
BASENAME = r"\.[^.]*$"


def normalize_numeric(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM + DELETED, DIGITS_TO)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table at a time."""
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            hit = F.get(prev, j - 1) + 1
            miss = F.greatest(F.get(prev, j), F.element_at(acc, -1))
            return F.concat(acc, F.array(F.when(F.substr(b, j, F.lit(1)) == ch, hit).otherwise(miss)))

        return F.when(F.length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.lit(0)), cell)).otherwise(prev)

    chars = F.filter(F.split(a, ""), lambda c: c != "")
    return F.element_at(F.aggregate(chars, zero, row), -1)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """round(200 * LCS / (|a| + |b|)): similarity where a substitution counts as two edits."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100)).otherwise(F.bround(lcs_length(a, b) * 200.0 / total)).cast("int")


def room_label_score(text: Column) -> Column:
    """The best ratio to any room label."""
    low = F.lower(text)
    return F.greatest(*[fuzzy_ratio(low, F.lit(x.lower())) for x in ROOM_LABELS])


def accepted_label(text: Column, conf: Column, threshold: float, fuzzy: int = 75) -> Column:
    """The label that stays after validation, or null: first rule that fits wins."""
    plain = normalize_numeric(text)
    digits = lambda c: c.rlike(r"^[0-9]+$")
    return (
        F.when(conf < threshold, None)
        .when(digits(text), text)
        .when(F.lower(text).isin(*TRANSITIONS), text)
        .when(F.length(text) == 1, F.when(digits(plain), plain))
        .when(text.rlike("[0-9]") & text.rlike(r"\p{L}"), F.when(digits(plain), plain))
        .when(text.rlike(r"^\p{L}+$"), F.when(room_label_score(text) >= fuzzy, text))
    )


def label_class(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "hall", "corridor").when(low == "na", "outside").when(low.isin(*TRANSITIONS), "transition").otherwise("room")


def _mapped(word: Column, codes: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in codes.items():
        out = out.when(word == k, v)
    return out


def first_word(name: Column) -> Column:
    return F.upper(F.regexp_extract(F.regexp_replace(name, BASENAME, ""), r"^\s*(\S+)", 1))


def floor_v1(name: Column) -> Column:
    """FF, SF or TF, or the first digits of the first word, else 1."""
    w = first_word(name)
    return F.coalesce(_mapped(w, {k: FLOORS[k] for k in ("FF", "SF", "TF")}), F.expr("int(null)"), F.regexp_extract(w, r"(\d+)", 1).try_cast("int"), F.lit(1))


def floor_v2(name: Column) -> Column:
    """Any floor code, or the first word as a signed number, or the first signed number in the name, else 1."""
    w = first_word(name)
    base = F.regexp_replace(name, BASENAME, "")
    return F.coalesce(_mapped(w, FLOORS), w.try_cast("int"), F.regexp_extract(base, r"(-?\d+)", 1).try_cast("int"), F.lit(1))


def floor_name(floor: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in FLOOR_NAMES.items():
        out = out.when(floor == k, v)
    return out.otherwise(floor.cast("string"))
