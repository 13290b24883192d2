"""Secret scan in DataFrame expressions only.

Base kinds are regular expressions with a least length. The method adds strings whose Shannon
entropy is high in some sliding window: a fold over a candidate's characters keeps the counts of
the window, adding the character that enters and taking off the one that leaves, so that each step
changes two counts. Windows and thresholds go by character class, and an allow-list of harmless
strings suppresses the method's spans (never base ones).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: (kind, pattern, group whose length counts, least length), in the order of the result
BASE = (
    ("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)
#: Strings that look random and are not secret: documentation samples, alphabets, fillers, checksums with their label.
ALLOWED = r"(?i)example|sample|placeholder|dummy|changeme|your[_-]|x{6}|0123456789|abcdefghij|qwertyuiop|deadbeef|sha(1|256|384|512)[-:=]"


#: characters before a candidate that the allow-list sees
LEAD = 8


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are maximal runs of ``members`` of at least ``least`` characters with a digit and a letter."""

    name: str
    members: str
    least: int
    window: int
    bits: float


#: hexadecimal digits in upper or mixed case (lower case is a base kind), letters of one case with digits, base64 and its URL form
CLASSES = (
    CharacterClass("hexadecimal", "0-9A-Fa-f", 20, 16, 2.81),
    CharacterClass("capitals", "A-Z0-9", 20, 16, 3.11),
    CharacterClass("base64", "A-Za-z0-9+/=_-", 24, 20, 3.43),
)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fold(items: Column, state: Column, empty: Column, step, finish=None) -> Column:
    """Left fold that also gathers: ``step(state, x)`` gives (next state, array of what x adds).

    Appending to an array copies it, so n items are folded in about sqrt(n) blocks: an item copies
    its block's finds only and a block the finds before it.
    """
    def blocks(v):
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(v, k * size + 1, size))

    def one(acc, x):
        after, adds = step(acc["state"], x)
        return F.struct(after.alias("state"), F.when(F.size(adds) > 0, F.concat(acc["found"], adds)).otherwise(acc["found"]).alias("found"))

    def block(acc, items):
        return F.aggregate(items, F.struct(acc["state"].alias("state"), empty.alias("found")), one,
                           lambda i: F.struct(i["state"].alias("state"), F.concat(acc["found"], i["found"]).alias("found")))

    return _let(items, lambda v: F.aggregate(blocks(v), F.struct(state.alias("state"), empty.alias("found")), block, finish or (lambda acc: acc["found"])))


def _places(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, value, lead) of the pattern's leftmost non-overlapping matches in code points.

    The text between matches and the matches themselves alternate, so their lengths add up to the
    starts. ``lead`` is the ``LEAD`` characters before the match.
    """
    matches, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,lead:string>>")

    def step(state, x):
        start = state["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        lead = F.right(F.concat(state["tail"], x["before"]), F.lit(LEAD))
        tail = F.right(F.concat(state["tail"], x["before"], F.coalesce(x["match"], F.lit(""))), F.lit(LEAD))
        found = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), lead.alias("lead"))
        keep = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), tail.alias("tail")), F.when(keep, F.array(found)).otherwise(empty)

    places = _fold(steps, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), empty, step)
    return F.when(text.rlike(pattern if group else f"{pattern[:-1]}{{{least - 4 if pattern.startswith('AKIA') else least},}}"), places).otherwise(empty)


def _dense_window(value: Column, window: int, bits: float) -> Column:
    """(first, last): the hull of the windows of ``value`` with entropy of ``bits`` or more; nulls without one.

    H = log2(w) - sum(c log2 c) / w. The fold's state holds the counts of the ASCII characters, packed
    several to a long, and the sum in units of 2^-40, so that it stays exact over any length.
    """
    width = window.bit_length()
    each = 63 // width
    weights = F.array(*(F.lit(round(c * math.log2(c) * 2**40) if c else 0) for c in range(window + 1)))
    most = math.floor((math.log2(window) - bits) * window * 2**40)
    codes = F.transform(F.split(value, ""), F.ascii)
    shift = lambda c: F.pmod(c, F.lit(each)) * width
    held = lambda n, c: F.call_function("shiftright", F.get(n, F.floor(c / each).cast("int")), shift(c)).bitwiseAND((1 << width) - 1).cast("int")
    unit = lambda c, k: F.when(F.floor(c / each) == k, F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))).otherwise(F.lit(0).cast("long"))
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), -(-128 // each)).alias("n"), F.lit(0).cast("long").alias("sum"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc, x):
        # the character that leaves is taken off before the one that enters is counted
        counts = F.transform(acc["n"], lambda n, k: n + unit(x["c"], k) - unit(x["out"], k))
        was = held(acc["n"], x["out"])
        now = held(acc["n"], x["c"]) - F.when(x["out"] == x["c"], 1).otherwise(0)
        lost = F.when(x["out"].isNotNull(), F.get(weights, was) - F.get(weights, was - 1)).otherwise(F.lit(0).cast("long"))
        total = acc["sum"] - lost + F.get(weights, now + 1) - F.get(weights, now)
        i = acc["i"] + 1
        dense = (i >= window) & (total <= most)
        return F.struct(i.alias("i"), counts.alias("n"), total.alias("sum"),
                        F.coalesce(acc["first"], F.when(dense, i - window)).alias("first"), F.when(dense, i).otherwise(acc["last"]).alias("last"))

    def hull(all_codes):
        gone = F.concat(F.array_repeat(F.lit(None).cast("int"), window), F.slice(all_codes, 1, F.greatest(F.size(all_codes) - window, F.lit(0))))
        pairs = F.zip_with(all_codes, gone, lambda c, out: F.struct(c.alias("c"), out.alias("out")))
        return F.aggregate(F.filter(pairs, lambda x: x["c"].isNotNull()), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(codes, hull)


def _entropy_places(text: Column, cls: CharacterClass, allowed: str) -> Column:
    candidates = F.filter(_places(text, f"[{cls.members}]+", 0, cls.least), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    harmful = F.filter(candidates, lambda s: ~F.concat(s["lead"], s["value"]).rlike(allowed))
    dense = F.transform(harmful, lambda s: F.struct(s["start"].alias("at"), _dense_window(s["value"], cls.window, cls.bits).alias("d")))
    held = F.filter(dense, lambda x: x["d"]["first"].isNotNull())
    return F.transform(held, lambda x: F.struct((x["at"] + x["d"]["first"]).alias("start"), (x["at"] + x["d"]["last"]).alias("end")))


def _apart(dense: Column, base: Column) -> Column:
    """The spans of ``dense`` that touch no span of ``base`` and stand in no other one of ``dense``; equal ones once.

    Both kinds are walked together from the left, the longer of two with one start first: a span
    touches a base span before it if one reaches past its start, and stands in an earlier span that
    reaches its end. A walk from the right finds the base spans that start inside.
    """
    none = F.array().cast("array<struct<start:int,rest:int,dense:boolean>>")
    far = F.lit(2**31 - 1)
    named = lambda a, is_dense: F.transform(a, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rest"), F.lit(is_dense).alias("dense")))
    both = F.array_sort(F.concat(named(base, False), named(dense, True)))

    def right(acc, x):
        end = -x["rest"]
        clear = x["dense"] & (acc["base"] <= x["start"]) & (acc["dense"] < end)
        after = F.struct(F.when(x["dense"], acc["base"]).otherwise(F.greatest(acc["base"], end)).alias("base"),
                         F.when(x["dense"], F.greatest(acc["dense"], end)).otherwise(acc["dense"]).alias("dense"))
        return after, F.when(~x["dense"] | clear, F.array(x)).otherwise(none)

    def left(next_base, x):
        after = F.when(x["dense"], next_base).otherwise(x["start"])
        return after, F.when(x["dense"] & (next_base >= -x["rest"]), F.array(x)).otherwise(none)

    zero = F.struct(F.lit(0).alias("base"), F.lit(0).alias("dense"))
    kept = _fold(F.reverse(_fold(both, zero, none, right)), far, none, left)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (-x["rest"]).alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allowed: str = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, places; one row per row of ``docs``.

    ``places`` is an array of (start, rank, kind, end) in code points, sorted, end exclusive;
    ``spans`` joins them as kind:start:end, and base_sha256 hashes the same text of the base kinds.
    The method's kind is ``entropy``; its spans that touch a base span are left out, as are those
    inside another one. Null reads as empty: no spans, the hash of the empty text. A null id stays
    null. Other columns are not read.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = [k for k, *_ in BASE]
    found = _scanned(rows, classes, allowed)
    out = found.select("row.doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), "places")
    return out.select(*out.columns[:-1], _joined(F.col("places")).alias("spans"), "places")


def _scanned(rows: DataFrame, classes, allowed: str) -> DataFrame:
    """(row, text) -> row, text, the base kinds' places, base, places."""
    text, kinds = F.col("text"), [k for k, *_ in BASE]
    found = rows.select("row", "text", *(_places(text, p, g, n).alias(k) for k, p, g, n in BASE))
    spans = lambda a, kind, rank: F.transform(a, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    candidate = "|".join(f"[{c.members}]{{{c.least},}}" for c in classes)
    more = F.when(text.rlike(candidate), F.concat(*(_entropy_places(text, c, allowed) for c in classes)))
    found = found.select("row", "text", *kinds, F.coalesce(more, F.array().cast("array<struct<start:int,end:int>>")).alias("dense"),
                         F.concat(*(spans(F.col(k), k, i) for i, k in enumerate(kinds))).alias("base"))
    apart = F.when(F.size("dense") > 0, _apart(F.col("dense"), F.col("base"))).otherwise(F.col("dense"))
    return found.select("row", "text", *kinds, "base", F.array_sort(F.concat("base", spans(apart, "entropy", len(kinds)))).alias("places"))


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", classes=CLASSES, allowed: str = ALLOWED) -> DataFrame:
    """``docs`` with every secret in ``text_col`` masked and ``length_col`` (if there is one) counted anew; null texts stay null."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _scanned(rows, classes, allowed)
    clean = found.select("row", F.when(F.size("places") > 0, masked(F.col("text"), F.col("places"))).alias("clean"))
    types = dict(docs.dtypes)
    new = {text_col: F.coalesce("clean", F.col("row")[text_col])}
    if length_col in docs.columns:
        new[length_col] = F.coalesce(F.length("clean").cast(types[length_col]), F.col("row")[length_col])
    return clean.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def masked(text: Column, places: Column, mark: str = "[secret]") -> Column:
    """The text with each place (overlapping ones together) replaced by ``mark``; unchanged without places."""
    strings = F.array().cast("array<string>")
    blocks = _let(places, lambda v: _let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda size: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(v, k * size + 1, size))))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        between = acc["part"].substr(acc["at"] - acc["from"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["from"].alias("from"), acc["part"].alias("part"),
                        F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    def block(acc, held):
        # a block's part of the text is cut out once, so that a place walks through that part only
        reach = F.greatest(acc["at"], F.array_max(F.transform(held, lambda s: s["end"])))
        part = F.struct(acc["at"].alias("at"), acc["at"].alias("from"), text.substr(acc["at"] + 1, reach - acc["at"]).alias("part"), F.lit("").alias("out"))
        return F.aggregate(held, part, step, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text)))
    start = F.struct(F.lit(0).alias("at"), strings.alias("out"))
    return F.when(F.size(places) > 0, F.aggregate(blocks, start, block, rest)).otherwise(text)
