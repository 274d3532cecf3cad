"""Personal data by patterns and bootstrapped contexts, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed patterns. They seed a
graph of instances and lexical patterns (the instance's shape with the word before it, and with the word
after it). Instances are the base spans, each as a whole, and in the text beside them tokens with a digit,
tokens like an e-mail address and runs of number tokens. In each round a pattern's confidence is the share
of its instances that are known, by score; patterns of CONFIDENT or more with SUPPORT known instances score
the others, which count as known from ACCEPTED on. Instances found so are further spans of their kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import row_key
from ledgerloom.session import stored

KINDS = ("email", "ip", "card", "phone")
CONFIDENT = 0.8
SUPPORT = 5
ACCEPTED = 0.9
ROUNDS = 3
#: Matches folded together.
RUN = 256

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, with possessive quantifiers and run-start checks that keep them linear. A
#: local part starts where a run does or where the last match ended; shorter starts can't do better.
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<!\S)(?:[^\s0-9]*+[0-9]\S*+|[^\s0-9@]++@[^\s0-9@]++(?!\S))"
#: Two or more number tokens with a blank between them; a sentence mark ends the run.
_NUMBERS = r"(?<!\S)[^\s\p{L}0-9]*+[0-9][0-9().-]*+(?:\x20[(]*+[0-9][0-9().-]*+(?![^\s,;:!?\x22'\]}>]))++[^\s\p{L}0-9]*+"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_BESIDE = "array<struct<start:int,rank:int,end:int,kind:string,value:string,left:string,right:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where nested functions read it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(values: Column) -> Column:
    """An array cut into arrays of RUN elements, so that a fold's growing state stays short."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))


def _located(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, and the gaps beside them.

    Array of (start, end, value, before, after). The text between matches comes from splitting at the same
    pattern; lengths add up to places, first inside runs of matches, then over the runs.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shape = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))
    no_run = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out"))

    def placed(start: Column, end: Column, s: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.char_length(pair["before"])
        end = start + F.char_length(pair["value"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(placed(start, end, pair))).alias("out"))

    def add_run(done: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: placed(done["at"] + s["start"], done["at"] + s["end"], s))
        return F.struct((done["at"] + run["at"]).alias("at"), F.concat(done["out"], F.array(moved)).alias("out"))

    def zipped(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return _bound(gaps, lambda g: F.arrays_zip(found.alias("value"), F.slice(g, F.lit(1), F.size(found)).alias("before"), F.slice(g, F.lit(2), F.size(found)).alias("after")))

    def located(pairs: Column) -> Column:
        inside = F.transform(_runs(pairs), lambda run: F.aggregate(run, empty, add))
        return F.flatten(F.aggregate(inside, no_run, add_run, lambda done: done["out"]))

    return _bound(_bound(values, zipped), located)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(digits.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start, then kind: array of (start, rank, end, kind, value, left, right).

    `left` and `right` are the words beside a span; what touches it is no word.
    """

    def of(rank: int, kind: str) -> Column:
        def named(s: Column) -> Column:
            parts = {"start": s["start"], "rank": F.lit(rank), "end": s["end"], "kind": F.lit(kind), "value": s["value"]}
            parts["left"] = F.lower(F.regexp_extract(s["before"], r"(?<!\S)(\S++)\s++\S*+$", 1))
            parts["right"] = F.lower(F.regexp_extract(s["after"], r"^\S*+\s++(\S++)", 1))
            return F.struct(*[c.alias(n) for n, c in parts.items()])

        valid = F.filter(_located(text, _PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        hint = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        return F.when(hint, F.transform(valid, named)).otherwise(F.array().cast(_BESIDE))

    return F.array_sort(F.concat(*[of(r, k) for r, k in enumerate(KINDS)]))


def _plain(spans: Column) -> Column:
    """Spans without the words beside them."""
    return F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "rank", "end", "kind", "value")]))


def _covered(text: Column, spans: Column) -> Column:
    """The text with letters in place of its spans, so that nothing moves."""
    return masked(text, spans, lambda s: F.repeat(F.lit("x"), s["end"] - s["start"]))


def _tokens(text: Column) -> Column:
    """Tokens with a digit, tokens like an e-mail address and runs of numbers, without the punctuation
    around them, and the words beside them."""

    def one(s: Column) -> Column:
        lead = F.char_length(F.regexp_extract(s["value"], r"^[^\p{L}0-9+]*+", 0))
        core = F.regexp_replace(F.regexp_extract(s["value"], r"^[^\p{L}0-9+]*+(.*+)$", 1), r"(?<![^\p{L}0-9])[^\p{L}0-9]++$|(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")
        return F.struct(
            (s["start"] + lead).alias("start"),
            (s["start"] + lead + F.char_length(core)).alias("end"),
            core.alias("value"),
            F.lower(F.regexp_extract(s["before"], r"(?<!\S)(\S++)\s*+$", 1)).alias("left"),
            F.lower(F.regexp_extract(s["after"], r"^\s*+(\S++)", 1)).alias("right"),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    def found(pattern: str) -> Column:
        return F.filter(F.transform(_located(text, pattern), one), lambda t: t["end"] > t["start"])

    return F.when(text.rlike("[0-9@]"), F.concat(found(_TOKEN), found(_NUMBERS))).otherwise(none)


def _shape(value: Column) -> Column:
    """Digits are 9, words a; in an instance written with blanks a group of digits of any length is 9."""
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a")
    return F.when(value.contains(" "), F.regexp_replace(shape, "9+", "9")).otherwise(shape)


def _learned(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """Further instances and their kinds: inst, kind.

    `tokens`: inst, shape, left, right of every instance's places. `seeds`: inst, kind. Patterns and instances are
    hashes, and equal edges are merged before they are shuffled.
    """
    sides = F.array(
        F.when(F.col("left") != "", F.xxhash64(F.lit("before"), "left", "shape")), F.when(F.col("right") != "", F.xxhash64(F.lit("after"), "right", "shape"))
    )
    edges = tokens.select("inst", F.explode(F.array_compact(sides)).alias("pattern")).distinct()
    edges = stored(edges, "pattern-edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total")).where(F.col("total") >= SUPPORT)
    totals = stored(totals, "pattern-totals")
    known = seeds.select("inst", "kind", F.lit(1.0).alias("score"))
    new = None
    for _ in range(ROUNDS):
        hits = edges.join(known, "inst").groupBy("pattern", "kind").agg(F.sum("score").alias("hits"), F.count("*").alias("support"))
        trusted = hits.where(F.col("support") >= SUPPORT).join(totals, "pattern")
        trusted = trusted.select("pattern", "kind", F.least(F.col("hits") / F.col("total"), F.lit(0.99)).alias("confidence"))
        trusted = trusted.where(F.col("confidence") >= CONFIDENT)
        scores = edges.join(trusted, "pattern").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = scores.groupBy("inst").agg(F.max(F.struct("score", "kind")).alias("b")).select("inst", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        new = stored(best.where(F.col("score") >= ACCEPTED).join(seeds, "inst", "left_anti"), "pattern-instances")
        known = seeds.select("inst", "kind", F.lit(1.0).alias("score")).union(new)
    return new.select("inst", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, doc_id, base, spans; both arrays of (start, rank, end, kind, value), by start and kind.

    `spans` holds the base spans and those the method adds, which overlap no base span. Places count code
    points from 0, `end` is exclusive. Null and empty texts have no spans. `key` is the row_key of id and
    text, so repeated rows share it and their spans. An empty table gives no rows. Other columns are not
    read.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    beside = rows.select("key", "doc_id", "text", base_spans(text).alias("beside"))
    uncovered = F.when(F.size("beside") > 0, _covered(text, F.col("beside"))).otherwise(text).alias("text")
    parsed = beside.select("key", "doc_id", "beside", uncovered).select("key", "doc_id", "beside", _tokens(text).alias("tokens"))
    parsed = stored(parsed, "pii").withColumn("base", _plain(F.col("beside")))
    tokens = parsed.select("key", F.explode("tokens").alias("t")).select("key", "t.start", "t.end", "t.value", "t.left", "t.right")
    tokens = tokens.withColumn("inst", F.xxhash64("value"))
    values = parsed.select(F.explode("base").alias("b")).select(F.xxhash64("b.value").alias("inst"), F.col("b.rank").alias("rank"))
    ranked = F.array(*[F.lit(k) for k in KINDS])
    seeds = stored(values.groupBy("inst").agg(F.get(ranked, F.min("rank")).alias("kind")), "pii-seeds")
    spans = parsed.select(F.explode("beside").alias("b")).select(F.xxhash64("b.value").alias("inst"), "b.value", "b.left", "b.right")
    instances = tokens.select("inst", "value", "left", "right").union(spans)
    learned = _learned(instances.select("inst", _shape(F.col("value")).alias("shape"), "left", "right"), seeds)
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    more = tokens.join(learned, "inst").select("key", F.struct("start", rank.alias("rank"), "end", "kind", "value").alias("s"))
    more = more.groupBy("key").agg(F.collect_set("s").alias("more"))

    def apart(s: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def whole(s: Column) -> Column:
        """Not a piece of a longer one."""
        return ~F.exists("more", lambda m: (m["start"] <= s["start"]) & (s["end"] <= m["end"]) & (m["end"] - m["start"] > s["end"] - s["start"]))

    added = F.filter(F.coalesce(F.col("more"), F.array().cast(_SPAN)), lambda s: apart(s) & whole(s))
    return parsed.join(more, "key", "left").select("key", "doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, the hash of their list, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _bracketed(span: Column) -> Column:
    return F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))


def masked(text: Column, spans: Column, mask: Callable[[Column], Column] = _bracketed) -> Column:
    """The text with each span replaced by its mask, the kind in brackets; overlapping spans by the first one's.

    A run of spans works on its own stretch of the text, so a place is not counted from the text's start
    for each span.
    """
    shape = "array<struct<start:int,end:int,kind:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    no_run = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out"))

    def keep(done: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        more = F.struct(s["end"].alias("at"), F.concat(done["out"], F.array(one)).alias("out"))
        return F.when(s["start"] >= done["at"], more).otherwise(done)

    def keep_run(done: Column, run: Column) -> Column:
        def joined(kept: Column) -> Column:
            return F.struct(kept["at"].alias("at"), F.concat(done["out"], F.array(kept["out"])).alias("out"))

        return _bound(F.aggregate(run, F.struct(done["at"].alias("at"), F.array().cast(shape).alias("out")), keep), joined)

    def replaced(run: Column) -> Column:
        """The text from the end of the span before a run to the end of its last span, masked."""
        first = F.coalesce(run["before"], F.lit(0))
        stretch = F.substring(text, first + 1, F.element_at(run["spans"], -1)["end"] - first)

        def add(part: Column) -> Column:
            def one(done: Column, s: Column) -> Column:
                kept = F.substring(part, done["at"] + 1, s["start"] - first - done["at"])
                return F.struct((s["end"] - first).alias("at"), F.concat(done["out"], kept, mask(s)).alias("out"))

            return F.aggregate(run["spans"], begin, one, lambda done: done["out"])

        return _bound(stretch, add)

    def whole(runs: Column) -> Column:
        ends = F.transform(runs, lambda r: F.element_at(r, -1)["end"])
        before = F.concat(F.array(F.lit(0)), ends)
        pieces = F.transform(F.arrays_zip(runs.alias("spans"), F.slice(before, F.lit(1), F.size(runs)).alias("before")), replaced)
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(before, -1) + 1, F.char_length(text)))

    runs = F.aggregate(_runs(spans), no_run, keep_run, lambda done: done["out"])
    return _bound(F.filter(runs, lambda r: F.size(r) > 0), whole)


def without_pii(docs: DataFrame) -> DataFrame:
    """All rows of `docs` with the spans in their texts masked; n_chars follows. Null texts stay null."""
    spans = find(docs).where(F.size("spans") > 0).select(F.col("key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__key"])
    joined = docs.withColumn("__key", row_key("doc_id", "text")).join(spans, "__key", "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__spans")))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(docs.columns)
