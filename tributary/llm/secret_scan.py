"""Secret scans: rules, and character Markov models compared by log-likelihood ratio.

Two models of first order are trained from labelled samples, one of random strings and
one of ordinary identifiers.  A stretch of a long run of key characters is reported if
the first explains its transitions so much better than the second that the ratio's
logarithm passes a threshold.  Everything runs on built-in functions; a text is only taken apart
if a cheap test says that it may hold something.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import staged

#: Characters of keys; transitions outside them don't occur in a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
SEPARATORS = "/=_-"

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"

#: Runs shorter than this are too short to tell.
SHORTEST = 20
#: Natural logarithm of the likelihood ratio from which on a run is reported.
THRESHOLD = 12.0

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes of all earlier values, from 0 on, for each of an array of integers.

    The array is cut into as many parts as each has values.  Totals of parts are added up
    first and then the values of each part, so no list grows longer than a part.
    """

    def running(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda held, v: F.struct(add(held["at"], v).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out")),
            lambda held: held["out"],
        )

    def of(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(v), size), lambda i: F.slice(v, i, size))
        return _let(parts, lambda ps: F.flatten(F.zip_with(
            ps, running(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), add)), F.lit(0)), running
        )))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches of a pattern: their places in code points, and the text of ``group``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def placed(hit: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hit)), lambda gap: F.char_length(gap))
        sizes = F.transform(hit, lambda h: F.char_length(h))
        rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), (values if group else hit).alias("value"))
        return _let(rows, lambda rs: F.zip_with(
            rs, _before(F.transform(rs, lambda r: r["gap"] + r["size"]), lambda x, y: x + y),
            lambda r, at: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["size"]).alias("end"), r["value"].alias("value")),
        ))

    return _let(hits, placed)


def _spans(text: Column, pattern: str, kind: str, rank: int, good: Callable[[Column], Column], group: int = 0) -> Column:
    """The spans of all leftmost matches of a pattern whose ``group`` is good, in code points."""
    return F.transform(
        F.filter(_matches(text, pattern, group), lambda m: good(m["value"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")),
    ).cast(SPANS)


def _at_least(n: int) -> Callable[[Column], Column]:
    return lambda value: F.char_length(value) >= n


def base_spans(text: Column) -> Column:
    """Assignments, access keys and long hexadecimal runs, by start and then in this order."""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.when(named, _spans(text, ASSIGN, "assign", 0, _at_least(8), 2)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, "access", 1, _at_least(16))).otherwise(_none())
    # Only runs that are long enough are cut out: a match of the greedy rule is a whole run.
    whole = "(?<![0-9a-f])[0-9a-f]{32,}"
    long_hex = F.when(text.rlike("[0-9a-f]{32}"), _spans(text, whole, "hex", 2, _at_least(32))).otherwise(_none())
    return F.array_sort(F.concat(assign, access, long_hex))


def transitions(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring key characters, by label, of samples ``value, secret``."""
    chars = samples.filter("value is not null").select("secret", F.split("value", "").alias("c"))
    pairs = chars.filter(F.size("c") > 1).select("secret", F.explode(F.transform(
        F.sequence(F.lit(2), F.size("c")), lambda i: F.concat(F.element_at("c", (i - 1).cast("int")), F.element_at("c", i.cast("int")))
    )).alias("pair"))
    return pairs.filter(F.col("pair").rlike(f"^{RUN}{{2}}$")).groupBy("secret", "pair").count()


def ratios(counts: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition, by place in the alphabet, row by row.

    Only these counts come to the driver, a square of the alphabet per label.
    Transitions that neither model saw say nothing; without samples, none does.
    """
    n = len(ALPHABET)
    seen = {(int(r["secret"]), r["pair"]): r["count"] for r in counts.collect()}
    out = []
    for a in ALPHABET:
        totals = [sum(seen.get((label, a + b), 0) for b in ALPHABET) for label in (0, 1)]
        for b in ALPHABET:
            chance = [(seen.get((label, a + b), 0) + smoothing) / (totals[label] + smoothing * n) for label in (0, 1)]
            out.append(math.log(chance[1] / chance[0]))
    return out


def samples_of(docs: DataFrame, text: str = "text", most: int = 4000) -> DataFrame:
    """Labelled samples ``value, secret``: what the rules find in ``most`` documents, and the other runs of at least four key characters there.

    The documents are picked by a hash of their text, each text once, so equal tables
    give equal samples.
    """
    hashed = docs.select(F.col(text).cast("string").alias("text")).filter("text <> ''").withColumn("hash", F.xxhash64("text"))
    last = hashed.select("hash").distinct().orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    picked = staged(hashed.filter(F.col("hash") <= last).groupBy("hash").agg(F.any_value("text").alias("text")).select("text"), "sample").frame
    found = picked.select("text", base_spans(F.col("text")).alias("spans"))
    secrets = found.select(F.explode("spans").alias("s"), "text").select(
        F.explode(F.regexp_extract_all(F.expr("substring(text, s.start + 1, s.end - s.start)"), F.lit(f"({RUN}{{8,}})"), F.lit(1))).alias("value"), F.lit(1).alias("secret")
    )
    clean = redacted(found, F.lit(" "))
    others = clean.select(F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{4,}})"), F.lit(1))).alias("value"), F.lit(0).alias("secret"))
    return secrets.unionByName(others)


def _stretches(value: Column, table: list[float], threshold: float) -> Column:
    """The stretches of a run of key characters that score ``threshold`` or more: places from 0, the end exclusive.

    A sum of log-likelihood ratios runs along; a stretch goes from the separator before
    the place where the sum left 0 to the sum's peak, and is over once the sum is back at 0 or ``threshold`` below the peak.
    """
    n = len(ALPHABET)
    # One literal, folded once, instead of thousands of expressions.
    ratio = F.split(F.lit(",".join(repr(float(x)) for x in table)), ",").cast("array<double>")
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    parted = [F.lit(ALPHABET.index(c) + 1) for c in SEPARATORS]
    none = F.array().cast("array<struct<from:int,to:int>>")

    def found(held: Column) -> Column:
        return F.when(held["best"] >= threshold, F.concat(held["out"], F.array(F.struct(held["from"].alias("from"), held["to"].alias("to"))))).otherwise(held["out"])

    def moved(held: Column, at: Column, total: Column) -> Column:
        over = (total <= 0) | (held["best"] - total >= threshold)
        peak = ~over & (total > held["best"])
        segment = F.when(at.isin(*parted), held["place"] + 2).otherwise(held["segment"])
        return F.struct(
            at.alias("last"), (held["place"] + 1).alias("place"), F.when(over, 0.0).otherwise(total).alias("sum"),
            F.when(over, 0.0).when(peak, total).otherwise(held["best"]).alias("best"),
            F.when(over, held["segment"]).otherwise(held["from"]).alias("from"), segment.alias("segment"),
            F.when(peak, held["place"] + 2).otherwise(held["to"]).alias("to"),
            F.when(over, found(held)).otherwise(held["out"]).alias("out"),
        )

    def step(held: Column, at: Column) -> Column:
        # Named once: every mention would be a copy of the literal in the plan, which the driver keeps as text too.
        total = held["sum"] + F.element_at(ratio, ((held["last"] - 1) * n + at).cast("int"))
        return _let(total, lambda t: moved(held, at, t))

    return F.aggregate(
        F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
        F.struct(
            F.element_at(places, 1).alias("last"), F.lit(0).alias("place"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"),
            F.lit(0).alias("from"), F.element_at(places, 1).isin(*parted).cast("int").alias("segment"), F.lit(0).alias("to"), none.alias("out"),
        ),
        step, found,
    )


def _markov_spans(run: Column, table: list[float], shortest: int, threshold: float) -> Column:
    """The stretches inside a run, out to the separators around them, if they are long enough then."""
    value = run["value"]

    def span(s: Column) -> Column:
        after = F.char_length(F.regexp_extract(F.substring(value, s["to"] + 1, F.char_length(value)), "^[^/=_-]*=*", 0))
        return F.struct(
            (run["start"] + s["from"]).alias("start"), F.lit(3).alias("rank"), (run["start"] + s["to"] + after).alias("end"), F.lit("markov").alias("kind")
        )

    spans = F.array_distinct(F.transform(_stretches(value, table, threshold), span))
    return F.filter(spans, lambda s: s["end"] - s["start"] >= shortest).cast(SPANS)


def _rewritten(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """The text with ``instead`` of each span and what ends of earlier spans leave of it.

    ``instead`` is told the span and the furthest end before it.  The text is read in blocks,
    so a slice costs its own length and a block, wherever it is.
    """
    bits = 12

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.shiftright(start, bits)
        own = F.slice(blocks, first + 1, F.shiftright(end - 1, bits) - first + 1)
        return F.when(end > start, F.substring(F.array_join(own, ""), start - F.shiftleft(first, bits) + 1, end - start)).otherwise("")

    def of(blocks: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        length = F.char_length(text)
        parts = F.zip_with(
            spans, _before(ends, lambda x, y: F.greatest(x, y)),
            lambda s, at: F.concat(piece(blocks, at, s["start"]), instead(s, at)),
        )
        return F.array_join(F.concat(parts, F.array(piece(blocks, F.array_max(ends), length))), "")

    cut = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << bits}}}"), F.lit(0)), of)
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces where the spans are, as long as before."""
    return _rewritten(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))


def with_spans(docs: DataFrame, table: list[float], text: str = "text", into: str = "spans", shortest: int = SHORTEST, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, and an array of the secrets' spans, by start and then by kind.

    Spans are code points, the end exclusive.  Base spans always stay; the models add
    ``markov`` spans for the stretches of what the base spans leave of a run of key
    characters.  A null or empty text has none.  Equal rows get equal spans.  A column
    named ``into`` is replaced.
    """
    rest = "_rest"
    while rest in (*docs.columns, into):
        rest = f"_{rest}"
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    whole = f"(?<!{RUN}){RUN}{{{shortest},}}"
    out = docs.withColumn(into, base_spans(body))
    out = out.withColumn(rest, F.when(body.rlike(f"{RUN}{{{shortest}}}"), _blanked(body, F.col(into))).otherwise(""))
    runs = _matches(F.col(rest), whole)
    added = F.flatten(F.transform(runs, lambda r: _markov_spans(r, table, shortest, threshold)))
    added = F.when(F.col(rest) != "", added).otherwise(_none())
    return out.withColumn(into, F.array_sort(F.concat(F.col(into), added))).drop(rest)


def redacted(docs: DataFrame, mark: Column, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every run of overlapping spans of a text by ``mark``; texts without spans stay as they are."""
    cut = _rewritten(F.col(f"`{text}`"), F.col(spans), lambda s, at: F.when(s["start"] >= at, mark).otherwise(""))
    return docs.withColumn(text, cut)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
