"""Column functions over source text: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# String literals, comments, and the runs between them.  The lazy runs and the
# look-behind keep the matcher iterative, so a long literal cannot exhaust the
# stack.
_TOKEN = (
    r'(?s)""".*?(?:(?<!\\)(?:\\\\)*"""|\z)'
    r"|'''.*?(?:(?<!\\)(?:\\\\)*'''|\z)"
    r'|"[^\n]*?(?<!\\)(?:\\\\)*"'
    r"|'[^\n]*?(?<!\\)(?:\\\\)*'"
    r"|#[^\n]*"
    r"|[\"']"
    r"|[^\"'#]+"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _no_field() -> Column:
    return F.struct(F.lit("").alias("open"), F.lit("").alias("quote"), F.lit("").alias("last"), F.lit("").alias("out"), F.lit("").alias("done"))


def _in_field(held: Column, char: Column) -> Column:
    """One character of a formatted string.

    ``open`` holds what is open, the innermost last: ``f`` for a field's
    expression, ``b`` for a bracket in it, ``s`` for a format, which may hold
    fields again.  ``done`` is ``out`` up to the last field that was closed.
    """
    start = " % ("
    opened, out = held["open"], held["out"]
    top = F.substring(opened, -1, 1)
    less = F.substring(opened, F.lit(1), F.length(opened) - 1)
    inside = (top == "f") | (top == "b")
    quoted = held["quote"] != ""
    escape = (opened == "f") & (held["last"] == "{") & (char == "{") & F.endswith(out, F.lit(start))
    begins = ~inside & (char == "{")
    quote = inside & char.isin('"', "'")
    nested, closes = inside & char.isin("(", "[", "{"), char.isin(")", "]", "}")
    ends = (top == "f") & (char == "}")
    now_open = (
        F.when(quoted, opened).when(escape, "").when(begins, F.concat(opened, F.lit("f"))).when(nested, F.concat(opened, F.lit("b")))
        .when(ends | ((top == "b") & closes) | ((top == "s") & (char == "}")), less)
        .when((top == "f") & (char == ":"), F.concat(less, F.lit("s"))).otherwise(opened)
    )
    now_out = (
        F.when(char == "\n", F.concat(out, char)).when(quoted, out).when(escape, F.substring(out, F.lit(1), F.length(out) - len(start))).when(begins, F.concat(out, F.lit(start)))
        .when(quote, F.concat(out, F.lit('""'))).when(ends | ((top == "f") & (char == ":")), F.concat(out, F.lit(")")))
        .when(inside, F.concat(out, char)).otherwise(out)
    )
    now_quote = F.when(quoted & (char == held["quote"]), "").when(quoted, held["quote"]).when(quote & ~escape, char).otherwise("")
    # A doubled brace outside a field is text; the second one opens nothing with a third.
    last = F.when(escape, "").otherwise(char)
    return let(F.struct(now_open.alias("open"), now_quote.alias("quote"), last.alias("last"), now_out.alias("out")), lambda n: F.struct(
        n["open"].alias("open"), n["quote"].alias("quote"), n["last"].alias("last"), n["out"].alias("out"),
        F.when(n["open"] == "", n["out"]).otherwise(held["done"]).alias("done"),
    ))


def drop_group(col: Column) -> Column:
    """What follows the bracket group that a text starts with, of any depth; all of it if the group isn't closed."""

    def step(held: Column, char: Column) -> Column:
        at = held["at"] + 1
        depth = held["open"] + F.when(char.isin("(", "[", "{"), 1).when(char.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("open"), at.alias("at"), F.when((held["end"] == 0) & (depth == 0), at).otherwise(held["end"]).alias("end"))

    end = F.aggregate(F.split(col, ""), F.struct(F.lit(0).alias("open"), F.lit(0).alias("at"), F.lit(0).alias("end")), step, lambda held: held["end"])
    return F.substring(col, end + 1, F.length(col))


def mask_literals(content: Column) -> Column:
    """Blank strings and comments, keeping the line structure.

    One-line strings become ``""``, formatted ones with the expressions that
    they hold behind it, each in parentheses.  A string over several lines
    becomes a bracketed pair over the same lines, so its lines count as
    continuation lines whatever they hold; the expressions of a formatted one stay on
    the lines where they are.
    """

    def fields(token: Column) -> Column:
        breaks = lambda text: F.length(F.regexp_replace(text, r"[^\n]+", ""))
        held = F.aggregate(F.split(token, ""), _no_field(), _in_field, lambda held: held["done"])
        # A field that is not closed is left out; its lines are not.
        return let(held, lambda out: F.concat(out, F.repeat(F.lit("\n"), breaks(token) - breaks(out))))

    def blank(tokens: Column, token: Column, at: Column) -> Column:
        first = F.substring(token, 1, 1)
        formatted = (at > 0) & F.get(tokens, at - 1).rlike(r"(?i)(?<!\w)(?:f|rf|fr)$")
        return (
            F.when(first == "#", F.lit(""))
            .when(
                first.isin('"', "'"),
                F.when(
                    F.contains(token, F.lit("\n")),
                    F.concat(
                        F.lit('["'),
                        F.when(formatted & F.contains(token, F.lit("{")), fields(token)).otherwise(F.regexp_replace(token, r"[^\n]+", "")),
                        F.lit('"]'),
                    ),
                ).when(formatted & F.contains(token, F.lit("{")), F.concat(F.lit('""'), fields(token))).otherwise(F.lit('""')),
            )
            .otherwise(token)
        )

    # Each literal looks at the token before it, so the content is cut into tokens once, not once per literal.
    return let(
        F.regexp_extract_all(content, F.lit(_TOKEN), F.lit(0)),
        lambda tokens: F.array_join(F.transform(tokens, lambda token, at: blank(tokens, token, at)), ""),
    )


def string_literals(source: Column) -> Column:
    """The string literals of a piece of source in order, with their quotes; a quote that is not closed is none."""
    tokens = F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: F.substring(t, 1, 1).isin('"', "'") & (F.length(t) > 1))


def drop_brackets(col: Column, mark: str = "", depth: int = 6) -> Column:
    """Replace balanced bracket groups by ``mark``.

    A few passes from the innermost on settle nearly every text; where groups
    nest deeper than ``depth``, a running count of open brackets does.
    """
    group = r"[(\[{][^()\[\]{}]*[)\]}]"
    for _ in range(depth):
        col = F.regexp_replace(col, group, mark)

    def step(held: Column, char: Column) -> Column:
        opens, closes = char.isin("(", "[", "{"), char.isin(")", "]", "}") & (held["open"] > 0)
        after = F.when(opens, held["open"] + 1).when(closes, held["open"] - 1).otherwise(held["open"])
        text = F.when(closes & (after == 0), mark).when((held["open"] > 0) | opens, "").otherwise(char)
        return F.struct(after.alias("open"), F.concat(held["out"], text).alias("out"))

    counted = F.aggregate(F.split(col, ""), F.struct(F.lit(0).alias("open"), F.lit("").alias("out")), step, lambda held: held["out"])
    return F.when(col.rlike(group), counted).otherwise(col)


def last_segment(col: Column, separator: str) -> Column:
    return F.substring_index(col, separator, -1)


def is_test_path(path: Column) -> Column:
    """Whether a file counts as a test for the debug rule."""
    return F.startswith(path, F.lit("test_")) | F.contains(path, F.lit("/test_")) | F.contains(path, F.lit("/tests/"))


def is_comment(text: Column) -> Column:
    return text.rlike(r"^\s*#")


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)
    )


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").when(rank == 0, "info")


def blast_severity(depth: Column) -> Column:
    """Severity of a blast depth; sources have depth 0."""
    return (
        F.when(depth == 0, "source")
        .when(depth == 1, "critical")
        .when(depth == 2, "high")
        .when(depth <= 4, "medium")
        .otherwise("low")
    )


def snapshot_key(repo: Column, commit_sha: Column) -> Column:
    """File name of a stored snapshot; the repository is matched without case."""
    return F.concat(repo_key(repo), F.lit("__"), F.regexp_replace(commit_sha, r"[^a-zA-Z0-9_\-]", "_"), F.lit(".json"))


def repo_key(repo: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(repo), F.lit("/"), F.lit("__")), r"[^a-z0-9_\-]", "_")


def top_directory(file: Column) -> Column:
    return F.when(F.contains(file, F.lit("/")), F.substring_index(file, "/", 1)).otherwise("__root__")


def client_of(forwarded: Column, peer: Column) -> Column:
    """Client of a request: the first forwarded address, else the peer."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    return F.when(F.length(forwarded) > 0, first).otherwise(F.coalesce(peer, F.lit("unknown")))
