"""Functions, classes, imports and calls of a source corpus.

A file is one cell, and the listing filter bounds its size.  Statements and
their scopes are therefore found inside the row with array functions: the scan
over a corpus is one narrow stage without a shuffle, and a repository that
holds a third of all files spreads over as many tasks as its bytes need.  Only
the resolution of names across files (``operators.graph``) shuffles.

The scan is relational over lines, not a grammar.  Known limit: the object of a
chained call is written ``(...)``.  Broken code gives the symbols of its readable
lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import drop_brackets, drop_group, let, mask_literals, string_literals, strip
from tributary.schemas import PYTHON_KEYWORDS
from tributary.session import KEYS, require

# Type parameters, whose bounds may hold subscripts of subscripts.
_TYPES = r"(?:\[(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*\]\s*)?"
_DEF = rf"^\s*(?:async\s+)?def\s+(\w+)\s*{_TYPES}\("
_CLASS = rf"^\s*class\s+(\w+)\s*{_TYPES}[(:]"
_HEADER = rf"^\s*(?:(?:async\s+)?def|class)\s+\w+\s*{_TYPES}(?=[(:])"
# `match` before its subject, and a case pattern up to its guard or colon
_PATTERN = r"^\s*(?:match(?=[\s(].*:$)|case\s(?:(?!\sif\s).)*?(?=\sif\s.*:$|:$))"
_CALL = r"([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*|(?<=[)\]\"])\.\s*\w[\w.]*)\s*\("
_DOC = r'^[A-Za-z]{0,2}(?:""|\["[\s"]*\])$'
_DOC_TEXT = (
    r'(?s)^\s*([A-Za-z]{0,2}(?:""".*?(?<!\\)(?:\\\\)*"""|' r"'''.*?(?<!\\)(?:\\\\)*'''|" r'"[^\n]*?(?<!\\)(?:\\\\)*"|' r"'[^\n]*?(?<!\\)(?:\\\\)*'))"
)
# A masked string: on one line, and over several.
_LINES = r'\["\s+"\]'
_STRING = rf'""|{_LINES}'
_HEADLINE = rf"^(.*?:\s*[rRuU]?(?:{_STRING}))\s*(?:;.*)?$"
_BARE_HEADLINE = r'^\s*(?:(?:async\s+)?def|class)\s+\w+\s*(?:->[^:]*)?:\s*[rRuU]?""\s*(?:;.*)?$'

_FRAME = "indent:int,kind:string,caller:string,start:int"
_SCOPE = (
    "decorators:array<string>,caller:string,scope_kind:string,scope_start:int,"
    "ended:array<struct<start:int,end:int>>"
)


def _empty(element: str) -> Column:
    return F.expr(f"CAST(array() AS array<struct<{element}>>)")


#: Rows a fold collects before it sets them aside; appending to one long array
#: would copy it at every step.
_BLOCK = 32


def _append(acc: Column, item: Column) -> list[Column]:
    """The fields ``blocks`` and ``block`` of a fold with one more row."""
    full = F.size(acc["block"]) >= _BLOCK
    return [
        F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"),
        F.when(full, F.array(item)).otherwise(F.concat(acc["block"], F.array(item))).alias("block"),
    ]


def _collected(acc: Column) -> Column:
    return F.flatten(F.concat(acc["blocks"], F.array(acc["block"])))


def _no_rows(element: str) -> list[Column]:
    return [
        F.expr(f"CAST(array() AS array<array<{element}>>)").alias("blocks"),
        F.expr(f"CAST(array() AS array<{element}>)").alias("block"),
    ]


def _without_types(text: Column) -> Column:
    """A header without its type parameters, if they nest deeper than the patterns read."""
    name = r"(?s)^(\s*(?:(?:async\s+)?def|class)\s+\w+\s*)(\[.*)$"
    deep = text.rlike(name) & ~text.rlike(_DEF + "|" + _CLASS)
    return F.when(deep, F.concat(F.regexp_extract(text, name, 1), drop_group(F.regexp_extract(text, name, 2)))).otherwise(text)


def _calls(text: Column, line: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(text, _HEADER, ""), _PATTERN, "")
    names = F.transform(
        F.regexp_extract_all(body, F.lit(_CALL), F.lit(1)), lambda c: F.regexp_replace(c, r"\s+", "")
    )
    kept = F.filter(names, lambda c: ~c.isin(*PYTHON_KEYWORDS))

    def row(name: Column) -> Column:
        callee = F.when(F.startswith(name, F.lit(".")), F.concat(F.lit("(...)"), name)).otherwise(
            F.regexp_replace(name, r"^self\.", "")
        )
        return F.struct(line.alias("line"), callee.alias("callee"))

    return F.when(F.contains(text, F.lit("(")), F.array_distinct(F.transform(kept, row))).otherwise(
        _empty("line:int,callee:string")
    )


def _lines(masked: Column) -> Column:
    def row(text: Column, index: Column) -> Column:
        def build(t: Column) -> Column:
            opened = F.translate(t, "([{", "")
            closed = F.translate(t, ")]}", "")
            return F.struct(
                (index + 1).alias("line"),
                t.alias("text"),
                (F.length(t) - F.length(F.ltrim(F.translate(t, "\t\f", "  ")))).alias("indent"),
                (F.length(closed) - F.length(opened)).alias("delta"),
                t.rlike(_DEF + "|" + _CLASS).alias("header"),
                _calls(t, index + 1).alias("calls"),
            )

        return let(let(F.regexp_replace(text, r"\s+$", ""), _without_types), build)

    return F.transform(F.split(masked, "\n"), row)


def _openings(code: Column) -> Column:
    """Positions (from 1) of the lines that open a statement.

    Lines inside brackets or after a backslash continue one; a header inside
    open brackets ends broken code.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("joined"), *_no_rows("int"))

    def merge(acc: Column, line: Column) -> Column:
        more = ((acc["depth"] > 0) | acc["joined"]) & ~line["header"]
        blocks, block = _append(acc, acc["at"] + 1)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.greatest(F.when(more, acc["depth"]).otherwise(0) + line["delta"], F.lit(0)).alias("depth"),
            F.endswith(line["text"], F.lit("\\")).alias("joined"),
            F.when(more, acc["blocks"]).otherwise(blocks).alias("blocks"),
            F.when(more, acc["block"]).otherwise(block).alias("block"),
        )

    return F.aggregate(code, zero, merge, _collected)


def _statement(code: Column, starts: Column, first: Column, index: Column) -> Column:
    """The statement that opens at code line ``first``, joined to one text."""
    following = F.coalesce(F.try_element_at(starts, index + 2), F.size(code) + 1)
    part = F.slice(code, first, following - first)
    pieces = F.transform(part, lambda line: F.regexp_replace(F.ltrim(line["text"]), r"\\$", ""))
    return F.struct(
        F.element_at(code, first)["line"].alias("start"),
        F.element_at(code, following - 1)["line"].alias("end"),
        F.element_at(code, first)["indent"].alias("indent"),
        let(F.array_join(pieces, " "), _without_types).alias("text"),
        F.flatten(F.transform(part, lambda line: line["calls"])).alias("calls"),
    )


def _kind(text: Column) -> Column:
    return (
        F.when(text.rlike(_DEF), "def")
        .when(text.rlike(_CLASS), "class")
        .when(F.startswith(text, F.lit("@")), "decorator")
        .when(F.endswith(text, F.lit(":")), "block")
        .when(text.rlike(_DOC), "doc")
        .when(text.rlike(r"(?:^|[;:])\s*(?:import|from)\b"), "import")
        .otherwise("other")
    )


def _classified(statements: Column) -> Column:
    def row(s: Column) -> Column:
        def build(kind: Column) -> Column:
            return F.struct(
                *[s[f].alias(f) for f in ("start", "end", "indent", "text", "calls")],
                kind.alias("kind"),
                F.when(kind == "def", F.regexp_extract(s["text"], _DEF, 1))
                .when(kind == "class", F.regexp_extract(s["text"], _CLASS, 1))
                .when(kind == "decorator", F.regexp_extract(s["text"], r"^@\s*([\w.]+)", 1))
                .alias("name"),
            )

        return let(_kind(s["text"]), build)

    return F.transform(statements, row)


def _scopes(statements: Column) -> Column:
    """Scope, caller and closed blocks of each statement, in step with them.

    The fold carries the stack of open blocks.  What it collects stays small:
    texts and calls remain in the statements.
    """
    zero = F.struct(
        _empty(_FRAME).alias("stack"),
        F.lit(0).alias("last"),
        F.expr("CAST(array() AS array<string>)").alias("decorators"),
        *_no_rows(f"struct<{_SCOPE}>"),
    )

    def merge(acc: Column, s: Column) -> Column:
        is_header = s["kind"].isin("def", "class")
        opens = is_header | (s["kind"] == "block")
        stack = acc["stack"]
        inside = F.coalesce(F.try_element_at(stack, F.lit(-1))["indent"] < s["indent"], F.lit(True))
        keep = F.when(inside, stack).otherwise(F.filter(stack, lambda f: f["indent"] < s["indent"]))

        def caller(top: Column) -> Column:
            return F.when(s["kind"] == "def", s["name"]).otherwise(F.coalesce(top["caller"], F.lit("__module__")))

        def scope(top: Column) -> Column:
            closed = F.filter(stack, lambda f: (f["indent"] >= s["indent"]) & (f["kind"] != "block"))
            ended = F.transform(closed, lambda f: F.struct(f["start"].alias("start"), acc["last"].alias("end")))
            return F.struct(
                F.when(is_header, acc["decorators"]).alias("decorators"),
                caller(top).alias("caller"),
                top["kind"].alias("scope_kind"),
                top["start"].alias("scope_start"),
                F.when(inside, _empty("start:int,end:int")).otherwise(ended).alias("ended"),
            )

        top = F.try_element_at(keep, F.lit(-1))
        frame = F.struct(
            s["indent"].alias("indent"), s["kind"].alias("kind"), caller(top).alias("caller"), s["start"].alias("start")
        )
        return F.struct(
            F.when(opens, F.concat(keep, F.array(frame))).otherwise(keep).alias("stack"),
            s["end"].alias("last"),
            F.when(s["kind"] == "decorator", F.concat(acc["decorators"], F.array(s["name"])))
            .otherwise(F.expr("CAST(array() AS array<string>)"))
            .alias("decorators"),
            *_append(acc, let(top, scope)),
        )

    def finish(acc: Column) -> Column:
        tail = F.transform(
            F.filter(acc["stack"], lambda f: f["kind"] != "block"),
            lambda f: F.struct(f["start"].alias("start"), acc["last"].alias("end")),
        )
        return F.struct(_collected(acc).alias("out"), tail.alias("tail"))

    return F.aggregate(statements, zero, merge, finish)


def _docstring(raw_lines: Column, following: Column) -> Column:
    text = F.regexp_extract(
        F.array_join(F.slice(raw_lines, following["start"], following["end"] - following["start"] + 1), "\n"),
        _DOC_TEXT,
        1,
    )

    return let(text, _unquoted)


def _unquoted(raw: Column) -> Column:
    out = raw
    for quote in ("'", '"', "'''", '"""'):
        n = len(quote)
        quoted = F.startswith(raw, F.lit(quote)) & F.endswith(raw, F.lit(quote)) & (F.length(raw) >= 2 * n)
        inner = F.substr(raw, F.lit(n + 1), F.length(raw) - 2 * n)
        out = F.when(quoted, inner).otherwise(out)
    return F.nullif(strip(out), F.lit(""))


def _headline(raw_lines: Column, header: Column) -> Column:
    """The docstring that follows a header on its own line; null where there is none.

    In the masked text it is the first string behind a colon with nothing or a semicolon after it; the string
    literals before it tell which one of the raw text it is.  Dropping the brackets shows that
    the colon is the header's own.
    """
    text = header["text"]
    ahead = F.regexp_extract(text, _HEADLINE, 1)
    bare = drop_brackets(F.regexp_replace(text, _LINES, '""'))
    raw = F.array_join(F.slice(raw_lines, header["start"], header["end"] - header["start"] + 1), "\n")
    literal = F.try_element_at(string_literals(raw), F.regexp_count(ahead, F.lit(_STRING)))
    found = F.concat(F.regexp_extract(ahead, rf"([rRuU]?)(?:{_STRING})$", 1), literal)
    return F.when(text.rlike(_HEADLINE), F.when(bare.rlike(_BARE_HEADLINE), let(found, _unquoted)))


def parse_files(files: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(keys, path, statements[])``: the statements of every file with scopes.

    Blank or missing content keeps its row with no statements, so one bad file
    never fails a run.  Stage the result when several tables are derived.
    """
    require(files, [*keys, "path", "content"], "parse_files")
    kept = [*keys, "path", "_raw"]
    code = F.filter(_lines(mask_literals(F.col("content"))), lambda line: line["text"] != "")
    c = F.col
    rows = (
        files.select(
            *keys, "path", F.split("content", "\n").alias("_raw"), F.when(c("content").rlike(r"\S"), code).alias("_code")
        )
        .select(*kept, "_code", _openings(c("_code")).alias("_starts"))
        .select(*kept, F.transform("_starts", lambda at, i: _statement(c("_code"), c("_starts"), at, i)).alias("_st"))
        .select(*kept, _classified(c("_st")).alias("_st"))
        .select(*kept, "_st", _scopes(c("_st")).alias("_sc"))
    )
    ends = F.concat(F.flatten(F.transform("_sc.out", lambda e: e["ended"])), c("_sc.tail"))
    rows = rows.select(*kept, "_st", c("_sc.out").alias("_out"), ends.alias("_ended"))

    def row(block_ends: Column, s: Column, index: Column) -> Column:
        following = F.get("_st", index + 1)
        scope = F.get("_out", index)
        documented = (following["kind"] == "doc") & (F.get("_out", index + 1)["scope_start"] == s["start"])
        header = s["kind"].isin("def", "class")
        return F.struct(
            *[s[f].alias(f) for f in ("start", "end", "kind", "name", "text", "calls")],
            *[scope[f].alias(f) for f in ("decorators", "caller", "scope_kind", "scope_start")],
            F.when(header, F.element_at(block_ends, s["start"])).alias("block_end"),
            F.when(header & documented, _docstring(c("_raw"), following)).when(header, _headline(c("_raw"), s)).alias("docstring"),
        )

    # Read once per file: a map named in a column of its own would be built anew for every header.
    statements = let(F.map_from_entries("_ended"), lambda block_ends: F.transform("_st", lambda s, index: row(block_ends, s, index)))
    return rows.select(*keys, "path", statements.alias("statements"))


def _exploded(parsed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return parsed.select(*keys, "path", F.explode_outer("statements").alias("s")).filter(F.col("s").isNotNull())


def functions(parsed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every function, nested, asynchronous and method definitions included.

    A method is a definition whose nearest block is a class body; decorated
    methods count too.
    """
    s = F.col("s")
    inner = F.split_part(drop_brackets(F.regexp_replace(s["text"], _DEF, ""), "~"), F.lit(")"), F.lit(1))
    inner = F.regexp_replace(inner, r"\blambda\b[^:]*:", "~")
    names = F.transform(F.split(inner, ","), lambda p: F.regexp_extract(p, r"^\s*([A-Za-z_]\w*)", 1))
    return _exploded(parsed, keys).filter(s["kind"] == "def").select(
        *keys,
        "path",
        F.concat_ws("::", "path", s["name"]).alias("id"),
        s["name"].alias("name"),
        F.lit("function").alias("type"),
        s["start"].alias("start_line"),
        s["block_end"].alias("end_line"),
        F.filter(names, lambda n: ~n.isin("", "self", "cls")).alias("parameters"),
        F.coalesce(s["scope_kind"] == "class", F.lit(False)).alias("is_method"),
        s["decorators"].alias("decorator_names"),
        s["docstring"].alias("docstring"),
        s["scope_start"].alias("scope_start"),
    )


def classes(parsed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every class with its plain bases, direct methods and class variables.

    Methods of one class come from one file, so they are collected inside the
    row and need no shuffle.
    """
    s = F.col("s")
    inner = F.split_part(
        drop_brackets(F.regexp_extract(s["text"], rf"^class\s+\w+\s*{_TYPES}\((.*)$", 1), "~"),
        F.lit(")"),
        F.lit(1),
    )
    bases = F.filter(F.transform(F.split(inner, ","), strip), lambda b: b.rlike(r"^[A-Za-z_][\w.]*$"))
    direct = F.filter("statements", lambda m: m["scope_start"] == s["start"])
    rows = (
        parsed.select(*keys, "path", "statements", F.explode_outer("statements").alias("s"))
        .filter(s["kind"] == "class")
        .select(*keys, "path", "s", direct.alias("direct"), bases.alias("base_classes"))
    )
    return rows.select(
        *keys,
        "path",
        F.concat_ws("::", "path", s["name"]).alias("id"),
        s["name"].alias("name"),
        F.lit("class").alias("type"),
        s["start"].alias("start_line"),
        s["block_end"].alias("end_line"),
        "base_classes",
        F.transform(F.filter("direct", lambda m: m["kind"] == "def"), lambda m: m["name"]).alias("method_names"),
        F.filter(
            F.transform(F.col("direct"), lambda m: F.regexp_extract(m["text"], r"^([A-Za-z_]\w*)\s*(?::[^=]*)?=(?!=)", 1)),
            lambda v: v != "",
        ).alias("class_variables"),
        s["docstring"].alias("docstring"),
    )


def imports(parsed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Imported modules: one row per plain module or per from-statement."""
    s = F.col("s")
    pieces = F.filter(
        F.transform(F.split(s["text"], r";|:\s+(?=(?:import|from)\s)"), strip),
        lambda p: p.rlike(r"^(?:import\s|from\s*[.\w])"),
    )
    rows = (
        _exploded(parsed, keys)
        .filter(s["kind"] == "import")
        .select(*keys, "path", s["start"].alias("line"), F.posexplode_outer(pieces).alias("piece", "text"))
        .filter(F.col("text").isNotNull())
    )
    text = F.col("text")
    listed = F.regexp_replace(F.regexp_extract(text, r"\bimport\b\s*(.*)$", 1), r"[()]", " ")
    names = F.filter(
        F.transform(F.split(listed, ","), lambda n: F.regexp_extract(n, r"^\s*([\w.]+)", 1)), lambda n: n != ""
    )
    source = F.regexp_extract(text, r"^from\s*([.\w]*)\s*import\b", 1)
    plain = F.transform(
        names, lambda n: F.struct(n.alias("module"), F.array(n).alias("names"), F.lit(False).alias("is_relative"))
    )
    selected = F.array(
        F.struct(
            F.regexp_replace(source, r"^\.+", "").alias("module"),
            names.alias("names"),
            F.startswith(source, F.lit(".")).alias("is_relative"),
        )
    )
    parts = F.when(F.startswith(text, F.lit("import")), plain).otherwise(selected)
    return (
        rows.select(*keys, "path", "line", "piece", F.posexplode_outer(parts).alias("part", "i"))
        .filter((F.col("i.module") != "") | (F.size("i.names") > 0))
        .select(*keys, "path", "line", (F.col("piece") * 1000 + F.col("part")).alias("ordinal"), "i.module", "i.names", "i.is_relative")
    )


def call_sites(parsed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Calls with the innermost enclosing function, one row per line.

    Calls in a function's own header (default values) belong to the function;
    calls of its decorators belong to the block around it.
    """
    s = F.col("s")
    return (
        parsed.select(*keys, "path", F.explode_outer(
            F.array_distinct(F.flatten(F.transform("statements", lambda t: F.transform(t["calls"], lambda c: F.struct(
                c["line"].alias("line"), t["caller"].alias("caller_function"), c["callee"].alias("callee"),
            )))))
        ).alias("s"))
        .filter(s.isNotNull())
        .select(*keys, "path", s["line"].alias("line"), s["caller_function"].alias("caller_function"), s["callee"].alias("callee"))
    )
