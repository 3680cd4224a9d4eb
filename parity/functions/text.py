"""Text expressions: keys, splitting, quoting, escapes, SQL text features, literals."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What reads the clock in a dialect and the literal that stands for it, in order of replacement.
CLOCKS = {
    "mysql": [
        (["CURDATE()", "CURDATE( )", "CURRENT_DATE()", "CURRENT_DATE( )", "CURRENT_DATE"], "DATE '2000-01-02'"),
        (["CURRENT_TIMESTAMP()", "CURRENT_TIMESTAMP( )", "CURRENT_TIMESTAMP", "NOW()", "NOW( )"], "TIMESTAMP '2000-01-02 00:30:26'"),
        (["CURTIME()", "CURRENT_TIME()", "CURRENT_TIME", "CURTIME( )", "CURRENT_TIME( )"], "CAST('00:30:21' AS TIME)"),
        (["SYSDATE()", "SYSDATE( )"], "CAST('2000-01-02 00:30:21' AS DATETIME)"),
        (["UTC_DATE()", "UTC_DATE( )"], "DATE '2000-01-01'"),
        (["UTC_TIME()", "UTC_TIME( )"], "CAST('16:30:21' AS TIME)"),
        (["UTC_TIMESTAMP()", "UTC_TIMESTAMP( )"], "TIMESTAMP '2000-01-01 16:30:21'"),
    ],
    "pg": [
        (["CURRENT_DATE"], "DATE '2000-01-01'"),
        (["CURRENT_TIMESTAMP", "NOW()"], "TIMESTAMPTZ '2000-01-01 16:30:21+0'"),
        (["LOCALTIMESTAMP"], "TIMESTAMP '2000-01-01 16:30:21'"),
    ],
    "oracle": [
        (["CURRENT_DATE"], "DATE '2000-01-01'"),
        (["CURRENT_TIMESTAMP"], "TIMESTAMP '2000-01-01 16:30:21 +08:00'"),
        (["LOCALTIMESTAMP"], "TIMESTAMP '2000-01-01 16:30:21'"),
        (["SYSDATE"], "DATE '2000-01-01'"),
        (["SYSTIMESTAMP"], "TIMESTAMP '2000-01-01 16:30:21.126789 +08:00'"),
    ],
}


def canon_key(col: Column) -> Column:
    """Without white space, lower case."""
    return F.lower(F.regexp_replace(col, r"\s+", ""))


def squash_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def quote_aware_split(col: Column, sep: str = ",") -> Column:
    """Pieces between ``sep`` outside quotes; a backslash escapes, a quote without its end runs to the end of the text, empty
    pieces are left out."""
    s = re.escape(sep)
    piece = rf"""(?s)((?:[^{s}'"\\]|\\(?:.|$)|'(?:[^'\\]|\\(?:.|$))*(?:'|$)|"(?:[^"\\]|\\(?:.|$))*(?:"|$))+)"""
    return F.regexp_extract_all(col, F.lit(piece), F.lit(1))


def before_paren(col: Column) -> Column:
    return F.trim(F.substring_index(col, "(", 1))


def _arguments(text: str | None) -> list[str] | None:
    if text is None or "(" not in text:
        return None
    depth, quote, out, piece, escaped = 0, "", [], [], False
    for ch in text[text.index("(") + 1 :]:
        if escaped or quote:
            piece.append(ch)
            quote = "" if quote == ch and not escaped else quote
            escaped = ch == "\\" and not escaped
        elif ch == ")" and not depth:
            break
        elif ch == "," and not depth:
            out.append("".join(piece).strip())
            piece = []
        else:
            depth += (ch == "(") - (ch == ")")
            quote = ch if ch in "'\"`" else ""
            escaped = ch == "\\"
            piece.append(ch)
    last = "".join(piece).strip()
    return out + [last] if last or out else out


def call_arguments(col: Column) -> Column:
    """Top-level arguments of ``f(a, g(b, c), 'x)y')``; null without a call.  Nesting has no built-in form: an Arrow helper."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(_arguments)

    return split(col)


def freeze_now(col: Column, dialect: str) -> Column:
    """Clock functions become fixed literals, in list order, upper and lower case."""
    for names, value in CLOCKS.get(dialect, []):
        for name in names:
            for form in (name, name.lower()):
                col = F.replace(col, F.lit(form), F.lit(value))
    return col


TOKEN = r"([A-Za-z_][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|<>|<=|>=|!=|\|\||::|[^\sA-Za-z0-9_])"
LITERAL = r"('(?:[^']|'')*')"


def strip_literals(col: Column) -> Column:
    return F.regexp_replace(col, LITERAL, "''")


def token_count(col: Column) -> Column:
    """Tokens of SQL text: each word inside a string literal and every other token count one (an approximation of a lexer)."""
    inside = F.array_join(F.regexp_extract_all(col, F.lit(LITERAL), F.lit(1)), " ")
    return F.regexp_count(inside, F.lit(r"[^\s']+")) + F.regexp_count(F.regexp_replace(col, LITERAL, " "), F.lit(TOKEN))


def clause_features(col: Column) -> dict[str, Column]:
    """Clauses on literal-stripped text: has_where, has_group_by, has_having, has_order_by, n_select, n_join, n_from."""
    plain = F.upper(strip_literals(col))
    has = {"has_where": r"\bWHERE\b", "has_group_by": r"\bGROUP\s+BY\b", "has_having": r"\bHAVING\b", "has_order_by": r"\bORDER\s+BY\b"}
    count = {"n_select": r"\bSELECT\b", "n_join": r"\bJOIN\b", "n_from": r"\bFROM\b"}
    return {k: plain.rlike(p) for k, p in has.items()} | {k: F.regexp_count(plain, F.lit(p)) for k, p in count.items()}


QUOTES = {"mysql": ("`", "`"), "pg": ('"', '"'), "oracle": ('"', '"'), "snowflake": ('"', '"'), "sqlserver": ("[", "]")}


def quote_ident(col: Column, dialect: str, reserved: Sequence[str] = ()) -> Column:
    """Quoted if reserved or holding a space or hyphen."""
    a, b = QUOTES[dialect]
    odd = F.upper(col).isin(*[w.upper() for w in reserved]) | col.rlike("[ -]") if reserved else col.rlike("[ -]")
    return F.when(odd, F.concat(F.lit(a), col, F.lit(b))).otherwise(col)


def strip_ident(col: Column) -> Column:
    return F.regexp_replace(F.trim(col), r'^[`"\[]|[`"\]]$', "")


def requote_ident(col: Column, dialect: str) -> Column:
    """Lower case without quotes, quoted again unless alphanumeric."""
    a, b = QUOTES[dialect]
    bare = F.lower(strip_ident(col))
    return F.when(bare.rlike("^[a-z0-9_]+$"), bare).otherwise(F.concat(F.lit(a), bare, F.lit(b)))


def fence_json(col: Column, schema: str) -> Column:
    """The JSON object of a markdown fence (or of the bare text), parsed; bad text gives null."""
    inner = F.regexp_extract(col, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(col, r"(?s)(\{.*\})", 1)
    found = F.when(inner != "", inner).when(bare != "", bare)
    return F.from_json(F.when(F.try_parse_json(found).isNotNull(), found), schema)


#: Backslash escapes and their characters; the backslash itself goes through a mark of its own.
ESCAPES = [("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\0", "\0"), ("\\'", "'"), ('\\"', '"'), ("\\%", "%"), ("\\_", "_")]


def unescape(col: Column) -> Column:
    mark = ""
    out = F.replace(col, F.lit("\\\\"), F.lit(mark))
    for form, char in ESCAPES:
        out = F.replace(out, F.lit(form), F.lit(char))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def qstring(col: Column) -> Column:
    """Q-quoted text (``Q'!it's!'``) as an ordinary literal with doubled quotes; other text gives null."""
    body = F.regexp_extract(col, r"(?s)^[nN]?[qQ]'(?:\[(.*)\]|\{(.*)\}|\((.*)\)|<(.*)>|(\S)(.*)\5)'$", 0)
    inner = F.substring(col, F.instr(col, "'") + 2, F.length(col) - F.instr(col, "'") - 3)
    return F.when(body != "", F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("''")), F.lit("'")))


def trim_set(col: Column, text: str, side: str = "both") -> Column:
    """Trims a repeated string (not a set of characters) off the start, the end or both."""
    t = f"(?:{re.escape(text)})+"
    if side in ("both", "leading"):
        col = F.regexp_replace(col, f"^{t}", "")
    return F.regexp_replace(col, f"{t}$", "") if side in ("both", "trailing") else col


def concat_dialect(a: Column, b: Column, mode: str) -> Column:
    """``pipes`` passes null on; ``concat`` takes a null left side for empty and puts a space between."""
    return F.concat(a, b) if mode == "pipes" else F.concat(F.coalesce(a, F.lit("")), F.lit(" "), b)


def render_literal(col: Column, kind: str, dialect: str, longest: int | None = None) -> Column:
    """A typed value as literal text of a dialect; null as NULL.  longest: bytes from which a string literal is given up and rendered
    as NULL too, for a dialect that takes no longer ones (4000 in some); by default every text is whole."""
    text = col.cast("string")
    if kind in ("INT", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "YEAR"):
        out = text
    elif kind == "BOOL":
        yes, no = ("1", "0") if dialect in ("oracle", "sqlserver") else ("TRUE", "FALSE")
        out = F.when(col, yes).otherwise(no)
    elif kind == "DATE":
        day = F.date_format(col, "yyyy-MM-dd")
        out = F.concat(F.lit("CONVERT(DATE, '"), day, F.lit("', 23)")) if dialect == "sqlserver" else F.concat(F.lit("DATE '"), day, F.lit("'"))
    elif kind in ("TIMESTAMP", "DATETIME"):
        at = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        form = {"oracle": ("TO_TIMESTAMP('", "', 'YYYY-MM-DD HH24:MI:SS')"), "pg": ("'", "'::timestamp"), "mysql": ("TIMESTAMP('", "')"), "sqlserver": ("CONVERT(DATETIME2, '", "', 120)"), "snowflake": ("TIMESTAMP '", "'")}[dialect]
        out = F.concat(F.lit(form[0]), at, F.lit(form[1]))
    elif kind == "UUID":
        out = F.concat(F.lit("'"), text, F.lit("'::uuid" if dialect == "pg" else "'"))
    elif kind in ("JSON", "JSONB", "ARRAY"):
        end = {"pg": "'::json" if kind != "ARRAY" else "'::jsonb"}.get(dialect, "'")
        json = F.to_json(col) if kind == "ARRAY" else text
        out = F.concat(F.lit("'"), F.replace(json, F.lit("'"), F.lit("''")), F.lit(end))
    else:
        long = F.octet_length(text) > longest if longest is not None else F.lit(False)
        clean = F.replace(text, F.lit("\\"), F.lit("\\\\")) if dialect == "mysql" else text
        out = F.when(~long, F.concat(F.lit("'"), F.replace(clean, F.lit("'"), F.lit("''")), F.lit("'")))
    return F.coalesce(F.when(col.isNotNull(), out), F.lit("NULL"))
