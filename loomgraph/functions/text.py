"""Column functions on texts: trimming, folding, statement lists, previews, prompts. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters and the ASCII letters that replace them.
POLISH, ASCII = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
NO_SCHEMA, NO_HISTORY = "(empty — first pass)", "(no prior conversation)"
#: The white space of Unicode; that of ASCII.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = "\t\n\x0b\x0c\r "
#: A text between single or double quotes, where a backslash guards the next character. Possessive, so that the matcher neither recurses
#: nor goes back, however long the text.
SINGLE, DOUBLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Strips every kind of Unicode white space at both ends, not only blanks. In time linear in the text, as are the strips below: a
    pattern for a run at the end would be tried at every place of every run inside."""
    return F.btrim(_col(c), F.lit(SPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(F.length(trim_all(c)) == 0, F.lit(True))


def ascii_fold(c: Column | str) -> Column:
    """Polish letters become ASCII ones, every other character beyond ASCII goes."""
    return F.regexp_replace(F.translate(_col(c), POLISH, ASCII), r"[^\x00-\x7F]", "")


def quote_escape(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("'"), F.lit("\\'"))


def pipe_split(c: Column | str) -> Column:
    """Statements between pipes, trimmed, without blank ones; quotes don't protect a pipe."""
    return F.filter(F.transform(F.split(_col(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def pipe_join(c: Column | str) -> Column:
    return F.array_join(_col(c), "|")


def strip_pipes(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit("|"))


def preview(c: Column | str, n: int = 400) -> Column:
    """The first n characters, and an ellipsis if there are more."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def first_parts(c: Column | str, n: int = 10) -> Column:
    return F.slice(_col(c), 1, n)


def fill_prompt(template: str, **values: Column | str) -> Column:
    """Puts columns in place of {names}; doubled braces are single ones. Values go in as they are, braces and all; a null is empty, and a
    name without a value stays."""
    out, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        out.append(F.lit(template[at : m.start()]))
        out.append(F.lit(m[0][0]) if m[1] is None else F.coalesce(_col(values[m[1]]), F.lit("")) if m[1] in values else F.lit(m[0]))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def or_default(c: Column | str, default: str) -> Column:
    """The default for null and empty texts."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def guard_decision(reply: Column | str) -> Column:
    """A reply that contains generate, whatever its case, lets a question pass; any other, and none, ends it."""
    return F.when(F.contains(F.lower(trim_all(reply)), F.lit("generate")), F.lit("generate_cypher")).otherwise(F.lit("end"))


def with_limit(query: Column | str, n: int = 5) -> Column:
    """Adds a limit to query texts without one. A word in quotes isn't a limit, and a last semicolon goes, with blanks around it."""
    query = _col(query)
    bare = F.regexp_replace(query, f"(?s){SINGLE}|{DOUBLE}", "''")
    has = bare.rlike(r"(?i)\blimit\s+\d+")
    return F.when(has, query).otherwise(F.concat(F.rtrim(query, F.lit(";" + ASCII_SPACE)), F.lit(f" LIMIT {n}")))


def with_limit_by_substring(query: Column | str, n: int = 5) -> Column:
    """The plainer rule: any LIMIT in the upper-cased text counts, and only semicolons at the very end go."""
    query = _col(query)
    return F.when(F.contains(F.upper(query), F.lit("LIMIT")), query).otherwise(F.concat(F.rtrim(query, F.lit(";")), F.lit(f" LIMIT {n}")))


def iso_time(c: Column | str) -> Column:
    """A time as ISO 8601 text without a zone, with microseconds unless they are 0."""
    c = _col(c)
    micros = F.date_format(c, ".SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == ".000000", "").otherwise(micros))


def utc_now() -> Column:
    """The present time in UTC, without a zone."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
