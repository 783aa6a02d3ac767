"""Text cleaning and line parsing as column expressions.

Patterns use (?U), Java's Unicode classes, so that they agree with Unicode-aware
engines; \\x1c-\\x1f count as white space too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Bracket escapes of the corpus and what they stand for.
BRACKETS = (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}"))
# What a cleaned text must not hold (curly brackets aren't looked for).
ARTIFACTS = ("-LRB-", "-RRB-", "-LSB-", "-RSB-", "&amp;", "&quot;")
PROFILED = ("-LRB-", "-RRB-", "-LSB-", "-RSB-", "-LCB-", "-RCB-")
_SPACE = "(?U)[\\s\\x1c-\\x1f]+"
# the characters of _SPACE
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML character references, decoded once."""
    import html

    return text.map(html.unescape, na_action="ignore")


def materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns, each computed once for a row. Else the optimizer may move an expression into
    the lambdas that use its column, and it is computed again for each element."""
    row = F.struct(*(c.alias(k) for k, c in columns.items()))
    return df.select(F.explode(F.array(row)).alias("m")).select("m.*")


def clean(text: Column, entities: bool = True) -> Column:
    """Brackets, character references, single dashed capitals, white space. Null is empty.

    entities=False leaves character references alone and keeps the expression in the JVM;
    the result is the same for texts without "&".
    """
    c = F.coalesce(text, F.lit(""))
    for escaped, plain in BRACKETS:
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    if entities:
        c = unescape(c)
    c = F.regexp_replace(c, "(?U)-([A-Z])-(?!\\w)", "$1")
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def validate(text: Column) -> Column:
    """No artifact is left."""
    found = F.lit(False)
    for a in ARTIFACTS:
        found = found | F.contains(text, F.lit(a))
    return ~found


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def filled(text: Column) -> Column:
    """Whether clean(text, entities=False) leaves anything; white space alone becomes empty."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit("(?U)[^\\s\\x1c-\\x1f]"))


def tokens(text: Column) -> Column:
    """White-space tokens; none for an empty text."""
    return F.filter(F.split(text, _SPACE), lambda t: t != "")


def annotated_sentences(lines: Column, entities: bool = True) -> Column:
    """Cleaned, non-empty second fields of tab-separated lines."""
    rows = F.filter(F.split(strip(F.coalesce(lines, F.lit(""))), "\n"), lambda r: r != "")
    if entities:  # one call over the whole column: a Python function can't run inside transform
        rows = F.split(unescape(F.array_join(rows, "\n")), "\n")
    fields = F.transform(F.filter(F.transform(rows, lambda r: F.split(r, "\t")), lambda p: F.size(p) >= 2), lambda p: clean(F.get(p, F.lit(1)), entities=False))
    return F.filter(fields, lambda s: s != "")


def annotated_lines(lines: Column) -> Column:
    """line_num, sentence and entities of each line that isn't blank; nothing is cleaned."""
    rows = F.filter(F.split(F.coalesce(lines, F.lit("")), "\n"), lambda r: strip(r) != "")
    parts = F.filter(F.transform(rows, lambda r: F.split(r, "\t")), lambda p: F.size(p) >= 2)
    return F.transform(
        parts,
        lambda p: F.struct(F.get(p, F.lit(0)).alias("line_num"), F.get(p, F.lit(1)).alias("sentence"), F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))).alias("entities")),
    )


def sentence_positions(text: str, sentences: str) -> Column:
    """Character ranges i, s, e (0-based, end excluded) of sentences found one after the other in
    text; a sentence that isn't found is left out. text, sentences: names of columns."""
    # transform over one element binds the place, which is looked up once for a sentence
    return F.expr(
        f"""aggregate({sentences}, named_struct('pos', 1, 'i', 0, 'out', cast(array() AS array<struct<i:int,s:int,e:int>>)),
        (acc, x) -> element_at(transform(array(locate(x, {text}, acc.pos)), at -> if(at > 0,
            named_struct('pos', at + length(x), 'i', acc.i + 1, 'out', concat(acc.out, array(named_struct('i', acc.i, 's', at - 1, 'e', at - 1 + length(x))))),
            named_struct('pos', acc.pos, 'i', acc.i + 1, 'out', acc.out))), 1),
        acc -> acc.out)"""
    )


def artifact_flags(text: Column, names: tuple[str, ...] = PROFILED) -> Column:
    """Map of artifact to whether the text holds it."""
    return F.create_map(*(x for a in names for x in (F.lit(a), F.contains(text, F.lit(a)))))


def truncate(text: Column, n: int) -> Column:
    """The first n characters and an ellipsis, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def evidence_articles(evidence: Column) -> Column:
    """Distinct articles of nested evidence: the third of four items, else the first of two or more."""
    items = F.flatten(evidence)
    named = F.transform(items, lambda x: F.when(F.size(x) == 4, F.get(x, F.lit(2))).when(F.size(x) >= 2, F.get(x, F.lit(0))))
    return F.coalesce(F.array_distinct(F.filter(named, lambda y: y.isNotNull() & (y != ""))), F.array().cast("array<string>"))


def evidence_ids(evidence: Column) -> Column:
    """Lower-cased third items of evidence that has three or more, repeats kept."""
    items = F.filter(F.flatten(evidence), lambda x: F.size(x) >= 3)
    named = F.filter(F.transform(items, lambda x: F.get(x, F.lit(2))), lambda y: y.isNotNull() & (y != ""))
    return F.coalesce(F.transform(named, lambda y: F.lower(F.trim(y))), F.array().cast("array<string>"))


def parse_label(response: Column) -> Column:
    """The first label, in their fixed order, that an answer names; else NOT ENOUGH INFO."""
    up = F.upper(response)
    return F.when(F.contains(up, F.lit("SUPPORTS")), "SUPPORTS").when(F.contains(up, F.lit("REFUTES")), "REFUTES").otherwise("NOT ENOUGH INFO")
