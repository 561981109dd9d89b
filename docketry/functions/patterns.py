"""Patterns of identifiers and mentions, and the positions of their matches.

Patterns keep to what Java and RE2 read alike: no look-around, no back-references, \\b next to
digits only, classes of ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# public formats of the identifiers
IDENTIFIERS = {
    "cpf": r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b",
    "cnpj": r"\b[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}\b",
    "cnj": r"\b[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}\b",
    "oab": r"OAB/[A-Z]{2} ?[0-9]{3,6}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\([0-9]{2}\) ?[0-9]{4,5}-[0-9]{4}\b",
    "cep": r"\b[0-9]{5}-[0-9]{3}\b",
    "nit": r"\b[0-9]{3}\.[0-9]{5}\.[0-9]{2}-[0-9]\b",
}
#: A number is an RG only beside one of its labels; bare numbers are left alone.
RG = r"(?:RG|[Rr]egistro [Gg]eral|[Cc]édula de [Ii]dentidade)(?: n[º°o.]+)?:? *([0-9]{1,2}\.?[0-9]{3}\.?[0-9]{3}(?:-[0-9Xx])?)"
MENTIONS = {
    "value": r"R\$ ?[0-9][0-9.]*(?:,[0-9]{2})?",
    "date": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    "law": r"(?:Lei|Decreto|Resolução|Súmula)(?: [A-Z]+)? (?:n[º°o.]+ ?)?[0-9][0-9.]*(?:/[0-9]{4})?",
    "deadline": r"\b[0-9]+ dias\b",
}
#: What masking must leave as it is.
PRESERVED = ("date", "law", "deadline")

#: What a text with a match holds: telling that it is not there is far cheaper than a search.
LITERALS = {
    IDENTIFIERS["cpf"]: "-",
    IDENTIFIERS["cnpj"]: "/",
    IDENTIFIERS["cnj"]: "-",
    IDENTIFIERS["oab"]: "OAB/",
    IDENTIFIERS["email"]: "@",
    IDENTIFIERS["phone"]: "(",
    IDENTIFIERS["cep"]: "-",
    IDENTIFIERS["nit"]: "-",
    MENTIONS["value"]: "R$",
    MENTIONS["date"]: "/",
    MENTIONS["deadline"]: " dias",
}
#: Stands around matches.
MARK = "\x01"
#: Matches of a kind in a text up to which each counts the text before it; more are summed up.
FEW = 64
#: Bytes of a text up to which marks are put in at all.
SHORT = 65_536


def running(steps: Column) -> Column:
    """Running sums of an array of longs, inside of a row.

    An array that grows is copied at each step, so sums run in stretches of the square root of its size, and
    over the stretches' totals: 80,000 numbers copy 10 million, not 3 billion.
    """
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    add = lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), zero) + x)
    width = F.greatest(F.ceil(F.sqrt(F.size(steps).cast("double"))).cast("int"), F.lit(1))
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), width)).otherwise(F.array().cast("array<int>"))
    inner = F.transform(starts, lambda s: F.aggregate(F.slice(steps, s, width), none, add))
    before = F.aggregate(F.transform(inner, lambda b: F.element_at(b, -1)), F.array(zero), add)
    many = F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda b, t: F.transform(b, lambda x: x + t)))
    return F.when(F.size(steps) > 1, many).otherwise(steps)


def matches(texts: DataFrame, key: list[str], text: str, patterns: dict[str, str], group: int = 0) -> DataFrame:
    """(key..., kind, value, start, end): a row for each match of each pattern, by one pass over the texts.

    value is the match, or the given group of it; start and end are those of the whole match, in code points,
    end exclusive. Rows need no unique key. Null texts have no matches.

    A text that lacks the literal of a kind is not searched for it. Else one search puts marks around the matches, and
    what stands before a mark tells its offset. Long texts, those with many matches and those with the mark itself are searched otherwise:
    gaps and matches alternate, so running sums of their lengths inside of the row give the offsets.
    """
    kinds = list(patterns.items())
    n_of = range(len(kinds))
    col = lambda name, i: F.col(f"__{name}{i}")
    found = texts.select(*key, F.col(text).alias("__text"))
    maybe = [F.contains("__text", F.lit(LITERALS[p])) if p in LITERALS else F.col("__text").isNotNull() for _, p in kinds]
    marked = [F.when(m & (F.octet_length("__text") <= SHORT) & ~F.contains("__text", F.lit(MARK)), F.regexp_replace("__text", F.lit(p), F.lit(f"{MARK}$0{MARK}"))) for m, (_, p) in zip(maybe, kinds, strict=True)]
    found = found.select(*key, "__text", *[m.alias(f"__maybe{i}") for i, m in enumerate(maybe)], *[m.alias(f"__marked{i}") for i, m in enumerate(marked)])
    marks = [F.octet_length(col("marked", i)) - F.octet_length("__text") for i in n_of]
    parts = [F.when(m.between(2, 2 * FEW), F.split(col("marked", i), MARK, -1)) for i, m in enumerate(marks)]
    again = [col("maybe", i) & F.coalesce(m > 2 * FEW, F.lit(True)) for i, m in enumerate(marks)]
    hits = [F.when(a, F.regexp_extract_all("__text", F.lit(p), F.lit(0))) for a, (_, p) in zip(again, kinds, strict=True)]
    found = found.select(*key, "__text", *[c.alias(f"__{n}{i}") for n, cs in (("parts", parts), ("hits", hits)) for i, c in enumerate(cs)], *[f"__marked{i}" for i in n_of])
    none = F.array().cast("array<bigint>")
    size = lambda gap, hit: F.char_length(gap) + F.char_length(hit).cast("long")
    steps = [  # as many gaps as matches: the one behind the last match is left out
        F.when(F.size(col("hits", i)) > 0, F.zip_with(F.slice(F.split("__text", p, -1), F.lit(1), F.size(col("hits", i))), col("hits", i), size)).otherwise(none)
        for i, (_, p) in enumerate(kinds)
    ]
    any_hit = [col("parts", i).isNotNull() | (F.size(col("hits", i)) > 0) for i in n_of]
    groups = [F.when(any_hit[i], F.regexp_extract_all("__text", F.lit(p), F.lit(group))) if group else F.lit(None) for i, (_, p) in enumerate(kinds)]
    held = [f"__{n}{i}" for n in ("marked", "parts", "hits") for i in n_of]
    found = found.select(*key, *held, *[c.alias(f"__{n}{i}") for n, cs in (("steps", steps), ("groups", groups)) for i, c in enumerate(cs)])
    found = found.select(*key, *held, *[f"__groups{i}" for i in n_of], *[running(col("steps", i)).alias(f"__ends{i}") for i in n_of])

    def span(kind, hit, value, start):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), start.cast("long").alias("start"), F.char_length(hit).cast("long").alias("size"))

    def told(i, kind):
        value = lambda hit, k: F.get(col("groups", i), k) if group else hit
        before = lambda k: F.char_length(F.call_function("substring_index", col("marked", i), F.lit(MARK), 2 * k + 1)) - 2 * k
        few = F.transform(F.sequence(F.lit(0), F.floor(F.size(col("parts", i)) / 2).cast("int") - 1), lambda k: span(kind, F.get(col("parts", i), 2 * k + 1), value(F.get(col("parts", i), 2 * k + 1), k), before(k)))
        many = F.transform(F.arrays_zip(col("hits", i).alias("hit"), col("ends", i).alias("end")), lambda m, k: span(kind, m["hit"], value(m["hit"], k), m["end"] - F.char_length(m["hit"])))
        nothing = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, value: STRING, start: BIGINT, size: BIGINT>>)")
        return F.when(col("parts", i).isNotNull(), few).when(F.size(col("hits", i)) > 0, many).otherwise(nothing)

    # a filter on spans would be moved below them and search once more: texts without a match go by their null row, behind the spans
    rows = found.select(*key, F.inline_outer(F.concat(*[told(i, kind) for i, (kind, _) in enumerate(kinds)]))).filter("kind IS NOT NULL")
    return rows.select(*key, "kind", "value", "start", (F.col("start") + F.col("size")).alias("end"))
