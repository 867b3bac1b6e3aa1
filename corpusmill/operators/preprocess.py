"""Query preprocessing: each takes a query column and gives an array of queries, without duplicates where it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Synonyms, of which the first two are used.
SYNONYMS = {
    "error": ["exception", "failure", "bug"],
    "function": ["method", "procedure"],
    "create": ["make", "build", "generate"],
    "delete": ["remove", "destroy"],
    "update": ["modify", "change", "edit"],
    "find": ["search", "lookup", "locate"],
    "fast": ["quick", "rapid", "speedy"],
    "slow": ["sluggish", "delayed"],
}
# Words that show an intent, as substrings; on ties the first intent holds.
INTENTS = {
    "HowTo": ["how", "tutorial", "guide", "steps", "way"],
    "Definition": ["what", "define", "meaning", "definition"],
    "Troubleshooting": ["error", "fix", "problem", "issue", "not working", "failed", "broken"],
    "Comparison": ["vs", "versus", "compare", "difference", "better"],
}


def passthrough(q: Column) -> Column:
    return F.array(q)


def mock_answer(q: Column) -> Column:
    return F.concat(F.lit("The answer is: "), q)


def hyde(q: Column, generator=mock_answer, include_original: bool = True) -> Column:
    """A hypothetical answer, after the query itself if wanted. generator: a column function, e.g. a model's UDF."""
    return F.array(q, generator(q)) if include_original else F.array(generator(q))


def hyde_text(q: Column, generator=mock_answer) -> Column:
    """Query and hypothetical answer as one text."""
    return F.concat_ws(" ", q, generator(q))


def keyword_expansions(q: Column) -> Column:
    """The keywords alone if there are several, then the query with each of the first three."""
    w = X.keywords(q)
    alone = F.when(F.size(w) > 1, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(alone, F.transform(F.slice(w, 1, 3), lambda k: F.concat_ws(" ", q, k)))


def synonym_expansions(q: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """For each word with synonyms the query with that word replaced, by two of them at most."""
    table = synonyms or SYNONYMS
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v[:2])))])
    words = F.filter(F.split(q, X.WHITE), lambda w: w != "")

    def variants(w: Column, i: Column) -> Column:
        swap = lambda s: F.array_join(F.concat(F.slice(words, 1, i), F.array(s), F.slice(words, i + 2, F.size(words))), " ")
        return F.transform(F.coalesce(F.try_element_at(known, F.lower(w)), F.array().cast("array<string>")), swap)

    return F.flatten(F.transform(words, variants))


def multi_query(q: Column, expansions: Column, most: int = 5, include_original: bool = True) -> Column:
    """The query first, then its expansions, each once, `most` in all."""
    every = F.concat(F.array(q), expansions) if include_original else F.filter(expansions, lambda e: e != q)
    return F.slice(F.array_distinct(every), 1, most)


def chained(q: Column, steps: list, dedup: bool = True, most: int = 10) -> Column:
    """What each step makes of the original query, in order."""
    if not steps:
        return F.array(q)
    every = F.concat(*[s(q) for s in steps])
    return F.slice(F.array_distinct(every) if dedup else every, 1, most)


def analysis(q: Column) -> Column:
    """struct(original, intent, keywords, confidence)."""
    low = F.lower(q)
    hits = {i: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for i, words in INTENTS.items()}
    best = F.greatest(*hits.values())
    intent = F.when(best == 0, "Unknown")
    for i, n in hits.items():
        intent = intent.when(n == best, i)
    sure = F.when(best == 0, 0.3).otherwise(F.least(best * 0.1 + 0.5, F.lit(1.0)))
    return F.struct(q.alias("original"), intent.alias("intent"), X.tokens(q, [], least=3).alias("keywords"), F.round(sure, 6).alias("confidence"))
