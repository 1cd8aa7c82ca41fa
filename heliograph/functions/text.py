"""Scalar text functions as Columns: tokens, analyzers, stems, keys, excerpts, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the english analyzer drops, by length.
STOPWORDS = tuple(
    """i a
    or we up to so on of no my me it is in if he do by be at as an am
    you why who was too the she our out own off now nor not its how his him her had has for few did can but any are all and
    your with will when were what very than that them then they this such some same over only once more most just
    into hers here have from each does down been both also
    while would where which whom until under those there these their other could doing below being after again above about
    between because before during having should through further"""
    .split()
)

#: The shorter list of the citation functions.
CITATION_STOPWORDS = tuple(
    sorted(
        (set(STOPWORDS) | {"may"})
        - set("again above am because before below between could doing down during further having here hers him just me my nor now off once only out over own same through too under until while further".split())
    )
)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(t: Column) -> Column:
    """Strips plural, -ing and -ed endings; the first rule that fits counts."""
    n = F.length(t)

    def less(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    plural = (n > 3) & t.endswith("s") & ~(t.endswith("ss") | t.endswith("us") | t.endswith("is"))
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when((n > 5) & t.endswith("sses"), less(2))
        .when((n > 5) & t.endswith("ing"), less(3))
        .when((n > 4) & t.endswith("ed"), less(2))
        .when((n > 4) & (t.endswith("ches") | t.endswith("shes") | t.endswith("xes") | t.endswith("zes")), less(2))
        .when(plural, less(1))
        .otherwise(t)
    )


def content_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens without stop words, unstemmed."""
    return F.filter(tokens(text), lambda t: ~t.isin(*stopwords))


def english(text: Column) -> Column:
    """Tokens without stop words, stemmed."""
    return F.transform(content_tokens(text), stem)


def simple(text: Column) -> Column:
    return tokens(text)


ANALYZERS = {"simple": simple, "english": english}


def suffix_key(t: Column) -> Column:
    """The agent's key of a term: the first of -ing, -ed, -es, -s whose removal leaves more than three letters."""
    out = t
    for suffix in ("s", "es", "ed", "ing"):  # the last is asked first
        out = F.when((F.length(t) > len(suffix) + 3) & t.endswith(suffix), F.substring(t, F.lit(1), F.length(t) - len(suffix))).otherwise(out)
    return out


def entity_key(entity: Column) -> Column:
    """Lower case without possessives, single spaces."""
    bare = F.regexp_replace(F.lower(entity), "(?U)['’]s\\b", "")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def excerpt(text: Column, limit: int = 80) -> Column:
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def spotlight(contexts: Column, nonce: str = "ctx") -> Column:
    """Each context between tags that mark it as untrusted data, one per line."""
    wrapped = F.transform(contexts, lambda c, i: F.concat(F.lit(f'<document id="{nonce}-'), (i + 1).cast("string"), F.lit('" trust="untrusted">\n'), c, F.lit("\n</document>")))
    return F.array_join(wrapped, "\n")


def prompt(query: Column, contexts: Column) -> Column:
    """A question with its numbered contexts."""
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    none = F.concat(F.lit("Question: "), query, F.lit("\n\nNo context provided."))
    return F.when(F.size(contexts) == 0, none).otherwise(F.concat(F.lit("Context:\n"), numbered, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:")))


def valid_tenant(t: Column) -> Column:
    return t.rlike("^[0-9A-Za-z][-0-9A-Za-z_.]{0,63}$") & ~t.contains("..")


def clean_variant(line: Column) -> Column:
    """A query variant without list markers before it."""
    return F.regexp_replace(line, "^[-*0-9.() ]+", "")


def split_question(question: Column) -> Column:
    """Parts of a compound question, where at least two parts have two content terms each; else the question alone."""
    cut = F.split(question, r"(?U);\s+|\?\s+|\s+(?:and)\s+(?=(?:why|who|which|where|when|what|how)\b)")
    parts = F.transform(cut, lambda p: F.regexp_replace(p, "^[ ?.]+|[ ?.]+$", ""))
    parts = F.filter(parts, lambda p: F.size(content_tokens(p)) >= 2)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(question))


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """All matches of a pattern that can't be empty: array of (start, end, match), characters from 0.

    The gaps between matches come from split(); a match begins after all gaps and matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["0"])
        end = start + F.length(pair["1"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["1"].alias("match")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("0"), found.alias("1"))
    return F.aggregate(pairs, state, step, lambda acc: acc["out"])


SENTENCE = r"[^\n!.?]+(?:[!.?]+|\n|\z)"


def sentences(text: Column) -> Column:
    """Non-empty sentences as (start, end, match), stripped of white space at both ends."""
    spans = matches_with_offsets(text, SENTENCE)

    def strip(s: Column) -> Column:
        bare = F.regexp_replace(s["match"], "(?U)^\\s+", "")
        start = s["start"] + F.length(s["match"]) - F.length(bare)
        kept = F.regexp_replace(bare, "(?U)\\s+\\z", "")
        return F.struct(start.alias("start"), (start + F.length(kept)).alias("end"), kept.alias("match"))

    return F.filter(F.transform(spans, strip), lambda s: s["match"] != "")


def verdict(raw: Column) -> Column:
    """A judge's score from 1 to 5: of the first flat JSON object with a numeric score, else after the word score; null if none."""
    objects = F.regexp_extract_all(raw, F.lit(r"(?s)\{.*?\}"), F.lit(0))
    numbers = F.filter(F.transform(objects, lambda o: F.get_json_object(o, "$.score").try_cast("double")), lambda x: x.isNotNull())
    late = F.regexp_extract(raw, r"""(?i)['"]?score['"]?\s*[=:]\s*(\d(?:[.]\d+)?)""", 1)
    value = F.coalesce(F.get(numbers, F.lit(0)), F.when(late != "", late.try_cast("double")))
    return F.when(value.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.rint(value))).cast("int"))
