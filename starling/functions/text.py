"""Column functions on titles, genres and tags."""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The vocabulary of tags, their facets and weights.
NO_GENRES = "(no genres listed)"
BLOCKED = "netflix"
FACET_WEIGHTS = {"theme": 1.18, "style": 1.12, "franchise": 1.0, "person": 0.86, "meta": 0.66}
THEMES = "aliens|animation|apocalypse|assassin|coming-of-age|crime|cyberpunk|dystopia|friendship|future|gangster|heist|hit men|horror|magic|murder|post-apocalyptic|revenge|robot|serial killer|space|space action|space opera|superhero|survival|tarantino|time travel|vampire|war|world war ii|zombie".split("|")
STYLES = "atmospheric|beautiful|bittersweet|bleak|clever|dark|dark comedy|disturbing|dreamlike|emotional|epic|feel-good|fun|funny|good dialogue|gritty|inspirational|mind-bending|quirky|satire|slow|stylized|suspense|tense|thought-provoking|twist ending|visually appealing".split("|")
METAS = "based on a book|classic|criterion|cult film|dvd|imdb top 250|oscar|overrated|seen more than once|soundtrack|underrated".split("|")
META_MARKS = "adapted from|based on|criterion|imdb|oscar|overrated|seen|soundtrack|underrated".split("|")
FRANCHISES = "batman|disney|harry potter|lord of the rings|marvel|pixar|star trek|star wars|tolkien".split("|")
PERSONS = "alfred hitchcock|brad pitt|christopher nolan|christina ricci|christopher lloyd|coen brothers|bruce willis|harvey keitel|hayao miyazaki|jim carrey|john travolta|leonardo dicaprio|martin scorsese|meryl streep|quentin tarantino|samuel l. jackson|stanley kubrick|steven spielberg|steve buscemi|tom hanks|uma thurman".split("|")
ALIASES = {
    "sci-fi": ["sci fi", "scifi", "science fiction", "science-fiction", "sf"],
    "dark comedy": ["black comedy", "black humor", "black humour", "dark humor", "dark humour"],
    "time travel": ["time-travel"],
    "twist ending": ["twist", "twists", "plot twist"],
    "superhero": ["super hero", "super-hero", "comic book", "comic-book"],
    "coming-of-age": ["coming of age", "coming-of-age"],
    "world war ii": ["world war ii", "wwii", "ww2"],
    "serial killer": ["serial killers"],
    "mind-bending": ["mindfuck", "mind fuck", "mind bending"],
    "feel-good": ["feel good", "feelgood"],
    "hit men": ["hitman", "hitmen"],
    "non-linear": ["nonlinear", "nonlinear narrative", "nonlinear storyline", "nonlinear timeline", "non-linear timeline", "disjointed timeline", "achronological", "out of order"],
    "good dialogue": ["great dialogue", "amazing dialogues", "dialogue", "smart writing"],
    "soundtrack": ["good music", "great soundtrack", "notable soundtrack"],
    "cult film": ["cult", "cult classic"],
}
# The words of titles.
ARTICLES = ["a", "an", "the"]
SEQUENCE_WORDS = ["part", "pt", "episode", "ep", "volume", "vol", "chapter"]
ROMANS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
SUBTITLES = ["reloaded", "revolutions", "resurrection", "resurrections", "revisited"]
SUPPLEMENTS = ["bonus", "material", "extras", "extra", "behind", "scenes", "making", "documentary", "revisited"]
WEAK_ENDS = ["a", "an", "and", "for", "of", "or", "the", "to"]


def normalise(c: Column) -> Column:
    return F.lower(F.trim(c))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def split_pipe(c: Column) -> Column:
    """Trimmed parts of a pipe list; the sentinel for none, an empty text and null give an empty array."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (F.trim(c) == NO_GENRES), F.array().cast("array<string>")).otherwise(parts)


def tag_key(c: Column) -> Column:
    """Lower case, & as and, _ and / as spaces, other marks as spaces, single spaces."""
    c = F.regexp_replace(F.lower(F.trim(c)), "&", " and ")
    c = F.regexp_replace(F.regexp_replace(c, "[_/]+", " "), r"[^a-z0-9+#.\- ]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alias_table(extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Each alias with the end of its chain; a cycle ends where it began."""
    direct = {a: target for target, names in ALIASES.items() for a in names} | dict(extra or {})
    ends = {}
    for name in direct:
        seen, at = {name}, direct[name]
        while at in direct and at not in seen:
            seen.add(at)
            at = direct[at]
        ends[name] = at
    return ends


def canonical_tag(c: Column, extra: Mapping[str, str] | None = None) -> Column:
    """The tag that a free text stands for; null for empty ones and for those with the blocked word."""
    pairs = [F.lit(x) for item in alias_table(extra).items() for x in item]
    key = tag_key(c)
    named = F.coalesce(F.element_at(F.create_map(*pairs), key), key)
    return F.when(F.lower(c).contains(BLOCKED) | (F.trim(F.coalesce(c, F.lit(""))) == "") | (key == ""), F.lit(None)).otherwise(named)


def facet(c: Column) -> Column:
    """The first of theme, style, franchise, person and meta that a canonical tag belongs to; theme by default."""
    return (
        F.when(c.isin(THEMES), "theme").when(c.isin(STYLES), "style").when(c.isin(FRANCHISES), "franchise").when(c.isin(PERSONS), "person")
        .when(c.isin(METAS) | c.rlike("|".join(META_MARKS)), "meta").otherwise("theme")
    )


def tag_confidence(count: Column) -> Column:
    return F.when(count > 0, F.round(0.52 + 0.48 * F.least(F.log1p(count) / F.log1p(F.lit(5.0)), F.lit(1.0)), 4)).otherwise(0.0)


def tag_weight(count: Column, kind: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for item in FACET_WEIGHTS.items() for x in item])
    return F.round(F.log1p(F.greatest(count, F.lit(1)).cast("double")) * tag_confidence(count) * F.element_at(weights, kind), 4)


def tag_display(c: Column) -> Column:
    """Each run of letters capitalised, but for two names."""
    runs = F.regexp_extract_all(c, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    caps = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")
    return F.when(c == "sci-fi", "Sci-Fi").when(c == "world war ii", "World War II").otherwise(caps)


def bigrams(c: Column) -> Column:
    """Distinct character pairs; a text of fewer than two characters is its own only one."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def token_similarity(a: Column, b: Column) -> Column:
    """The greater of jaccard and 0.86 of containment, which needs two shared tokens or two single ones."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    inside = F.when((both >= 2) | ((F.size(a) == 1) & (F.size(b) == 1)), both / least).otherwise(0.0)
    return F.when(least == 0, 0.0).otherwise(F.greatest(jaccard(a, b), 0.86 * inside))


def singular(c: Column) -> Column:
    return (
        F.when((F.length(c) > 4) & c.endswith("ies"), F.regexp_replace(c, "ies$", "y"))
        .when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


def singular_tokens(c: Column) -> Column:
    return F.transform(tokens(c), singular)


def compact(c: Column) -> Column:
    """Tokens without spaces, each made singular twice."""
    return F.array_join(F.transform(singular_tokens(c), singular), "")


@F.pandas_udf(T.DoubleType())
def gestalt(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matched characters of the recursive longest common blocks, twice over the summed length; left is the first sequence."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right)], dtype="float64")


def without_year(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s*\(\d{4}\)\s*$", "")


def article_first(c: Column) -> Column:
    """`Name, The` as `The Name`."""
    return F.regexp_replace(F.trim(c), r"(?is)^(.*),\s*(the|a|an)$", "$2 $1")


def _title_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "))


def _without_articles(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"^((?:{'|'.join(ARTICLES)})(?: |$))+", ""))


def canonical_title(c: Column) -> Column:
    """Words of a title without its year and leading articles, joined by spaces."""
    return _without_articles(_title_words(article_first(without_year(c))))


def series_key(c: Column) -> Column:
    """What titles of one series share: the part before a colon, semicolon or slash, without numbering and known subtitles."""
    first = F.regexp_extract(article_first(without_year(c)), r"(?s)^(.*?)(?:\s*[:;/]\s*.*)?$", 1)
    key = _without_articles(_title_words(first))
    number, word = rf"(?:\d+|{'|'.join(sorted(ROMANS, key=len, reverse=True))})", "|".join(SEQUENCE_WORDS)
    key = F.regexp_replace(key, rf"(?:(?:^| )(?:{word}|{number}))+$", "")
    return F.regexp_replace(key, rf"(?<=.) (?:{'|'.join(SUBTITLES)})$", "")


def specific_key(key: Column) -> Column:
    """Whether a series key is two words or one of five characters or more."""
    return key.contains(" ") | (F.length(key) >= 5)


def shared_prefix(a: Column, b: Column) -> Column:
    """Words that two canonical titles start with, without weak words at the end, or an empty text if that tells too little.

    One word is enough if it has five characters, is all of the shorter title and the longer one goes on with a number or
    a known subtitle.
    """
    left, right = F.split(a, " "), F.split(b, " ")
    differs = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), False)
    length = F.when(differs == 0, F.least(F.size(left), F.size(right))).otherwise(differs - 1).cast("int")
    shared = F.array_join(F.slice(left, 1, length), " ")
    shared = F.trim(F.regexp_replace(shared, rf"(?:(?:^| )(?:{'|'.join(WEAK_ENDS)}))+$", ""))
    short, long = F.when(F.size(left) <= F.size(right), left).otherwise(right), F.when(F.size(left) <= F.size(right), right).otherwise(left)
    after = F.get(long, F.lit(1))
    goes_on = after.isin(SUBTITLES + ROMANS) | after.rlike(r"^\d+$")
    alone = (F.length(shared) >= 5) & (F.size(short) == 1) & (F.get(short, F.lit(0)) == shared) & F.coalesce(goes_on, F.lit(False))
    return F.when((a == "") | (b == ""), "").when(shared.contains(" ") | alone, shared).otherwise("")


def supplemental(title: Column) -> Column:
    return F.arrays_overlap(F.split(canonical_title(title), " "), F.array(*[F.lit(w) for w in SUPPLEMENTS]))


def same_series(left: Column, right: Column) -> Column:
    """Struct (is_match, key, supplemental) of two titles: equal specific keys, else a shared prefix."""
    a, b = series_key(left), series_key(right)
    equal = (a == b) & (a != "") & specific_key(a)
    prefix = shared_prefix(canonical_title(left), canonical_title(right))
    key = F.when(equal, a).otherwise(prefix)
    return F.struct((key != "").alias("is_match"), key.alias("key"), (supplemental(right) & (key != "")).alias("supplemental"))

