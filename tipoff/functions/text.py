"""Team-name normalisation and token similarity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------
# Matching results depend on these being exactly as written.
# ---------------------------------------------------------------------------

STOP_WORDS = (
    "basketball|club|bc|bk|fc|sk|ak|kk|as|ss|bball|city|team|"
    "real|istanbul|moscow|milan|milano|munchen|munich|london|"
    "koszykowki|baloncesto|pallacanestro|basket|baskets|sport|brose|s|"
    "telekom|ewe|fraport|skyliners|mhp|mlp|ratiopharm|"
    "fitness|first|gladiators|towers|seawolves|riesen|lowen|lions|"
    "academics|bv|rasta|"
    "ea7|emporio|armani|ldlc|beko|meridianbet|mozzart|bet|"
    "celtics|nets|knicks|76ers|raptors|bulls|cavaliers|pistons|pacers|"
    "bucks|hawks|hornets|heat|magic|wizards|nuggets|timberwolves|thunder|"
    "trail|blazers|jazz|warriors|clippers|lakers|suns|kings|mavericks|"
    "rockets|grizzlies|pelicans|spurs|hawks"
)

NAME_ALIASES = {
    "ea7 emporio armani milano": "olimpia",
    "barca basket": "barcelona",
    "barca": "barcelona",
    "crvena zvezda": "crvena zvezda meridianbet",
    "partizan": "partizan mozzart bet",
    "nanjing monkey kings": "nanjing tongxi",
    "zhejiang golden bulls": "zhejiang guangsha",
    "plateros de fresnillo": "gambusinos",
    "unahotels reggio emilia": "reggiana",
}

COMPOUNDS = {"sunrockers": "sun rockers", "neozone": "neo zone"}

EXPANSIONS = {r"(?U)\bla\b": "los angeles"}

LETTER_FOLDS = {"ł": "l", "đ": "d", "ø": "o", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe"}

CONTAINMENT_BASE = 0.5
CONTAINMENT_SLOPE = 0.25


@F.pandas_udf(StringType())
def _compatibility_form(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKD")


def strip_accents(name: Column) -> Column:
    """Fold accented letters to ASCII: full compatibility decomposition, ligatures and full-width
    forms included, in an Arrow batch, then marks removed."""
    return F.regexp_replace(_compatibility_form(name), r"\p{Mn}+", "")


def _lookup(col: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def normalise_name(name: Column) -> Column:
    """Accents, case, aliases, compounds, abbreviations, stop words, digits, punctuation.

    Aliases are looked up before stop words are removed.
    """
    out = F.lower(strip_accents(name))
    out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LETTER_FOLDS.items(), out)
    out = _lookup(out, NAME_ALIASES)
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), COMPOUNDS.items(), out)
    out = reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), EXPANSIONS.items(), out)
    # a stop word or number is removed where it is a whole word, so words can be tested one by
    # one; an alternation of all stop words would be tried at every word start
    words = F.filter(
        F.split(out, r"(?U)\W+"),
        lambda w: ~w.isin(STOP_WORDS.split("|")) & ~w.rlike(r"(?U)^\d+$"),
    )
    out = F.regexp_replace(F.array_join(words, " "), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Overlap of two token arrays, lifted when one contains the other; 0 when either is empty."""
    small, big = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    overlap = shared / F.nullif(big, F.lit(0))
    contained = CONTAINMENT_BASE + CONTAINMENT_SLOPE * (small / F.nullif(big, F.lit(0)))
    return (
        F.when(small == 0, F.lit(0.0))
        .when(shared == small, F.greatest(overlap, contained))
        .otherwise(overlap)
    )


def pair_score(home_sim: Column, away_sim: Column) -> Column:
    return (home_sim + away_sim) / 2


def abbreviation(name: Column) -> Column:
    """Initials of the first three words, or the first three characters of a single word."""
    words = F.filter(F.split(name, r"\s+"), lambda t: t != "")
    initials = F.array_join(F.transform(F.slice(words, 1, 3), lambda t: F.substring(t, 1, 1)), "")
    return F.upper(F.when(F.size(words) >= 2, initials).otherwise(F.substring(name, 1, 3)))


def prefixed_id(prefix: str, value: Column, length: int | None = None) -> Column:
    text = F.concat(F.lit(prefix), value.cast("string"))
    return text if length is None else F.substring(text, 1, length)
