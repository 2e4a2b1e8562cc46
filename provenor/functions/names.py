"""Rule-based spellings of names: a table function, matches explained by the rules, forms for lookups."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_VARIANTS, MIN_LETTERS, LOOKUP_LIMIT, RETAINED = 2, 400, 4, 12, 0.6

# Spellings that stand for each other, by rule; either may be written for the other.
EXCHANGES = {
    "latin_orthographic": ("latin", (("c", "k"), ("s", "z"), ("ph", "f"), ("y", "i"), ("x", "ks"))),
    "indic_aspirate": ("indic", (("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ph", "f"), ("ch", "c"), ("jh", "j"))),
    "indic_vowel_length": ("indic", (("aa", "a"), ("ee", "i"), ("oo", "u"), ("ii", "i"), ("uu", "u"), ("ai", "ay"), ("au", "ow"))),
    "indic_v_w": ("indic", (("v", "w"),)),
    "indic_retroflex": ("indic", (("tt", "t"), ("dd", "d"), ("nn", "n"), ("ll", "l"))),
    "indic_ksh": ("indic", (("ksh", "x"), ("sh", "s"))),
    "cyrillic_yo_e": ("cyrillic", (("yo", "e"), ("iy", "y"), ("ii", "i"), ("kh", "h"))),
    "arabic_orthographic": ("arabic", (("ou", "u"), ("kh", "ch"), ("q", "k"), ("aa", "a"), ("ee", "i"))),
    "pinyin_wade_giles": ("cjk", (("zh", "ch"), ("q", "ch"), ("x", "hs"), ("j", "ch"), ("z", "ts"), ("c", "ts'"), ("b", "p"), ("d", "t"), ("g", "k"))),
    "hepburn_kunrei": ("cjk", (("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("fu", "hu"), ("ji", "zi"), ("sha", "sya"), ("cho", "tyo"), ("jo", "zyo"))),
    "korean_rr_mr": ("cjk", (("b", "p"), ("d", "t"), ("g", "k"), ("j", "ch"), ("eo", "o"), ("eu", "u"), ("oe", "oi"))),
}
# Vowels that are swapped one position at a time, and from which position on.
VOWEL_SWAPS = {
    "indic_vowel_quality": ("indic", 1, {"a": "uo", "u": "ao", "i": "e", "e": "i", "o": "au"}),
    "arabic_vowel": ("arabic", 0, {"u": "o", "o": "u", "a": "e", "e": "a", "i": "e"}),
}
# Cyrillic in Latin letters, by standard.
BGN_PCGN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
ISO9_DIFFERS = {"ё": "yo", "х": "h", "щ": "sc", "ю": "ju", "я": "ja", "ж": "z", "ч": "c"}
ALA_LC_DIFFERS = {"й": "i", "ю": "iu", "я": "ia"}
UMLAUTS = {"ü": "ue", "ö": "oe", "ä": "ae", "ß": "ss"}
#: Consonants that are doubled or not.
DOUBLED = "bcdfglmnprstz"
#: The order in which rules are tried decides which of two equally short chains is kept.
ORDER = (
    "fold_diacritics", "german_umlaut_expand", "double_consonant", "latin_orthographic", "indic_aspirate", "indic_vowel_length", "indic_v_w",
    "indic_retroflex", "indic_ksh", "indic_final_a", "indic_vowel_quality", "name_order_swap", "initial_expand", "cyrillic_bgn_pcgn", "cyrillic_iso9",
    "cyrillic_ala_lc", "cyrillic_yo_e", "arabic_article", "arabic_vowel", "arabic_orthographic", "pinyin_wade_giles", "hepburn_kunrei", "korean_rr_mr",
)
LOOKUP_SAFE = frozenset({"fold_diacritics", "german_umlaut_expand", "name_order_swap", "initial_expand", "cyrillic_bgn_pcgn", "cyrillic_iso9", "cyrillic_ala_lc"})

Spell = Callable[[str], Iterable[str]]


def _exchange(pairs: Iterable[tuple[str, str]]) -> Spell:
    both = [p for a, b in pairs for p in ((a, b), (b, a))]
    return lambda s: (s.replace(a, b) for a, b in both if a in s)


def _swap_vowels(start: int, swaps: dict[str, str]) -> Spell:
    return lambda s: (s[:i] + v + s[i + 1 :] for i in range(start, len(s)) for v in swaps.get(s[i], ""))


def _letters(table: dict[str, str]) -> Spell:
    mapping = str.maketrans(table)
    return lambda s: [s.translate(mapping)]


def _doubling(s: str) -> Iterable[str]:
    yield re.sub(rf"([{DOUBLED}])\1", r"\1", s)
    single = (i for i, c in enumerate(s) if c in DOUBLED and s[i - 1 : i] not in [*DOUBLED] and s[i + 1 : i + 2] not in [*DOUBLED])
    for i in single:
        yield s[: i + 1] + s[i:]


def _initials(s: str) -> Iterable[str]:
    *given, last = s.split()
    return [" ".join([*(g[0] + dot for g in given), last]) for dot in ("", ".")] if given else []


def _order(s: str) -> Iterable[str]:
    parts = s.split()
    return [" ".join(reversed(parts))] if len(parts) == 2 else []


def _article(s: str) -> Iterable[str]:
    for m in re.finditer(r"\b(?:al|el|ul)[- ]", s):
        head, tail = s[: m.start()], s[m.end() :]
        yield from (head + tail, head + "al" + tail)
    if not re.match(r"(?:al|el)[- ]", s):
        yield "al-" + s


def _rules() -> dict[str, tuple[str, Spell]]:
    found: dict[str, tuple[str, Spell]] = {
        "fold_diacritics": ("latin", lambda s: ["".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))]),
        "german_umlaut_expand": ("latin", _letters(UMLAUTS)),
        "double_consonant": ("latin", _doubling),
        "indic_final_a": ("indic", lambda s: [s[:-1] if s.endswith("a") and len(s) > 3 else s + "a"]),
        "name_order_swap": ("any", _order),
        "initial_expand": ("any", _initials),
        "cyrillic_bgn_pcgn": ("cyrillic", _letters(BGN_PCGN)),
        "cyrillic_iso9": ("cyrillic", _letters(BGN_PCGN | ISO9_DIFFERS)),
        "cyrillic_ala_lc": ("cyrillic", _letters(BGN_PCGN | ALA_LC_DIFFERS)),
        "arabic_article": ("arabic", _article),
    }
    found |= {n: (script, _exchange(pairs)) for n, (script, pairs) in EXCHANGES.items()}
    found |= {n: (script, _swap_vowels(start, swaps)) for n, (script, start, swaps) in VOWEL_SWAPS.items()}
    script, exchange = found["arabic_orthographic"]
    found["arabic_orthographic"] = (script, lambda s: [*exchange(s), re.sub("['`ʿ]", "", s)])
    return {n: found[n] for n in ORDER}


RULES = _rules()
# Scripts by words of Unicode's letter names.
SCRIPTS = {
    "cyrillic": ("CYRILLIC",), "arabic": ("ARABIC",), "cjk": ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"),
    "indic": ("DEVANAGARI", "TELUGU", "TAMIL", "BENGALI", "GUJARATI", "KANNADA", "MALAYALAM", "GURMUKHI"), "latin": ("LATIN",),
}


def scripts(name: str) -> set[str]:
    named = [unicodedata.name(c, "") for c in name if c.isalpha()]
    return {next((s for s, words in SCRIPTS.items() if any(w in n for w in words)), "") for n in named} - {""} or {"latin"}


def rules_for(name: str, hint: str | None = None) -> list[str]:
    """Latin letters may write any romanised name, so without a hint those rules apply too."""
    found = scripts(name) | ({hint} if hint else set())
    if found == {"latin"} and not hint:
        found |= {"indic", "arabic", "cjk"}
    return [n for n, (script, _) in RULES.items() if script in found or script == "any"]


def squeeze(name: str) -> str:
    return " ".join(name.split())


def variants(name: str, hint: str | None = None, depth: int = MAX_DEPTH, most: int = MAX_VARIANTS) -> dict[str, tuple[str, ...]]:
    """Spellings and the chain of rules to each, shortest first; a rule's spellings are taken in order, so the cut is always the same."""
    base = squeeze(name)
    usable, start = rules_for(base, hint), base.lower()
    found: dict[str, tuple[str, ...]] = {start: ()}
    level = [start]
    for _ in range(depth):
        fresh = []
        for value in level:
            for rule in usable:
                if rule in found[value]:
                    continue
                for spelled in sorted({v.lower() for v in RULES[rule][1](value)}):
                    if spelled not in found and len(found) < most:
                        found[spelled] = (*found[value], rule)
                        fresh.append(spelled)
        level = fresh
    return found


def letter_count(s: str) -> int:
    return sum(map(str.isalpha, s))


def match(a: str, b: str, hint: str | None = None, depth: int = MAX_DEPTH) -> dict:
    """matched, form, chain_a, chain_b, transforms, note."""
    out = {"matched": False, "form": "", "chain_a": [], "chain_b": [], "transforms": 0, "note": ""}
    x, y = squeeze(a), squeeze(b)
    if x.lower() == y.lower():
        return out | {"matched": True, "form": x}
    if min(len(s.replace(" ", "")) for s in (x, y)) < MIN_LETTERS:
        return out | {"note": "too short"}
    of_x, of_y = variants(x, hint, depth), variants(y, hint, depth)
    both = of_x.keys() & of_y.keys()
    enough = RETAINED * min(letter_count(x), letter_count(y))
    meet = [(len(of_x[f]) + len(of_y[f]), -letter_count(f), f) for f in both if letter_count(f) >= enough]
    if not meet:
        return out | {"note": "only stubs in common" if both else ""}
    n, _, form = min(meet)
    return out | {"matched": True, "form": form, "chain_a": list(of_x[form]), "chain_b": list(of_y[form]), "transforms": n}


def lookup_variants(name: str, limit: int = LOOKUP_LIMIT, hint: str | None = None) -> list[str]:
    """The name as written, then spellings by safe rules alone, shortest chains first."""
    base = squeeze(name)
    if not base:
        return []
    safe = sorted((len(c), v) for v, c in variants(base, hint).items() if LOOKUP_SAFE.issuperset(c) and v != base.lower())
    return [base, *(v for _, v in safe)][:limit]


def rule_catalog() -> list[tuple[str, str, bool]]:
    return sorted((n, script, n in LOOKUP_SAFE) for n, (script, _) in RULES.items())


class NameVariants:
    """A table function: the spellings of a name."""

    def eval(self, name: str):
        for v, c in variants(name or "").items():
            yield v, list(c), len(c)


def match_column(a, b):
    """The match of two columns, as a struct. For lists of names use ``match_names``: it tries no pairs."""
    kind = "matched boolean, form string, chain_a array<string>, chain_b array<string>, transforms int, note string"

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([match(p or "", q or "") for p, q in zip(x, y, strict=True)])

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, kind)(a, b)


def lookup_column(name):
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda n: lookup_variants(n or ""))

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(name)


def expand(names: DataFrame, column: str) -> DataFrame:
    """(name, variant, chain, depth) of the distinct names of a column."""
    spark = names.sparkSession
    spark.udtf.register("provenor_name_variants", F.udtf(NameVariants, returnType="variant string, chain array<string>, depth int"))
    names.select(F.col(column).alias("name")).where("name is not null").distinct().createOrReplaceTempView("provenor_names")
    return spark.sql("SELECT name, v.variant, v.chain, v.depth FROM provenor_names, LATERAL provenor_name_variants(name) v")


def match_names(left: DataFrame, right: DataFrame, column: str = "name") -> DataFrame:
    """All matching pairs of two lists of names: spellings are joined, not pairs tried."""
    a = expand(left, column).select(F.col("name").alias("a"), F.col("variant").alias("form"), F.col("chain").alias("chain_a"))
    b = expand(right, column).select(F.col("name").alias("b"), F.col("variant").alias("form"), F.col("chain").alias("chain_b"))
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    short = lambda c: F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) < MIN_LETTERS
    enough = letters(F.col("form")) >= RETAINED * F.least(letters(F.col("a")), letters(F.col("b")))
    same = F.lower("a") == F.lower("b")
    met = a.join(b, "form").where((F.lower("a") <= F.lower("b")) & (same | (enough & ~short("a") & ~short("b"))))
    best = F.struct((F.size("chain_a") + F.size("chain_b")).alias("transforms"), (-letters(F.col("form"))).alias("n"), "form", "chain_a", "chain_b")
    return met.groupBy("a", "b").agg(F.min(best).alias("m")).select("a", "b", "m.form", "m.chain_a", "m.chain_b", "m.transforms")
