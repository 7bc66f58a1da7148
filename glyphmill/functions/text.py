"""Normalisers, tokenizers and overlap measures as Column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python counts it; letters folded to ASCII; detection tables of the query features.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
FOLD_ONE = ("ꜣꜥḥ", "aah")
FOLD_TWO = {"ḫ": "kh", "ẖ": "kh", "š": "sh", "ṯ": "tj", "ḏ": "dj"}
TRUE_WORDS = ["1", "true", "yes", "y", "t"]
NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DEITIES = {"wsir": "wsir", "inpw": "inpw", "ra": "ra", "pth": "pth", "hwt-hr": "hwt-hr", "anpu": "inpw"}
OFFERING_ITEMS = {"t": "bread", "hnqt": "beer", "k3w": "oxen", "3pdw": "fowl", "irp": "wine", "sšmn": "oil"}
PERIODS = [("Predynastic Period", -4000, -3000), ("Early Dynastic Period", -3000, -2686), ("Old Kingdom", -2686, -2181), ("First Intermediate Period", -2181, -2055), ("Middle Kingdom", -2055, -1650), ("Second Intermediate Period", -1650, -1550), ("New Kingdom", -1550, -1069), ("Third Intermediate Period", -1069, -664), ("Late Period", -664, -332), ("Ptolemaic Period", -332, -30)]
STOP_TOKENS = ["m", "n", "r", "s", "f", "k", "t", "w", "pw", "hr"]
LOOSE_BREAKS = r"[|:;\-,=~{}\[\]().]+"
Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Text) -> Column:
    """Null as ""."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def squeeze(c: Text) -> Column:
    return F.trim(F.regexp_replace(text(c), WS + "+", " "))


def norm_text(c: Text) -> Column:
    return squeeze(F.lower(text(c)))


norm_signs = norm_label = norm_text


def norm_mdc(c: Text) -> Column:
    starless = F.replace(norm_text(c), F.lit("*"), F.lit(":"))
    kept = F.regexp_replace(starless, r"[^a-z0-9:_\- ]", "")
    return squeeze(F.regexp_replace(kept, ":+", ":"))


def norm_translit(c: Text) -> Column:
    one = F.translate(norm_text(c), *FOLD_ONE)
    return squeeze(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLD_TWO.items(), one))


def pipe_array(c: Text) -> Column:
    return F.filter(F.transform(F.split(norm_text(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def norm_pipe(c: Text) -> Column:
    return F.array_join(pipe_array(c), "|")


def pipe_set(c: Text) -> Column:
    return F.array_distinct(pipe_array(c))


def parse_bool(c: Text) -> Column:
    return norm_text(c).isin(TRUE_WORDS)


def has_signs(c: Text) -> Column:
    return text(c).rlike(r"[\x{13000}-\x{143FF}]")


def norm_hieroglyphs(c: Text) -> Column:
    """Every character that is neither sign nor white space becomes a blank."""
    return squeeze(F.regexp_replace(text(c), r"[^\x{13000}-\x{143FF}]", " "))


def tokens(c: Text) -> Column:
    """Lower case, split at white space, colons and hyphens."""
    return F.filter(F.split(F.lower(text(c)), r"[:\-" + WS[1:] + "+"), lambda x: x != "")


def blank_split(c: Text) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda x: x != "")


def char_ngrams(c: Text, low: int = 2, high: int = 4) -> Column:
    """All grams of `low`..`high` characters of the padded lower-case text, repeats kept."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(text(c))), F.lit(" "))
    by_size = [F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i, n=n: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.flatten(F.array(*by_size))


def token_overlap(q: Column, c: Column, penalty: Column | float = 1.0) -> Column:
    """Tversky overlap of two token arrays; 0 if one is empty."""
    q, c = F.array_distinct(q), F.array_distinct(c)
    shared = F.size(F.array_intersect(q, c))
    missing, surplus = F.size(F.array_except(q, c)), F.size(F.array_except(c, q))
    return F.when((F.size(q) == 0) | (F.size(c) == 0), F.lit(0.0)).otherwise(shared / (shared + missing + penalty * surplus))


def surplus_penalty(q: Column, penalty: float = 0.3) -> Column:
    return F.when(F.size(q) >= 3, F.lit(penalty)).otherwise(F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    """0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def same_label(a: Text, b: Text) -> Column:
    a, b = F.trim(text(a)), F.trim(text(b))
    return F.when((a != "") & (a == b), F.lit(1.0)).otherwise(F.lit(0.0))


def safe_text(c: Text) -> Column:
    trimmed = squeeze(c)
    return F.when(F.lower(trimmed).isin("nan", "none"), F.lit("")).otherwise(F.trim(text(c)))


def canonical_reading(c: Text) -> Column:
    return norm_mdc(norm_translit(c))


def loose_reading(c: Text) -> Column:
    return norm_mdc(F.regexp_replace(norm_translit(c), LOOSE_BREAKS, " "))


def translit_tokens(c: Text) -> Column:
    return F.array_distinct(F.filter(F.split(norm_translit(c), r"[|:;\-,=~{}\[\]()." + WS[1:] + "+"), lambda x: x != ""))


def source_label(source: Text = "source", text_id: Text = "source_text_id", sentence_id: Text = "source_sentence_id") -> Column:
    parts = [(source, "unknown"), (text_id, "no_text_id"), (sentence_id, "no_sentence_id")]
    return F.concat_ws("/", *[F.when(safe_text(c) == "", F.lit(d)).otherwise(safe_text(c)) for c, d in parts])


def lemma_ids(c: Text) -> Column:
    return F.array_distinct(F.filter(F.transform(blank_split(c), lambda x: F.substring_index(x, "|", 1)), lambda x: x != ""))


def drop_endings(tokens_: Column) -> Column:
    return F.transform(tokens_, lambda t: F.when((F.length(t) > 4) & F.substring(t, -1, 1).isin("t", "w", "j", "y"), F.left(t, F.length(t) - 1)).otherwise(t))


def partial(tokens_: Column) -> Column:
    n = F.size(tokens_)
    keep = F.greatest(F.lit(2), F.least(n - 1, F.bround(n * 0.65).cast("int")))
    return F.when(n <= 2, F.slice(tokens_, 1, 1)).otherwise(F.slice(tokens_, F.lit(1), keep))


def query_features(tokens_: Column) -> dict[str, Column]:
    """Deity, formula type and slot, offering items and recipient that the tokens of a query point to."""
    deities = F.filter(tokens_, lambda t: t.isin(list(DEITIES)))
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    deity = F.coalesce(F.get(F.transform(deities, lambda t: lookup(DEITIES)[t]), F.lit(0)), F.lit(""))
    has = lambda *words: reduce(lambda a, b: a & b, [F.array_contains(tokens_, w) for w in words])
    opening, invocation = has("htp", "di", "nsw"), has("prt", "hrw")
    items = F.array_distinct(F.transform(F.filter(tokens_, lambda t: t.isin(list(OFFERING_ITEMS))), lambda t: lookup(OFFERING_ITEMS)[t]))
    return {
        "deity": deity,
        "formula_type": F.when(opening, "offering_formula").when(invocation, "invocation_formula").otherwise(""),
        "formula_slot": F.when(opening, "opening").when(invocation, "invocation").otherwise(""),
        "offering_items": F.array_join(items, "|"),
        "recipient": F.when(has("k3", "im3hw"), "revered_one").when(deity == "wsir", "osiris").when(deity == "inpw", "anubis").otherwise(""),
    }


def parse_year(c: Text) -> Column:
    return squeeze(c).try_cast("double").cast("int")


def derive_period(before: Column, after: Column) -> Column:
    """Period of the midpoint of a range of years; "" without years."""
    start, end = F.coalesce(before, after), F.coalesce(after, before)
    middle = (start + end) / 2
    out = F.when(start.isNull(), F.lit(""))
    for name, low, high in PERIODS:
        out = out.when((middle >= low) & (middle < high), F.lit(name))
    return out.otherwise(F.concat(F.lit("Undated range ("), start.cast("string"), F.lit(" to "), end.cast("string"), F.lit(")")))


def disagreement(gold: Text, predicted: Text) -> Column:
    """How a predicted reading differs from the gold one."""
    g, p = loose_reading(gold), loose_reading(predicted)
    first = lambda x: F.substring_index(x, " ", 1)
    return F.when(g == p, "editorial_only").when((g == "") | (p == ""), "different_lexeme").when((first(g) == first(p)) | g.startswith(p) | p.startswith(g), "ending_or_suffix").otherwise("different_lexeme")


def failure_class(query_tokens: Column, best: Column, exists: Column, rank: Column, threshold: Column) -> Column:
    distinct = F.array_distinct(query_tokens)
    content = F.array_except(distinct, F.array(*map(F.lit, STOP_TOKENS)))
    return (
        F.when((F.size(distinct) <= 2) | (F.size(content) == 0), "query_too_short")
        .when(exists & (rank > 3), "ranking_issue")
        .when(exists & rank.isNull(), "retrieval_miss")
        .when(best >= threshold - 0.06, "threshold_too_strict")
        .otherwise("corpus_gap")
    )


def python_round(c: Column, digits: int) -> Column:
    """Rounds the exact binary value, half to even, as Python does."""
    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: round(x, digits), na_action="ignore")

    return rounded(c)
