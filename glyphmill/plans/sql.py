"""SQL pieces for the oracle, each the counterpart of a Column function."""

from __future__ import annotations

from glyphmill.functions import text as X
from glyphmill.sources.corpus import BASE_COLUMNS

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIGN = r"[\x{13000}-\x{143FF}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def norm_text(x: str) -> str:
    return squeeze(f"lower(coalesce({x}, ''))")


def norm_mdc(x: str) -> str:
    kept = f"regexp_replace(replace({norm_text(x)}, '*', ':'), '[^a-z0-9:_\\- ]', '', 'g')"
    return squeeze(f"regexp_replace({kept}, ':+', ':', 'g')")


def norm_translit(x: str) -> str:
    out = f"translate({norm_text(x)}, '{X.FOLD_ONE[0]}', '{X.FOLD_ONE[1]}')"
    for a, b in X.FOLD_TWO.items():
        out = f"replace({out}, '{a}', '{b}')"
    return squeeze(out)


def norm_pipe(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({norm_text(x)}, '|'), lambda y: trim(y)), lambda y: y <> ''), '|')"


def norm_hieroglyphs(x: str) -> str:
    return squeeze(f"regexp_replace(coalesce({x}, ''), '[^{SIGN[1:]}', ' ', 'g')")


def parse_bool(x: str) -> str:
    return f"{norm_text(x)} IN ({', '.join(repr(w) for w in X.TRUE_WORDS)})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[:\\-{WS[1:]}+'), lambda y: y <> '')"


def blank_split(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda y: y <> '')"


def canonical(x: str) -> str:
    return norm_mdc(norm_translit(x))


def loose(x: str) -> str:
    return norm_mdc(f"regexp_replace({norm_translit(x)}, '[|:;\\-,=~{{}}\\[\\]().]+', ' ', 'g')")


NULLS = ", ".join("'" + w.replace("'", "''") + "'" for w in X.NULL_WORDS)
BASE = "base AS (SELECT id, " + ", ".join(f"CASE WHEN {c} IS NULL OR {c} IN ({NULLS}) THEN '' ELSE {c} END AS {c}" for c in BASE_COLUMNS) + " FROM examples)"
_MAKE = {"mdc_norm": norm_mdc, "hieroglyphs_norm": norm_hieroglyphs, "transliteration_norm": norm_translit, "offering_items_norm": norm_pipe, "alt_transliterations_norm": norm_pipe, "aesthetic_arrangement_flag_bool": parse_bool}


def derived(names: list[str]) -> str:
    from glyphmill.sources.corpus import DERIVED

    return ", ".join(f"{_MAKE.get(n, norm_text)(DERIVED[n][0])} AS {n}" for n in names)


ALIGNED = f"""{BASE},
lists AS (SELECT id, translation, period, {blank_split(norm_hieroglyphs('hieroglyphs'))} AS s, {blank_split('transliteration_gold')} AS r FROM base),
pairs AS (SELECT id AS ord, p - 1 AS pos, s[p] AS sign, r[p] AS reading, CASE WHEN p = 1 THEN '<s>' ELSE s[p - 1] END AS previous_sign,
  CASE WHEN p = 1 THEN '<s>' ELSE r[p - 1] END AS previous_reading, CASE WHEN p = len(s) THEN '<s>' ELSE s[p + 1] END AS next_sign
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS p FROM lists WHERE len(s) > 0 AND len(s) = len(r)))"""


def _named(tokens_: str, table: dict[str, str]) -> str:
    """The tokens that a lookup table names, as what it calls them, in order."""
    names = ", ".join(f"'{k}': '{v}'" for k, v in table.items())
    return f"list_filter(list_transform({tokens_}, lambda y: MAP {{{names}}}[y]), lambda y: y IS NOT NULL)"


def _tversky(q: str, c: str, weight: str, penalty: str) -> str:
    """Overlap of two token tables (query_id, token, w) and (id, token, w), as (query_id, id, s) of pairs that share one."""
    return f"""(SELECT h.query_id, h.id, h.s / (h.s + (qs.s - h.s) + {penalty} * (cs.s - h.s)) AS s FROM (SELECT query_id, id, sum({c}.{weight}) AS s FROM {q} JOIN {c} USING (token) GROUP BY ALL) h
  JOIN (SELECT query_id, sum({weight}) AS s, max(k) AS k FROM {q} GROUP BY ALL) qs USING (query_id) JOIN (SELECT id, sum({weight}) AS s FROM {c} GROUP BY ALL) cs USING (id))"""


def _token_tables(name: str, query: str, row: str) -> str:
    """Tables of the distinct tokens of queries and rows with weights 1 and idf."""
    return f"""{name}_c0 AS (SELECT id, unnest(list_distinct({tokens(row)})) AS token FROM c), {name}_df AS (SELECT token, count(*) AS df FROM {name}_c0 GROUP BY token),
{name}_c AS (SELECT id, token, 1.0::DOUBLE AS one, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM {name}_c0 JOIN {name}_df USING (token), size),
{name}_q AS (SELECT query_id, k, token, 1.0::DOUBLE AS one, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT query_id, len({tokens(query)}) AS k, unnest(list_distinct({tokens(query)})) AS token FROM q) LEFT JOIN {name}_df USING (token), size)"""


def ranking(runs: str, weights: dict[str, float], k: int) -> str:
    """The `k` best rows of every query by the blend of all signals; runs: (query_id, query_mdc, query_reading_order)."""
    signs = f"regexp_matches(coalesce(query_mdc, ''), '{SIGN}')"
    counted = lambda key, text, source: " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(range(1, len({text}) + 4 - {n}), lambda i: substr(' ' || {text} || ' ', i::BIGINT, {n}))) AS gram FROM {source}" for n in (2, 3, 4))
    lcs = """list_reduce(list_prepend(list_transform(range(0, len(c.mdc) + 1), lambda z: 0::BIGINT), list_transform(string_split(q.q, ''), lambda z: [unicode(z)::BIGINT])),
  lambda state, x: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(c.mdc) + 1), lambda j: [j::BIGINT])), lambda made, j: list_append(made, CASE WHEN unicode(substr(c.mdc, j[1], 1)) = x[1] THEN state[j[1]] + 1 ELSE greatest(state[j[1] + 1], made[j[1]]) END)))[len(c.mdc) + 1]"""
    same = lambda a, b: f"CASE WHEN {a} <> '' AND {a} = {b} THEN 1.0::DOUBLE ELSE 0.0 END"
    signal = {
        "fuzzy_score": f"CASE WHEN len(q.q) + len(c.mdc) = 0 THEN 1.0::DOUBLE WHEN len(q.q) * len(c.mdc) = 0 THEN 0.0 ELSE 2.0::DOUBLE * {lcs} / (len(q.q) + len(c.mdc)) END",
        "tfidf_score": "coalesce(g.s, 0.0)", "overlap_score": "coalesce(o1.s, 0.0)", "idf_overlap_score": "coalesce(o2.s, 0.0)", "exact_bonus": "CASE WHEN q.q = c.mdc THEN 1.0::DOUBLE ELSE 0.0 END",
        "reading_order_overlap": "coalesce(o3.s, 0.0)", "glyph_overlap_score": "coalesce(o4.s, 0.0)", "glyph_idf_overlap_score": "coalesce(o5.s, 0.0)", "glyph_exact_bonus": same("q.qh", "c.hg"),
        "deity_bonus": same("f.deity", "c.deity"), "formula_type_bonus": same("f.formula_type", "c.formula_type"), "formula_slot_bonus": same("f.formula_slot", "c.formula_slot"),
        "offering_overlap": "CASE WHEN len(f.items) > 0 AND len(c.items) > 0 THEN len(list_intersect(f.items, c.items))::DOUBLE / len(list_distinct(list_concat(f.items, c.items))) ELSE 0.0 END",
        "recipient_bonus": same("f.recipient", "c.recipient"), "aesthetic_bonus": "CASE WHEN q.ro <> '' AND c.flag THEN 0.03::DOUBLE ELSE 0.0 END",
    }
    active = [f"(CASE WHEN max(abs({n})) OVER (PARTITION BY query_id) > 0 THEN {w} ELSE 0.0 END)::DOUBLE" for n, w in weights.items()]
    total = " + ".join(f"w{i}" for i in range(len(weights)))
    blend = " + ".join(f"w{i} / total * {n}" for i, n in enumerate(weights))
    has = lambda *words: " AND ".join(f"list_contains(t, '{w}')" for w in words)
    return f"""WITH {BASE}, c AS (SELECT id, {norm_mdc('mdc')} AS mdc, {norm_hieroglyphs('hieroglyphs')} AS hg, {norm_text('normalized_reading_order')} AS ron, {norm_text('deity')} AS deity, {norm_text('formula_type')} AS formula_type, {norm_text('formula_slot')} AS formula_slot,
  {norm_text('recipient')} AS recipient, list_distinct(list_filter(string_split({norm_pipe('offering_items')}, '|'), lambda y: y <> '')) AS items, {parse_bool('aesthetic_arrangement_flag')} AS flag FROM base), size AS (SELECT count(*) AS n FROM base),
q AS (SELECT query_id, {norm_mdc(f"CASE WHEN {signs} THEN regexp_replace(query_mdc, '{SIGN}', ' ', 'g') ELSE query_mdc END")} AS q, {norm_text('query_reading_order')} AS ro, CASE WHEN {signs} THEN {norm_hieroglyphs('query_mdc')} ELSE '' END AS qh FROM ({runs})),
f0 AS (SELECT query_id, {tokens("CASE WHEN ro <> '' THEN ro ELSE q END")} AS t FROM q), f1 AS (SELECT query_id, t, coalesce({_named('t', X.DEITIES)}[1], '') AS deity FROM f0),
f AS (SELECT query_id, deity, CASE WHEN {has('htp', 'di', 'nsw')} THEN 'offering_formula' WHEN {has('prt', 'hrw')} THEN 'invocation_formula' ELSE '' END AS formula_type, CASE WHEN {has('htp', 'di', 'nsw')} THEN 'opening' WHEN {has('prt', 'hrw')} THEN 'invocation' ELSE '' END AS formula_slot,
  list_distinct({_named('t', X.OFFERING_ITEMS)}) AS items, CASE WHEN {has('k3', 'im3hw')} THEN 'revered_one' WHEN deity = 'wsir' THEN 'osiris' WHEN deity = 'inpw' THEN 'anubis' ELSE '' END AS recipient FROM f1),
{_token_tables('m', 'q', 'mdc')}, {_token_tables('r', 'ro', 'ron')}, {_token_tables('h', 'qh', 'hg')},
gc AS (SELECT id, gram, count(*)::DOUBLE AS n FROM ({counted('id', 'mdc', 'c')}) GROUP BY ALL), gq AS (SELECT query_id, gram, count(*)::DOUBLE AS n FROM ({counted('query_id', 'q', 'q')}) GROUP BY ALL),
g AS (SELECT query_id, id, d / sqrt(a.n2 * b.n2) AS s FROM (SELECT query_id, id, sum(gq.n * gc.n) AS d FROM gq JOIN gc USING (gram) GROUP BY ALL) JOIN (SELECT query_id, sum(n * n) AS n2 FROM gq GROUP BY ALL) a USING (query_id) JOIN (SELECT id, sum(n * n) AS n2 FROM gc GROUP BY ALL) b USING (id)),
s AS (SELECT q.query_id, c.id, {', '.join(f'{e} AS {n}' for n, e in signal.items())} FROM q JOIN f USING (query_id) CROSS JOIN c LEFT JOIN g ON g.query_id = q.query_id AND g.id = c.id
  {' '.join(f"LEFT JOIN {_tversky(f'{t}_q', f'{t}_c', w, p)} {a} ON {a}.query_id = q.query_id AND {a}.id = c.id" for a, t, w, p in (('o1', 'm', 'one', '1.0'), ('o2', 'm', 'idf', 'CASE WHEN k >= 3 THEN 0.3 ELSE 1.0 END'), ('o3', 'r', 'one', '1.0'), ('o4', 'h', 'one', '1.0'), ('o5', 'h', 'idf', 'CASE WHEN k >= 3 THEN 0.3 ELSE 1.0 END')))}),
w AS (SELECT *, {', '.join(f'{a} AS w{i}' for i, a in enumerate(active))} FROM s), t AS (SELECT *, {total} AS total FROM w),
b AS (SELECT *, CASE WHEN total > 0 THEN round({blend}, 12) ELSE 0.0 END AS exact FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) AS rank FROM b)
SELECT query_id, rank::INT AS rank, id, {', '.join(f'round({n}, 9) AS {n}' for n in weights)}, round(exact, 9) AS final_score FROM p WHERE rank <= {k}"""
