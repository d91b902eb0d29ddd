"""DuckDB SQL of the catalogue's queries, written from the operators' definitions.

Words that must agree (legal forms, abbreviations) come from the tables of the operators.
"""

from __future__ import annotations

from kinlink.catalogue import adapters as A
from kinlink.functions import text as T
from kinlink.operators import addresses as P
from kinlink.operators import decide as D
from kinlink.operators import names as N

MERGED, MERGED_TO = "".join(T.SKELETON_MERGED), "".join(T.SKELETON_MERGED.values())


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def skel(x: str) -> str:
    """SQL of the skeleton: run collapse by comparing neighbours, since RE2 has no back-references."""
    y = x
    for a, b in T.SKELETON_REWRITES:
        y = f"replace({y}, '{a}', '{b}')"
    z = f"translate({y}, '{MERGED}{T.SKELETON_DROPPED}', '{MERGED_TO}')"
    c = f"array_to_string(list_transform(list_filter(range(1, length({z}) + 1), lambda i: i = 1 OR substr({z}, i::INT, 1) <> substr({z}, (i - 1)::INT, 1)), lambda i: substr({z}, i::INT, 1)), '')"
    return f"(CASE WHEN {z} = '' THEN substr({y}, 1, 1) ELSE {c} END)"


TSV = r"SELECT CAST(c_custkey AS VARCHAR) AS k, '\"' || c_name || '\' AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer".replace(r"\"", '"')
TRUTH_PAIRS = f"SELECT DISTINCT 'S1-' || si AS s, 'S2-' || qi AS q FROM ({A.TRUTH})"
ID_LISTS = f"""
SELECT u.s AS source1_entity_id, coalesce(string_agg(DISTINCT q, ',' ORDER BY q), '') AS matched_entity_ids
FROM (SELECT 'S1-' || si AS s FROM ({A.UNIVERSE})) u LEFT JOIN (SELECT 'S1-' || si AS s, 'S' || src || '-' || qi AS q FROM ({A.CLAIMS}) WHERE p2 > 0.9) c ON c.s = u.s GROUP BY u.s
"""
LATIN_FOLD = """
SELECT DISTINCT word, replace(lower(strip_accents(word)), 'ß', 'ss') AS folded
FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM documents)
"""
SKELETON = f"SELECT word, {skel('word')} AS skel FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"

_LEGAL = _list(N.legal_forms())
_STOPS = _list(N.NAME_STOPS)


def _tokens(x: str) -> str:
    """The adapter's names have no dotted abbreviation but l.l.c. and no script but Latin."""
    words = f"list_filter(string_split(regexp_replace(replace(replace(replace(replace({x}, 'l.l.c', 'llc'), '&', ' and '), '+', ' and '), '''', ''), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w <> 'l')"
    by_skel = f"CASE WHEN length(w) >= 5 THEN element_at({_map(N.LEGAL_SKELETONS)}, {skel('w')})[1] END"
    return f"list_transform({words}, lambda w: coalesce(element_at({_map(N.LEGAL_FORMS)}, w)[1], {by_skel}, w))"


_NAME_CTE = f"""
WITH raw AS (SELECT id, lower(coalesce(business_name, '')) AS s FROM ({A.RECORDS})),
trimmed AS (SELECT id, trim(regexp_replace(regexp_replace(string_split(s, '|')[1], '^\\s*m\\s*/\\s*s\\.?\\s+|\\bm/s\\b', ' ', 'g'), '[0-9]{{7,}}', ' ', 'g'), ' -<>#*~_=.,;:!?"''[](){{}}') AS s FROM raw),
stem AS (SELECT id, s, CASE WHEN contains(s, ' ') THEN '' ELSE regexp_extract(s, '^(?:https?://)?(?:www\\.)?([a-z0-9][a-z0-9\\-]*)\\.(?:com|in|net|org|co|fr|us|biz|info|io)(?:\\.[a-z]{{2}})?/?$', 1) END AS d FROM trimmed),
split AS (SELECT id, CAST(d <> '' AS INT) AS dom, string_split(CASE WHEN d <> '' THEN replace(d, '-', ' ') ELSE s END, 'doing business as') AS p FROM stem),
parts AS (SELECT id, dom, CASE WHEN len(p) > 1 THEN p[1] ELSE '' END AS a, CASE WHEN len(p) > 1 THEN array_to_string(p[2:], ' ') ELSE p[1] END AS s FROM split),
toks AS (SELECT id, dom, {_tokens('s')} AS t, {_tokens('a')} AS alias_words FROM parts),
cores AS (
  SELECT *, list_filter(t, lambda w: NOT list_contains({_LEGAL}, w) AND NOT list_contains({_STOPS}, w)) AS c1, list_filter(t, lambda w: NOT list_contains({_STOPS}, w)) AS c2,
    list_filter(alias_words, lambda w: NOT list_contains({_LEGAL}, w) AND NOT list_contains({_STOPS}, w)) AS ac FROM toks),
words AS (SELECT *, CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 ELSE t END AS c FROM cores),
names AS (
  SELECT id, array_to_string(t, ' ') AS nm, array_to_string(c, ' ') AS core, array_to_string(list_transform(c, lambda w: {skel('w')}), ' ') AS skel,
    array_to_string(ac, ' ') AS alt, array_to_string(list_sort(list_distinct(list_filter(t, lambda w: list_contains({_LEGAL}, w)))), ' ') AS legal, dom, 0 AS nonlat FROM words)
"""
NAMES = _NAME_CTE + "SELECT * FROM names"
NAME_TOKENS = _NAME_CTE + "SELECT id, tok, count(*) AS times FROM (SELECT id, unnest(string_split(nm, ' ')) AS tok FROM names) WHERE tok <> '' GROUP BY ALL"
NAMES_LEGAL = _NAME_CTE + "SELECT legal, count(*) AS records, sum(len(string_split(core, ' ')))::BIGINT AS words FROM names GROUP BY legal"
NAMES_DOMAIN = _NAME_CTE + "SELECT id, core FROM names WHERE dom = 1"
NAMES_ALIAS = _NAME_CTE + "SELECT id, alt, nm FROM names WHERE alt <> ''"

_CODES = f"CASE lower(country) WHEN 'us' THEN {_map({k: P.joined(v) for k, v in P.US_STATES.items()})} ELSE {_map({k: P.joined(v) for k, v in P.INDIA_STATES.items()})} END"
_ADDRESS_CTE = f"""
WITH comps AS (
  SELECT id, country, k, trim(c) AS raw FROM (
    SELECT id, country, unnest(string_split(s, ',')) AS c, unnest(range(1, len(string_split(s, ',')) + 1)) AS k
    FROM (SELECT id, country, regexp_replace(lower(coalesce(business_address, '')), '\\bp\\.?\\s*o\\.?\\s*box\\s*#?\\s*[0-9]+', ' ', 'g') AS s FROM ({A.RECORDS})))),
clean AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(raw, '''', ''), '[./-]', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS c
  FROM comps WHERE raw NOT IN ('', {", ".join(f"'{w}'" for w in P.NULL_LIKE)})),
stated AS (
  SELECT *, c = 'new delhi' AS plain, CASE WHEN c <> 'new delhi' THEN coalesce(element_at({_map(P.state_names())}, c)[1], CASE WHEN regexp_full_match(c, '[a-z0-9][a-z0-9]') AND NOT regexp_full_match(c, '[0-9]+') THEN element_at({_CODES}, c)[1] END) END AS st
  FROM clean WHERE c <> ''),
parts AS (
  SELECT *, CASE WHEN plain THEN [] ELSE list_transform(regexp_extract_all(raw, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) END AS nums,
    CASE WHEN plain THEN string_split(c, ' ') ELSE list_filter(list_transform(list_filter(list_transform(list_filter(string_split(c, ' '), lambda w: NOT regexp_full_match(w, '[0-9]+')),
      lambda w: CASE WHEN NOT regexp_matches(w, '[0-9]') THEN w WHEN length(regexp_replace(w, '[0-9]+', '', 'g')) <= 1 OR list_contains({_list(P.ORDINALS)}, regexp_replace(w, '[0-9]+', '', 'g')) THEN '' ELSE regexp_replace(w, '[0-9]+', '', 'g') END),
      lambda w: w <> ''), lambda w: coalesce(element_at({_map(P.ABBREVIATIONS)}, w)[1], w)), lambda w: NOT list_contains({_list(P.ADDRESS_STOPS)}, w)) END AS words,
    regexp_matches(raw, '^\\W*(?:no\\.?\\s*|#\\s*|h\\.?\\s*no\\.?\\s*)?\\(?[0-9]') AS leads FROM stated),
grouped AS (
  SELECT id, flatten(list(words ORDER BY k) FILTER (st IS NULL)) AS w, flatten(list(nums ORDER BY k) FILTER (st IS NULL)) AS n,
    (list(nums ORDER BY k) FILTER (st IS NULL AND leads AND len(nums) > 0))[1][1] AS lead, (list(words ORDER BY k) FILTER (st IS NULL AND NOT plain AND len(words) > 0 AND len(nums) = 0))[1] AS city,
    list_sort(list_distinct(list(st) FILTER (st IS NOT NULL))) AS st FROM parts GROUP BY id),
addresses AS (
  SELECT r.id, r.country, coalesce(array_to_string(w, ' '), '') AS ad, coalesce(array_to_string(n, ' '), '') AS nums, coalesce(lead, n[1], '') AS pnum, coalesce(array_to_string(g.st, ' '), '') AS st,
    coalesce(array_to_string(g.city, ' '), '') AS city, CAST(trim(coalesce(business_address, '')) = '' AS INT) AS ad_empty FROM ({A.RECORDS}) r LEFT JOIN grouped g USING (id))
"""
ADDRESSES = _ADDRESS_CTE + "SELECT id, ad, nums, pnum, st, city, ad_empty FROM addresses"
ADDRESS_STATES = _ADDRESS_CTE + "SELECT country, st, count(*) AS records FROM addresses GROUP BY ALL"
ADDRESS_WORDS = _ADDRESS_CTE + "SELECT word, count(DISTINCT id) AS records FROM (SELECT id, unnest(string_split(ad, ' ')) AS word FROM addresses) WHERE word <> '' GROUP BY word"
ADDRESS_PRIMARY = _ADDRESS_CTE + "SELECT id, pnum FROM addresses WHERE pnum <> ''"
ADDRESS_NUMBERS = _ADDRESS_CTE + "SELECT id, pnum, number FROM (SELECT id, pnum, unnest(string_split(nums, ' ')) AS number FROM addresses) WHERE number <> ''"

_W = "list_filter(string_split({}, ' '), lambda w: w <> '')"


def _tag(tag: str, col: str, least: int, skeleton: bool = False) -> str:
    return f"list_transform(list_filter({_W.format(col)}, lambda w: length(w) >= {least}), lambda w: '{tag}' || {skel('w') if skeleton else 'w'})"


_CAT = skel("replace(core, ' ', '')")
_BAGS = f"""
WITH r AS MATERIALIZED ({A.SHORT}),
bags AS MATERIALIZED (
  SELECT *, {_CAT} AS cat, list_filter(list_distinct(list_concat(list_concat({_tag('w:', 'core', 2)}, {_tag('k:', 'core', 2, True)}), list_concat(list_concat({_tag('w:', 'alt', 3)}, {_tag('k:', 'alt', 3, True)}), ['c:' || {_CAT}]))), lambda t: length(t) > 2) AS ntok,
    list_distinct(list_concat(list_concat({_tag('a:', 'ad', 3)}, {_tag('d:', 'nums', 1)}), list_concat(
      list_transform(range(1, len({_W.format('ad')})), lambda i: 'b:' || {_W.format('ad')}[i] || '_' || {_W.format('ad')}[i + 1]),
      CASE WHEN pnum = '' THEN [] ELSE list_transform(list_filter({_W.format('ad')}, lambda w: length(w) >= 3), lambda w: 'x:' || pnum || '_' || w) END))) AS atok FROM r),
keys AS (
  SELECT *, CASE WHEN pnum <> '' AND core <> '' THEN core || '|' || pnum END AS key_core_pn, CASE WHEN pnum <> '' AND skel <> '' THEN skel || '|' || pnum END AS key_skel_pn,
    CASE WHEN pnum <> '' AND cat <> '' THEN cat || '|' || pnum END AS key_cat_pn, nullif(core, '') AS key_core, nullif(skel, '') AS key_skel, CASE WHEN length(cat) >= 4 THEN cat END AS key_cat FROM bags)
"""
TOKENS = _BAGS + "SELECT id, unnest(ntok) AS tok FROM bags UNION ALL SELECT id, unnest(atok) FROM bags"
BIGRAMS = _BAGS + "SELECT id, tok FROM (SELECT id, unnest(atok) AS tok FROM bags) WHERE starts_with(tok, 'b:')"
KEYS = _BAGS + "SELECT id, key_core_pn, key_skel_pn, key_cat_pn, key_core, key_skel, key_cat FROM keys"


def _channel(x: str) -> str:
    """CTEs of a channel: vocabulary v, query weights q, index weights s, cosines c."""
    t = f"{x}tok"
    return f""",
n{x} AS (SELECT country, count(*) AS n FROM bags WHERE side = 1 GROUP BY country),
v{x} AS (SELECT country, tok, df, ln(n / df) AS idf FROM (SELECT country, tok, count(*) AS df FROM (SELECT country, unnest({t}) AS tok FROM bags WHERE side = 1) GROUP BY ALL) JOIN n{x} USING (country) WHERE df <= greatest(2000, floor(n * 0.01))),
w{x} AS (SELECT id, side, country, tok, idf, sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS norm FROM (SELECT id, side, country, unnest({t}) AS tok FROM bags) JOIN v{x} USING (country, tok)),
u{x} AS (SELECT id, side, country, tok, CASE WHEN norm > 0 THEN idf / norm ELSE 0 END AS w FROM w{x}),
c{x} AS (SELECT q.id AS qi, s.id AS si, round(sum(q.w * s.w), 9) AS cos FROM u{x} q JOIN u{x} s ON q.country = s.country AND q.tok = s.tok AND q.side <> 1 AND s.side = 1 GROUP BY ALL)"""


VOCABULARY = _BAGS + _channel("n") + " SELECT country, tok, df, round(idf, 6) AS idf FROM vn"
WEIGHTS = _BAGS + _channel("a") + " SELECT id, country, tok, round(w, 6) AS w FROM ua WHERE side <> 1"
TOP_NAME = _BAGS + _channel("n") + " SELECT qi, si, round(cos, 12) AS cos, rk FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, si) - 1 AS rk FROM cn WHERE cos > 1e-6) WHERE rk < 10"
_BOTH = _BAGS + _channel("n") + _channel("a") + """,
both AS (SELECT qi, si, coalesce(cn.cos, 0) AS cos_n, coalesce(ca.cos, 0) AS cos_a FROM cn FULL JOIN ca USING (qi, si)),
scored AS (SELECT *, (cos_n + cos_a) / 2 AS cos_c FROM both)""".replace("both AS", "pair AS").replace("FROM both", "FROM pair")
TOP_BOTH = _BOTH + """ SELECT qi, si, round(cos_n, 12) AS cos_n, round(cos_a, 12) AS cos_a, round(cos_c, 12) AS cos_c, rk
FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos_c DESC, si) - 1 AS rk FROM scored WHERE cos_c > 1e-6) WHERE rk < 15"""
_CAPS = {"core_pn": 50, "skel_pn": 50, "cat_pn": 50, "core": 10, "skel": 10, "cat": 10}
_KEYED = """,
keyed AS (
""" + " UNION ALL ".join(
    f"SELECT q.id AS qi, s.id AS si, '{k}' AS kind FROM keys q JOIN (SELECT *, count(*) OVER (PARTITION BY country, key_{k}) AS held FROM keys WHERE side = 1) s ON q.country = s.country AND q.key_{k} = s.key_{k} AND s.held <= {n} WHERE q.side <> 1"
    for k, n in _CAPS.items()
) + "),\nflags AS (SELECT qi, si, " + ", ".join(f"max(CAST(kind = '{k}' AS INT)) AS kf_{k}" for k in _CAPS) + " FROM keyed GROUP BY qi, si)"
KEY_CANDIDATES = _BAGS + _KEYED + " SELECT * FROM flags"
_FLAG_NAMES = ", ".join(f"coalesce(kf_{k}, 0) AS kf_{k}" for k in _CAPS)
_UNION = _BOTH + _KEYED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos_n DESC, si) - 1 AS a, row_number() OVER (PARTITION BY qi ORDER BY cos_a DESC, si) - 1 AS b, row_number() OVER (PARTITION BY qi ORDER BY cos_c DESC, si) - 1 AS c FROM scored),
cut AS (SELECT qi, si, cos_n, cos_a, cos_c, CASE WHEN a < 10 AND cos_n > 1e-6 THEN a ELSE 99 END AS rk_n, CASE WHEN b < 10 AND cos_a > 1e-6 THEN b ELSE 99 END AS rk_a, CASE WHEN c < 15 AND cos_c > 1e-6 THEN c ELSE 99 END AS rk_c FROM ranked),
cand AS (
  SELECT qi, si, coalesce(cos_n, 0) AS cos_n, coalesce(cos_a, 0) AS cos_a, coalesce(cos_c, 0) AS cos_c, coalesce(rk_n, 99) AS rk_n, coalesce(rk_a, 99) AS rk_a, coalesce(rk_c, 99) AS rk_c, {_FLAG_NAMES}
  FROM cut FULL JOIN flags USING (qi, si) WHERE least(coalesce(rk_n, 99), coalesce(rk_a, 99), coalesce(rk_c, 99)) < 99 OR flags.qi IS NOT NULL)"""
CANDIDATES = _UNION + " SELECT * REPLACE (round(cos_n, 12) AS cos_n, round(cos_a, 12) AS cos_a, round(cos_c, 12) AS cos_c) FROM cand"
STAGE1 = _UNION + """,
f AS (
  SELECT qi, si, cos_n, cos_a, (cos_n + cos_a) / 2 AS cos_c, kf_core_pn + kf_skel_pn + kf_cat_pn + kf_core + kf_skel + kf_cat AS n_keyed, count(*) OVER (PARTITION BY qi) AS n_cand FROM cand),
g AS (
  SELECT *, max(cos_n) OVER q AS qmax_n, max(cos_a) OVER q AS qmax_a, max(cos_c) OVER q AS qmax_c, row_number() OVER (PARTITION BY qi ORDER BY cos_n DESC, si) AS urk_n,
    row_number() OVER (PARTITION BY qi ORDER BY cos_a DESC, si) AS urk_a, row_number() OVER (PARTITION BY qi ORDER BY cos_c DESC, si) AS urk_c FROM f WINDOW q AS (PARTITION BY qi)),
h AS (SELECT *, max(CASE WHEN urk_c = 2 THEN cos_c END) OVER (PARTITION BY qi) AS second FROM g)
SELECT qi, si, round(cos_n, 12) AS cos_n, round(cos_a, 12) AS cos_a, round(cos_c, 12) AS cos_c, n_keyed, n_cand, round(qmax_n, 12) AS qmax_n, round(qmax_a, 12) AS qmax_a, round(qmax_c, 12) AS qmax_c, urk_n, urk_a, urk_c,
  round(qmax_n - cos_n, 12) AS gap_n, round(qmax_a - cos_a, 12) AS gap_a, round(qmax_c - cos_c, 12) AS gap_c,
  round(CASE WHEN urk_c = 1 THEN cos_c - coalesce(second, cos_c) ELSE cos_c - qmax_c END, 12) AS marg_c FROM h"""
CASCADE = f"""
SELECT qi, si, round(p2, 6) AS p2, p1rk, round(max(p2) OVER (PARTITION BY qi), 6) AS p1max, round(sum(p2) OVER (PARTITION BY qi), 6) AS p1sum
FROM (SELECT qi, si, p2, row_number() OVER (PARTITION BY qi ORDER BY p2 DESC, si) AS p1rk FROM ({A.CLAIMS})) WHERE p1rk <= 3
"""
RECALL = f"""
SELECT {", ".join(f"round(avg(CASE WHEN rk < {k} THEN 1.0 ELSE 0.0 END), 9) AS recall_{k}" for k in (1, 3, 6, 10))}
FROM ({A.TRUTH}) t LEFT JOIN (SELECT qi, si, row_number() OVER (PARTITION BY qi ORDER BY p2 DESC, si) - 1 AS rk FROM ({A.CLAIMS}) WHERE p2 > 1e-6) USING (qi, si)
"""

#: Inputs of the pair-feature queries, in SQL that both dialects read.
#: Every part and supplier that meet in an order, by their own keys, each field with words of its own.
STRING_PAIRS = """
SELECT qi, si, CAST(qi * 37 % 9973 AS STRING) AS q_pnum, CAST(si * 91 % 9973 AS STRING) AS s_pnum, q.p_name || ' ' || q.p_type AS q_core, s.p_name AS s_core, q.p_type AS q_city, s.p_type AS s_city,
  translate(q.p_name, 'aeiou', '') AS q_skel, translate(s.p_name, 'aeiou', '') AS s_skel, q.p_name || ' ltd' AS q_nm, s.p_name || ' inc' AS s_nm, CASE WHEN qi % 5 = 0 THEN s.p_type || ' works' ELSE '' END AS q_alt, '' AS s_alt,
  lower(q.p_brand) || ' ' || q.p_type || ' road' AS q_ad, lower(s.p_brand) || ' road ' || s.p_type AS s_ad, CAST(q.p_size AS STRING) || ' ' || CAST(qi % 9 AS STRING) AS q_nums, CAST(s.p_size AS STRING) AS s_nums
FROM (SELECT DISTINCT l_partkey AS qi, l_suppkey AS si FROM lineitem) c JOIN part q ON q.p_partkey = qi JOIN part s ON s.p_partkey = si
"""
_EQ = "CASE WHEN q_{0} = '' OR s_{0} = '' THEN -1 WHEN q_{0} = s_{0} THEN 1 ELSE 0 END AS {0}_eq"
LEVENSHTEIN = f"SELECT qi, si, levenshtein(q_pnum, s_pnum) AS pnum_lev FROM ({STRING_PAIRS})"
JARO_WINKLER = f"SELECT qi, si, round(jaro_winkler_similarity(q_core, s_core), 6) AS n_jw FROM ({STRING_PAIRS})"
#: Indel similarity by a running LCS table: the row of lengths after each letter of the first string.
INDEL = f"""
WITH RECURSIVE pair AS (SELECT DISTINCT q_city AS a, s_city AS b FROM ({STRING_PAIRS})),
lcs(a, b, i, j, prev, cur) AS (
  SELECT a, b, 1, 1, list_transform(range(0, length(b) + 1), lambda x: 0), [0] FROM pair
  UNION ALL
  SELECT a, b, CASE WHEN j > length(b) THEN i + 1 ELSE i END, CASE WHEN j > length(b) THEN 1 ELSE j + 1 END, CASE WHEN j > length(b) THEN cur ELSE prev END,
    CASE WHEN j > length(b) THEN [0] ELSE list_append(cur, CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END) END
  FROM lcs WHERE i <= length(a)),
done AS (SELECT a, b, prev[length(b) + 1] AS n FROM lcs WHERE i > length(a))
SELECT qi, si, round(200.0 * n / (length(a) + length(b)), 6) AS city_ratio FROM ({STRING_PAIRS}) p JOIN done ON a = q_city AND b = s_city
"""
OVERLAP_PAIRS = f"""
SELECT qi, si, CAST(qi % 7 AS STRING) || ' ' || CAST(qi % 3 AS STRING) AS q_nums, CASE WHEN si % 5 = 0 THEN '' ELSE CAST(si % 7 AS STRING) || ' ' || CAST(si % 4 AS STRING) END AS s_nums,
  q_core || ' main road' AS q_ad, s_core || ' road' AS s_ad, q_core, s_core, q_pnum, CASE WHEN si % 6 = 0 THEN '' ELSE s_pnum END AS s_pnum,
  CASE qi % 3 WHEN 0 THEN '' ELSE 'ks' END AS q_st, CASE si % 2 WHEN 0 THEN 'ks' ELSE 'ny' END AS s_st, CASE qi % 2 WHEN 0 THEN 'llc' ELSE '' END AS q_legal, CASE si % 3 WHEN 0 THEN 'llc' ELSE 'inc' END AS s_legal
FROM ({STRING_PAIRS}) p
"""


def _overlap(k: str, a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"len({a}) AS q_n{k}, len({b}) AS s_n{k}, {both} AS {k}_common, round({both} / greatest(len({a}), 1), 6) AS {k}_cq, round({both} / greatest(len({b}), 1), 6) AS {k}_cs"
    )


OVERLAPS = f"""
SELECT qi, si, {_overlap('num', _W.format('q_nums'), _W.format('s_nums'))}, {_overlap('ad', _W.format('q_ad'), _W.format('s_ad'))}, {_overlap('nm', "string_split(q_core, ' ')", "string_split(s_core, ' ')")},
  CAST(string_split(q_core, ' ')[1] = string_split(s_core, ' ')[1] AS INT) AS first_eq, {_EQ.format('pnum')}, {_EQ.format('st')}, {_EQ.format('legal')}, length(s_pnum) AS s_pnum_len
FROM ({OVERLAP_PAIRS})
"""
DIGIT_PAIRS = f"""
SELECT qi, si, CASE WHEN qi % 11 = 0 THEN '' WHEN qi % 13 = 0 THEN '12345678901234' ELSE CAST(qi * 37 % 9973 AS STRING) END AS q_pnum, CASE WHEN si % 7 = 0 THEN '' ELSE CAST(si * 91 % 9973 AS STRING) END AS s_pnum,
  CAST(qi % 5 AS STRING) || ' ' || CAST(si * 91 % 9973 AS STRING) AS q_nums, CASE WHEN si % 4 = 0 THEN '' ELSE CAST(si % 5 AS STRING) || ' ' || CAST(qi * 37 % 9973 AS STRING) || ' x' END AS s_nums
FROM (SELECT DISTINCT l_partkey AS qi, l_suppkey AS si FROM lineitem) c
"""
DIGITS = f"""
WITH p AS (SELECT *, q_pnum <> '' AND s_pnum <> '' AS ok, lpad(left(q_pnum, 10), 10, '_') AS a, lpad(left(s_pnum, 10), 10, '_') AS b, coalesce(try_cast(left(q_pnum, 12) AS BIGINT), -1) AS x, coalesce(try_cast(left(s_pnum, 12) AS BIGINT), -1) AS y FROM ({DIGIT_PAIRS})),
d AS (SELECT *, list_filter(range(0, 10), lambda i: substr(a, (10 - i)::INT, 1) <> substr(b, (10 - i)::INT, 1)) AS places, CASE WHEN ok AND x >= 0 AND y >= 0 THEN abs(x - y)::DOUBLE ELSE -1 END AS df FROM p)
SELECT qi, si, least(df, 1e7) AS pn_absdiff, round(CASE WHEN df >= 0 THEN ln(1 + df) ELSE -1 END, 6) AS pn_logdiff, round(CASE WHEN df >= 0 THEN df / greatest(x, y, 1) ELSE -1 END, 6) AS pn_reldiff,
  CASE WHEN ok THEN CAST(length(q_pnum) = length(s_pnum) AS INT) ELSE -1 END AS pn_samelen, CASE WHEN ok THEN abs(length(q_pnum) - length(s_pnum)) ELSE -1 END AS pn_lendiff, CASE WHEN ok THEN len(places) ELSE -1 END AS pn_hamming,
  CASE WHEN ok THEN coalesce(list_min(places), -1) ELSE -2 END AS pn_lowdiff, CASE WHEN ok THEN coalesce(list_max(places), -1) ELSE -2 END AS pn_highdiff,
  CASE WHEN ok AND len(places) > 0 THEN greatest(length(q_pnum), length(s_pnum)) - 1 - list_max(places) ELSE -1 END AS pn_highdiff_rel,
  CASE WHEN ok THEN CAST(right(a, 1) = right(b, 1) AS INT) ELSE -1 END AS pn_lastdig_eq, CASE WHEN ok THEN CAST(left(q_pnum, 1) = left(s_pnum, 1) AS INT) ELSE -1 END AS pn_firstdig_eq FROM d
"""
MEMBERSHIP = f"""
SELECT qi, si, CASE WHEN q_pnum = '' THEN -1 ELSE CAST(list_contains(string_split(s_nums, ' '), q_pnum) AS INT) END AS pn_q_in_snums, CASE WHEN s_pnum = '' THEN -1 ELSE CAST(list_contains(string_split(q_nums, ' '), s_pnum) AS INT) END AS pn_s_in_qnums,
  least(coalesce(list_min(list_filter(list_transform(string_split(s_nums, ' '), lambda x: abs(try_cast(left(x, 12) AS BIGINT) - try_cast(left(q_pnum, 12) AS BIGINT))), lambda v: v IS NOT NULL)), -1)::DOUBLE, 1e7) AS nums_minabs
FROM ({DIGIT_PAIRS})
"""
DIFFERENCES = _BAGS + _KEYED + f""",
total AS (SELECT count(*) AS n FROM bags WHERE side = 1),
idf AS (SELECT tok, ln(any_value(n) / count(*)) AS idf FROM (SELECT unnest(list_distinct({_W.format('ad')})) AS tok FROM bags WHERE side = 1), total GROUP BY tok),
sides AS (SELECT qi, si, list_distinct({_W.format('q.ad')}) AS a, list_distinct({_W.format('s.ad')}) AS b FROM flags JOIN bags q ON q.id = qi JOIN bags s ON s.id = si),
tagged AS (
  SELECT qi, si, 'q' AS k, unnest(list_filter(a, lambda w: NOT list_contains(b, w))) AS tok FROM sides UNION ALL SELECT qi, si, 's', unnest(list_filter(b, lambda w: NOT list_contains(a, w))) FROM sides
  UNION ALL SELECT qi, si, 'both', unnest(list_intersect(a, b)) FROM sides),
valued AS (SELECT t.*, coalesce(idf, (SELECT ln(n) FROM total)) AS v FROM tagged t LEFT JOIN idf USING (tok))
SELECT qi, si, {", ".join(f"count(v) FILTER (k = '{k}') AS da_{k}, round(coalesce(sum(v) FILTER (k = '{k}'), 0), 6) AS da_{k}_idf, round(coalesce(max(v) FILTER (k = '{k}'), 0), 6) AS da_{k}_max" for k in "qs")},
  round(coalesce(sum(v) FILTER (k = 'both'), 0), 6) AS da_share_idf FROM flags LEFT JOIN valued USING (qi, si) GROUP BY qi, si
"""
AMBIGUITY = _BAGS + _KEYED + """
SELECT qi, si, (SELECT count(*) FROM bags x WHERE x.side = 1 AND x.country = q.country AND x.core = s.core) AS s_core_cnt, (SELECT count(*) FROM bags x WHERE x.side = 1 AND x.country = q.country AND x.skel = s.skel) AS s_skel_cnt,
  (SELECT count(*) FROM bags x WHERE x.side = 1 AND x.country = q.country AND x.core = q.core) AS q_core_cnt, (SELECT count(*) FROM bags x WHERE x.side = 1 AND x.country = q.country AND x.skel = q.skel) AS q_skel_cnt
FROM flags JOIN bags q ON q.id = qi JOIN bags s ON s.id = si
"""

_QCTX = f"""
WITH c AS ({A.CLAIMS}),
r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p2 DESC, si) AS p2rk, max(p2) OVER (PARTITION BY qi) AS q_p2max, sum(p2) OVER (PARTITION BY qi) AS q_p2sum, count(*) OVER (PARTITION BY qi) AS q_n FROM c),
q AS (SELECT *, CASE WHEN p2rk = 1 THEN p2 - coalesce(max(CASE WHEN p2rk = 2 THEN p2 END) OVER (PARTITION BY qi), p2) ELSE p2 - q_p2max END AS q_marg, CAST(p2rk = 1 AND p2 > 0.5 AS INT) AS is_qtop FROM r)
"""
QUERY_CONTEXT = _QCTX + "SELECT qi, si, round(p2, 6) AS p2, p2rk, round(q_p2max, 6) AS q_p2max, round(q_p2sum, 6) AS q_p2sum, q_n, round(q_marg, 6) AS q_marg, is_qtop FROM q"
ENTITY_CONTEXT = _QCTX + """,
e AS (SELECT *, count(*) OVER s AS s_n, sum(p2) OVER s - p2 AS so, row_number() OVER (PARTITION BY si ORDER BY p2 DESC, qi) AS s_srk, sum(is_qtop) OVER s - is_qtop AS nt,
  sum(is_qtop) OVER (PARTITION BY si, src) - is_qtop AS ns, sum(p2 * is_qtop) OVER s - p2 * is_qtop AS ts FROM q WINDOW s AS (PARTITION BY si)),
o AS (SELECT *, max(CASE WHEN s_srk = 1 THEN p2 END) OVER (PARTITION BY si) AS m1, max(CASE WHEN s_srk = 2 THEN p2 END) OVER (PARTITION BY si) AS m2 FROM e)
SELECT qi, si, s_n, round(so, 6) AS s_p2sum_o, s_srk, nt::BIGINT AS s_ntop_o, ns::BIGINT AS s_ntop_same_src_o, round(ts / greatest(nt, 1), 6) AS s_top_p2mean_o,
  round(CASE WHEN s_n = 1 THEN 0 WHEN p2 >= m1 THEN m2 ELSE m1 END, 6) AS s_p2max_o FROM o"""
BEST_OTHER = f"SELECT si, round(max(x), 6) AS most, round(min(x), 6) AS least FROM (SELECT c.si, coalesce((SELECT max(o.p2) FROM ({A.CLAIMS}) o WHERE o.si = c.si AND o.qi <> c.qi), 0) AS x FROM ({A.CLAIMS}) c) GROUP BY si"
_MODE = "SELECT si, {0} AS m FROM (SELECT *, row_number() OVER (PARTITION BY si ORDER BY w DESC, {0}) AS k FROM (SELECT si, {0}, round(sum(p2), 9) AS w FROM c {1} GROUP BY si, {0})) WHERE k = 1"
WEIGHTED_MODE = f"WITH c AS ({A.CLAIM_PAIRS}) SELECT si, m AS pmode FROM ({_MODE.format('q_pnum', '')})"
CONSENSUS = f"""
WITH c AS ({A.CLAIM_PAIRS}), pm AS ({_MODE.format('q_pnum', "WHERE q_pnum <> ''")}), cm AS ({_MODE.format('q_core', '')})
SELECT c.qi, c.si, CASE WHEN q_pnum <> '' THEN count(*) OVER n - 1 ELSE -1 END AS c_pn_same, round(CASE WHEN q_pnum <> '' THEN sum(p2) OVER n - p2 ELSE -1 END, 6) AS c_pn_same_p2,
  count(*) OVER k - 1 AS c_core_same, round(sum(p2) OVER k - p2, 6) AS c_core_same_p2, round(sum(CASE WHEN q_pnum = s_pnum THEN p2 ELSE 0 END) OVER s - CASE WHEN q_pnum = s_pnum THEN p2 ELSE 0 END, 6) AS c_pn_s_agree_p2,
  CASE WHEN q_pnum <> '' THEN CAST(q_pnum = pm.m AS INT) ELSE -1 END AS c_pn_is_mode, CASE WHEN pm.m IS NULL THEN -1 ELSE CAST(pm.m = s_pnum AS INT) END AS c_mode_eq_s1,
  CAST(q_core = cm.m AS INT) AS c_core_is_mode, CAST(cm.m = s_core AS INT) AS c_cmode_eq_s1
FROM c LEFT JOIN pm ON pm.si = c.si LEFT JOIN cm ON cm.si = c.si WINDOW n AS (PARTITION BY c.si, q_pnum), k AS (PARTITION BY c.si, q_core), s AS (PARTITION BY c.si)
"""


def _attribute(a: str) -> str:
    return (
        f"CAST(q_{a} = s_{a} AS INT) AS k_{a}_eq_s1, count(*) OVER (PARTITION BY c.si, q_{a}) - 1 AS k_{a}_same, round(sum(p3) OVER (PARTITION BY c.si, q_{a}) - p3, 6) AS k_{a}_same_p, "
        f"CAST(q_{a} = {a}.m AS INT) AS k_{a}_is_mode, CAST({a}.m = s_{a} AS INT) AS k_{a}_mode_eq_s1"
    )


ATTRIBUTES = f"""
WITH c AS ({A.CLAIM_PAIRS}), legal AS ({_MODE.format('q_legal', '').replace('p2', 'p3')}), city AS ({_MODE.format('q_city', '').replace('p2', 'p3')})
SELECT c.qi, c.si, {_attribute('legal')}, {_attribute('city')} FROM c LEFT JOIN legal ON legal.si = c.si LEFT JOIN city ON city.si = c.si
"""
PEERS = f"""
WITH c AS ({A.CLAIMS}), top AS (SELECT si, qi AS pq, p3 AS pp FROM (SELECT *, row_number() OVER (PARTITION BY si ORDER BY p3 DESC, qi) AS k FROM c WHERE p3 >= 0.2) WHERE k <= 4)
SELECT qi, si, pq, round(pp, 6) AS pp FROM (SELECT c.qi, c.si, pq, pp, row_number() OVER (PARTITION BY c.qi, c.si ORDER BY pp DESC, pq) AS k FROM c JOIN top ON top.si = c.si AND pq <> qi WHERE p3 >= 0.01) WHERE k <= 3
"""
_BEST = f"WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p2 DESC, si) AS rnk FROM ({A.CLAIM_PAIRS})) WHERE rnk = 1)"
ASSIGN = _BEST + " SELECT si, qi FROM best WHERE p2 > 0.7"


def _expected(where: str = "true") -> str:
    return f""",
b AS (SELECT qi, si, p2 AS p FROM best WHERE p2 > 0.05 AND {where}),
x AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (PARTITION BY si ORDER BY p DESC, qi ROWS UNBOUNDED PRECEDING) AS ctp, sum(p) OVER (PARTITION BY si) AS total,
  exp(sum(CASE WHEN p >= 1 THEN '-infinity'::DOUBLE ELSE ln(1 - p) END) OVER (PARTITION BY si)) AS p0 FROM b WINDOW o AS (PARTITION BY si ORDER BY p DESC, qi)),
ef AS (SELECT *, round(1.25 * ctp / (0.25 * total + k), 12) AS ef FROM x),
pick AS (SELECT si, k AS kstar FROM (SELECT si, k, ef, p0, row_number() OVER (PARTITION BY si ORDER BY ef DESC, k) AS r FROM ef) WHERE r = 1 AND ef > p0)"""


EXPECTED_F = _BEST + _expected() + " SELECT ef.si, qi FROM ef JOIN pick USING (si) WHERE k <= kstar"
_F05 = "CASE WHEN nt = 0 THEN CAST(np = 0 AS DOUBLE) WHEN np = 0 OR tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END"
_ENTITIES = f"""
SELECT u.si, thr, count(b.qi)::DOUBLE AS np, count(t.qi)::DOUBLE AS tp, (SELECT count(*) FROM ({A.TRUTH}) z WHERE z.si = u.si)::DOUBLE AS nt
FROM ({A.UNIVERSE}) u CROSS JOIN (SELECT unnest({{thr}}) AS thr) LEFT JOIN best b ON b.si = u.si AND b.p2 > thr LEFT JOIN ({A.TRUTH}) t ON t.si = b.si AND t.qi = b.qi GROUP BY u.si, thr
"""
MACRO_F05 = _BEST + f" SELECT round(avg({_F05}), 9) AS macro_f05, count(*) AS entities FROM ({_ENTITIES.format(thr='[0.7::DOUBLE]')})"
SWEEP = _BEST + f" SELECT thr, round(avg({_F05}), 9) AS macro_f05 FROM ({_ENTITIES.format(thr='[' + ', '.join(f'{t}::DOUBLE' for t in D.THRESHOLDS) + ']')}) GROUP BY thr"


def _band(edges: list[float], op: str) -> str:
    return "CAST(" + " + ".join(f"CAST(p2 {op} CAST({e} AS DOUBLE) AS INT)" for e in edges) + " AS INT)"


_B = _band(D.BANDS, ">")
_TABLE = f""",
tr AS (SELECT {_B} AS b, count(*) AS n_tr, sum(y) AS pos_tr FROM best WHERE qi % 2 = 0 GROUP BY 1), te AS (SELECT {_B} AS b, count(*) AS n_te FROM best WHERE qi % 2 = 1 GROUP BY 1),
t AS (SELECT b, coalesce(n_tr, 0) AS n_tr, coalesce(pos_tr, 0) AS pos_tr, coalesce(n_te, 0) AS n_te FROM tr FULL JOIN te USING (b)),
e AS (SELECT coalesce(max(CASE WHEN b = 18 AND n_tr > 0 AND pos_tr > 0 THEN n_te * (pos_tr / n_tr) / (pos_tr / 5000) END), 0) AS e FROM t),
z AS (SELECT t.*, pos_tr / 5000 * e AS pos_te, CASE WHEN n_tr > 0 THEN pos_tr / n_tr END AS prec_tr FROM t, e),
bands AS (SELECT *, max(least(1, CASE WHEN n_te > 0 THEN pos_te / n_te WHEN pos_te > 0 THEN 1 ELSE 0 END)) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS prec_te FROM z)"""
BANDS = _BEST + _TABLE + " SELECT b, n_tr, pos_tr::BIGINT AS pos_tr, n_te, round(pos_te, 6) AS pos_te, round(prec_tr, 6) AS prec_tr, round(prec_te, 6) AS prec_te FROM bands"
CALIBRATED = _BEST + _TABLE + f" SELECT qi, si, round(coalesce(prec_te, 0), 6) AS pc FROM (SELECT qi, si, {_B} AS b FROM best WHERE qi % 2 = 1) LEFT JOIN bands USING (b)"
_STRATUM = "CASE WHEN q_pnum = '' OR s_pnum = '' THEN 'miss' WHEN abs(q_pnum::BIGINT - s_pnum::BIGINT) = 0 THEN 'eq' WHEN abs(q_pnum::BIGINT - s_pnum::BIGINT) <= 30 THEN 'small' ELSE 'big' END || CASE WHEN q_core = s_core THEN '|name=' ELSE '|name~' END"
STRATA = _BEST + f""",
s AS (SELECT *, {_STRATUM} AS stratum, {_B} AS b FROM (SELECT * REPLACE (nullif(s_pnum, '') AS s_pnum) FROM best)),
s2 AS (SELECT * REPLACE (CASE WHEN s_pnum IS NULL THEN CASE WHEN q_core = s_core THEN 'miss|name=' ELSE 'miss|name~' END ELSE stratum END AS stratum) FROM s),
tr AS (SELECT stratum, b, count(*) AS n_tr, sum(y) AS pos_tr FROM s2 WHERE qi % 2 = 0 GROUP BY ALL), te AS (SELECT stratum, b, count(*) AS n_te FROM s2 WHERE qi % 2 = 1 GROUP BY ALL),
t AS (SELECT stratum, b, coalesce(n_tr, 0) AS n_tr, coalesce(pos_tr, 0) AS pos_tr, coalesce(n_te, 0) AS n_te, coalesce(pos_tr, 0) / 5000 * 4000.0::DOUBLE AS pos_te FROM tr FULL JOIN te USING (stratum, b))
SELECT stratum, b, n_tr, pos_tr::BIGINT AS pos_tr, n_te, round(pos_te, 6) AS pos_te, round(CASE WHEN n_tr > 0 THEN pos_tr / n_tr ELSE 0 END, 6) AS prec_tr,
  round(max(least(1, CASE WHEN n_te > 0 THEN pos_te / n_te WHEN pos_te > 0 THEN 1 ELSE 0 END)) OVER (PARTITION BY stratum ORDER BY b ROWS UNBOUNDED PRECEDING), 6) AS prec_te FROM t
"""
_OFFSET = f"coalesce(abs(try_cast(q_pnum AS BIGINT) - try_cast(s_pnum AS BIGINT)), -1)"
_GRP = f"CASE WHEN {_OFFSET} IN ({', '.join(map(str, D.TWIN_OFFSETS))}) THEN 'twin' ELSE 'other' END"
OFFSETS = _BEST + f" SELECT qi, si, {_OFFSET} AS d, {_GRP} AS grp FROM best"
_GB = _band(D.GATE_BANDS, ">=")
GATE = _BEST + f""",
g AS (SELECT *, {_GRP} AS grp, {_GB} AS b FROM best),
tr AS (SELECT grp, b, sum(y) / 100 AS true_per_s1, avg(y) AS prec_tr, count(*) AS n_tr FROM g WHERE qi % 2 = 0 GROUP BY ALL), te AS (SELECT grp, b, count(*) / 100 AS te_per_s1, count(*) AS n_te FROM g WHERE qi % 2 = 1 GROUP BY ALL),
t AS (SELECT grp, b, coalesce(true_per_s1, 0) AS tp, coalesce(prec_tr, 0) AS prec_tr, coalesce(n_tr, 0) AS n_tr, coalesce(te_per_s1, 0) AS ts, coalesce(n_te, 0) AS n_te FROM tr FULL JOIN te USING (grp, b))
SELECT grp, b, round(tp, 6) AS true_per_s1, round(prec_tr, 6) AS prec_tr, n_tr, round(ts, 6) AS te_per_s1, n_te, round(CASE WHEN ts > 0 THEN least(1, tp / ts) WHEN tp > 0 THEN 1 ELSE 0 END, 6) AS prec_te,
  ([{', '.join(f'{x}::DOUBLE' for x in [0.0, *D.GATE_BANDS])}])[b + 1] AS lo FROM t
"""
GATED = _BEST + _expected() + f" SELECT ef.si, ef.qi FROM ef JOIN pick USING (si) JOIN best ON best.qi = ef.qi WHERE k <= kstar AND NOT ({_GRP} = 'twin' AND p <= 0.9)"
BLEND = f"WITH c AS ({A.CLAIMS}) SELECT qi, si, round(CASE WHEN si % 3 <> 0 THEN 0.5::DOUBLE * p2 + 0.5::DOUBLE * p3 ELSE p2 END, 6) AS pb FROM c"
FOLDS = f"SELECT CAST(qi % 2 AS INT) AS fold, count(*) AS claims, count(DISTINCT qi) AS queries FROM ({A.CLAIMS}) GROUP BY 1"
#: A result table with planted faults of every kind.
RESULT_ROWS = """
SELECT 'S1-' || CAST(s_suppkey AS STRING) AS source1_entity_id,
  CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'S2-1,S2-1' WHEN 2 THEN 'S2-' || CAST(s_suppkey AS STRING) || ',S1-' || CAST(s_suppkey AS STRING) WHEN 3 THEN 'X9-7,S2-99999999' ELSE 'S2-' || CAST(s_suppkey AS STRING) END AS matched_entity_ids
FROM supplier WHERE s_suppkey % 10 <> 4
UNION ALL SELECT 'S1-' || CAST(s_suppkey AS STRING), '' FROM supplier WHERE s_suppkey % 10 = 5
UNION ALL SELECT 'S1-x' || CAST(s_suppkey AS STRING), '' FROM supplier WHERE s_suppkey % 25 = 1
"""
VALIDATE = f"""
WITH r AS ({RESULT_ROWS}), l AS (SELECT source1_entity_id AS s, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS ids FROM r), e AS (SELECT DISTINCT unnest(ids) AS id FROM l),
req AS (SELECT 'S1-' || s_suppkey AS s FROM supplier), known AS (SELECT DISTINCT 'S2-' || l_orderkey AS id FROM lineitem)
SELECT 'duplicate_row' AS rule, s AS offender FROM l GROUP BY s HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'repeated_id', s FROM l WHERE len(ids) <> len(list_distinct(ids))
UNION ALL SELECT 'self_match', id FROM e WHERE starts_with(id, 'S1-')
UNION ALL SELECT 'wrong_prefix', id FROM e WHERE NOT regexp_matches(id, '^S[123]-')
UNION ALL SELECT 'unknown_id', id FROM e WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT id FROM known)
UNION ALL SELECT 'missing', s FROM req WHERE s NOT IN (SELECT s FROM l)
UNION ALL SELECT DISTINCT 'extra', s FROM l WHERE s NOT IN (SELECT s FROM req)
"""
STREAM = _BAGS + " SELECT q.id AS qi, s.id AS si FROM keys q JOIN keys s ON s.side = 1 AND q.side <> 1 AND q.country = s.country AND q.key_core = s.key_core WHERE (SELECT count(*) FROM keys x WHERE x.side = 1 AND x.country = s.country AND x.key_core = s.key_core) <= 10"
