"""DuckDB SQL of the file metrics, written relationally: an independent check."""

from __future__ import annotations

from ..functions import text as X
from ..functions import vocab
from ..operators import metrics as M


def _words(ws) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


#: Spark's patterns, with word edges as RE2 has them (ASCII).
def _re(p: str) -> str:
    return p.replace(X.EDGE_L, r"\b").replace(X.EDGE_R, r"\b").replace("'", "''")


def count(text: str, p: str) -> str:
    return f"len(regexp_extract_all({text}, '{_re(p)}'))"


R = "round({}, 4) + 0.0"
TRIM = r"regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"

PRELUDE = f"""
f AS (SELECT concat(coalesce(source, '-'), '/', doc_id) AS path, coalesce(text, '') AS content, source AS snapshot FROM documents),
tok AS (SELECT path, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT path, regexp_extract_all(content, '{X.TOKEN}') AS t FROM f)),
tc AS (SELECT path, t, count(*) AS c FROM tok GROUP BY ALL),
tn AS (SELECT path, sum(c)::BIGINT AS n, count(*) AS v FROM tc GROUP BY ALL),
w AS (SELECT * FROM (SELECT path, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS no FROM (SELECT path, regexp_extract_all(content, '{X.RUN}') AS t FROM f)) WHERE regexp_matches(w, '^[a-zA-Z_]')),
ids AS (SELECT path, w, row_number() OVER (PARTITION BY path ORDER BY no) AS pos FROM w WHERE w NOT IN {_words(vocab.KEYWORDS)}),
ln AS (SELECT path, unnest(s) AS l, unnest(range(1, len(s) + 1)) AS no FROM
  (SELECT path, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS s FROM (SELECT path, string_split(content, chr(10)) AS s FROM f))),
nb AS (SELECT * FROM ln WHERE regexp_matches(l, '{X.VISIBLE}')),
lc AS (SELECT f.path, count(ln.path) AS n, count(ln.path) FILTER (regexp_matches(l, '{X.VISIBLE}')) AS nb FROM f LEFT JOIN ln USING (path) GROUP BY ALL)
"""

_DEPTH = r"""depth AS (SELECT path, max(s - least(0, m)) AS d FROM (SELECT path, pos, s, min(s) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS m FROM
  (SELECT path, pos, sum(CASE WHEN t IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM tok WHERE t IN ('(', '[', '{', ')', ']', '}'))) GROUP BY path)"""


def _ols(points: str) -> str:
    """CTEs: sums and the line of each path over `points` (path, x, y)."""
    return f"""pts AS ({points}),
sums AS (SELECT path, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM pts GROUP BY path),
fit AS (SELECT path, n, sy / n AS my, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope, (sy - (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) * sx) / n AS b FROM sums),
r AS (SELECT path, any_value(n) AS n, any_value(slope) AS slope, any_value(b) AS b, 1 - sum((y - slope * x - b) ** 2) / (sum((y - my) ** 2) + 1e-10) AS r2 FROM pts JOIN fit USING (path) GROUP BY path)"""


def _zero(expr: str, name: str) -> str:
    return f"coalesce({expr}, 0.0) AS {name}"


def _div(a: str, b: str) -> str:
    return f"coalesce(round(({a})::DOUBLE / nullif({b}, 0), 4) + 0.0, 0.0)"


def _hs(counts: str, n: str) -> str:
    return f"-sum({counts} / {n} * log2({counts} / {n}))"


_CTES: dict[str, tuple[str, str]] = {
    "entropy": (
        """bc AS (SELECT path, b, count(*)::DOUBLE AS c FROM (SELECT path, unnest(regexp_extract_all(hex(encode(content)), '[0-9A-F]{2}')) AS b FROM f) GROUP BY ALL),
        be AS (SELECT path, -sum(c / n * log2(c / n)) AS h, count(*) AS v FROM (SELECT *, sum(c) OVER (PARTITION BY path) AS n FROM bc) GROUP BY path),
        te AS (SELECT path, -sum(c / n * log2(c / n)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY path) AS n FROM tc) GROUP BY path)""",
        """SELECT path, coalesce(round(be.h, 4) + 0.0, 0.0) AS char_entropy, CASE WHEN be.v > 1 THEN round(log2(be.v), 4) ELSE 0.0 END AS char_max_entropy,
        CASE WHEN be.v > 1 THEN round(be.h / log2(be.v), 4) ELSE 0.0 END AS char_normalized, coalesce(round(te.h, 4) + 0.0, 0.0) AS token_entropy,
        CASE WHEN tn.v > 1 THEN round(log2(tn.v), 4) ELSE 0.0 END AS token_max_entropy, CASE WHEN tn.v > 1 THEN round(te.h / log2(tn.v), 4) ELSE 0.0 END AS token_normalized,
        coalesce(tn.v, 0) AS vocab_size, coalesce(tn.n, 0) AS total_tokens FROM f LEFT JOIN be USING (path) LEFT JOIN te USING (path) LEFT JOIN tn USING (path)""",
    ),
    "unique_lines": (
        "u AS (SELECT path, count(DISTINCT l) AS d, count(*) AS n FROM nb GROUP BY path)",
        f"SELECT path, strlen(content)::BIGINT AS raw_bytes, {_div('d', 'n')} AS unique_line_ratio FROM f LEFT JOIN u USING (path)",
    ),
    "zipf": (
        _ols("SELECT path, ln(row_number() OVER (PARTITION BY path ORDER BY c DESC)) AS x, ln(c) AS y FROM tc"),
        """SELECT path, CASE WHEN coalesce(tn.v, 0) < 3 THEN 0.0 ELSE round(-slope, 4) + 0.0 END AS exponent, CASE WHEN coalesce(tn.v, 0) < 3 THEN 0.0 ELSE round(r2, 4) + 0.0 END AS r_squared,
        coalesce(tn.v, 0) AS vocab_size, coalesce(tn.n, 0) AS total_tokens FROM f LEFT JOIN r USING (path) LEFT JOIN tn USING (path)""",
    ),
    "heaps": (
        """fresh AS (SELECT path, pos, sum((k = 1)::INT) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d FROM (SELECT path, pos, row_number() OVER (PARTITION BY path, t ORDER BY pos) AS k FROM tok)),
        """
        + _ols("SELECT path, ln(pos) AS x, ln(d) AS y FROM fresh JOIN tn USING (path) WHERE pos % greatest(1, n // 50) = 0"),
        "SELECT path, " + ", ".join(f"CASE WHEN coalesce(r.n, 0) < 5 THEN 0.0 ELSE round({e}, 4) + 0.0 END AS {k}" for e, k in (("exp(b)", "k"), ("slope", "beta"), ("r2", "r_squared"))) + " FROM f LEFT JOIN r USING (path)",
    ),
    "vocabulary": (
        """ic AS (SELECT path, count(*) AS n, count(DISTINCT w) AS d FROM ids GROUP BY path),
        prev AS (SELECT path, pos, coalesce(lag(pos) OVER (PARTITION BY path, w ORDER BY pos), 0) AS p FROM ids),
        vw AS (SELECT path, array_to_string(list_sort(list(DISTINCT w)), ' ') AS vw FROM w GROUP BY path),
        mv AS (SELECT path, sum(greatest(0, least(pos, n - 99) - greatest(p + 1, pos - 99, 1) + 1)) / (n - 99.0) / 100 AS m FROM prev JOIN ic USING (path) WHERE n >= 100 GROUP BY path, n)""",
        f"""SELECT path, {_div('d', 'n')} AS raw_ttr, CASE WHEN n >= 100 THEN round(m, 4) ELSE {_div('d', 'n')} END AS mattr, coalesce(d, 0) AS unique_identifiers, coalesce(n, 0) AS total_identifiers, coalesce(vw, '') AS vocabulary
        FROM f LEFT JOIN ic USING (path) LEFT JOIN mv USING (path) LEFT JOIN vw USING (path)""",
    ),
    "lexical_concentration": (
        "s AS (SELECT path, sum(c * c)::DOUBLE AS q FROM tc GROUP BY path)",
        """SELECT path, CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE round((q - n) * 10000 / (n::DOUBLE * n), 4) + 0.0 END AS yule_k,
        CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE round((q - n) / (n::DOUBLE * (n - 1)), 4) + 0.0 END AS simpson_d, coalesce(n, 0) AS total_tokens FROM f LEFT JOIN s USING (path) LEFT JOIN tn USING (path)""",
    ),
    "renyi_entropy": (
        """p AS (SELECT path, count(*) AS v, -sum(c / n * log2(c / n)) AS h1, -log2(sum((c / n) * (c / n))) AS h2, -log2(max(c / n)) AS hi FROM (SELECT path, c::DOUBLE AS c, sum(c) OVER (PARTITION BY path)::DOUBLE AS n FROM tc) GROUP BY path)""",
        """SELECT path, coalesce(round(log2(v), 4), 0.0) AS renyi_0, coalesce(round(h1, 4) + 0.0, 0.0) AS renyi_1, coalesce(round(h2, 4) + 0.0, 0.0) AS renyi_2, coalesce(round(hi, 4) + 0.0, 0.0) AS renyi_inf,
        coalesce(round(2 ** h1, 4), 0.0) AS hill_1, coalesce(round(2 ** h2, 4), 0.0) AS hill_2, coalesce(round(log2(v) - h2, 4) + 0.0, 0.0) AS spectrum_slope FROM f LEFT JOIN p USING (path)""",
    ),
    "lexical_density": (
        f"n AS (SELECT path, count(*) FILTER (regexp_matches(t, '^[0-9]')) AS k FROM tok GROUP BY path), i AS (SELECT path, count(*) AS i FROM ids GROUP BY path)",
        f"""SELECT path, {_div('c', 'n')} AS lexical_density, c AS content_tokens, n - c AS function_tokens FROM (SELECT f.path, coalesce(tn.n, 0) AS n, least(coalesce(i, 0) + coalesce(k, 0), coalesce(tn.n, 0)) AS c
        FROM f LEFT JOIN n USING (path) LEFT JOIN i USING (path) LEFT JOIN tn USING (path))""",
    ),
    "casing_entropy": (
        """st AS (SELECT path, CASE WHEN regexp_matches(w, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal_case' WHEN regexp_matches(w, '^[a-z][a-z0-9]*([A-Z][a-zA-Z0-9]*)+$') THEN 'camel_case'
          WHEN regexp_matches(w, '^[a-z]+(_[a-z0-9]+)*$') THEN 'snake_case' WHEN regexp_matches(w, '^[A-Z]+(_[A-Z0-9]+)*$') THEN 'macro_case' WHEN regexp_matches(w, '^[a-z]+(-[a-z0-9]+)*$') THEN 'kebab_case' ELSE 'other' END AS s FROM ids),
        sc0 AS (SELECT path, s, count(*)::DOUBLE AS c FROM st GROUP BY path, s), sc AS (SELECT *, sum(c) OVER (PARTITION BY path) AS n FROM sc0),
        e AS (SELECT path, round(-sum(c / n * log2(c / n)), 4) + 0.0 AS h, any_value(n) AS n, """
        + ", ".join(f"max(CASE WHEN s = '{s}' THEN c END)::BIGINT AS {s}_count" for s in M.STYLES)
        + " FROM sc GROUP BY path)",
        f"SELECT path, coalesce(h, 0.0) AS entropy, {_div('coalesce(macro_case_count, 0)', 'n')} AS screaming_snake_density, " + ", ".join(f"{s}_count" for s in M.STYLES) + " FROM f LEFT JOIN e USING (path)",
    ),
    "identifier_length_variance": (
        "i AS (SELECT path, avg(length(w)) AS m, (count(*) * sum(length(w) ** 2) - sum(length(w)) ** 2) / count(*) ** 2 AS v, sqrt((count(*) * sum(length(w) ** 2) - sum(length(w)) ** 2) / count(*) ** 2) AS s, max(length(w)) AS x FROM ids GROUP BY path)",
        "SELECT path, coalesce(round(m, 4), 0.0) AS mean, coalesce(round(v, 4) + 0.0, 0.0) AS variance, coalesce(round(s, 4) + 0.0, 0.0) AS std_dev, coalesce(x, 0)::BIGINT AS max FROM f LEFT JOIN i USING (path)",
    ),
    "indentation": (
        r"i AS (SELECT path, avg(d) AS m, (count(*) * sum(d ** 2) - sum(d) ** 2) / count(*) ** 2 AS v, max(d) AS x FROM (SELECT path, length(regexp_extract(l, '^(\s*)', 1)) AS d FROM nb) GROUP BY path), u AS (SELECT path, bool_or(starts_with(l, chr(9))) AS tabs FROM ln GROUP BY path)",
        f"""SELECT path, coalesce(round(m, 4) + 0.0, 0.0) AS mean_depth, coalesce(round(v, 4) + 0.0, 0.0) AS variance, coalesce(x, 0)::BIGINT AS max_depth, coalesce(tabs, false) AS uses_tabs,
        {_div('lc.n - lc.nb', 'lc.n')} AS blank_line_ratio FROM f LEFT JOIN i USING (path) LEFT JOIN u USING (path) JOIN lc USING (path)""",
    ),
    "branching": (
        _DEPTH + f", b AS (SELECT path, count(*) AS c FROM tok WHERE t IN {_words(vocab.BRANCHING)} GROUP BY path)",
        f"SELECT path, {_div('coalesce(c, 0)', 'lc.nb')} AS branching_density, coalesce(c, 0) AS branch_count, lc.nb AS non_blank_count, coalesce(greatest(d, 0), 0)::BIGINT AS max_nesting_depth FROM f JOIN lc USING (path) LEFT JOIN b USING (path) LEFT JOIN depth USING (path)",
    ),
    "magic_number_density": (
        "m AS (SELECT path, len(list_filter(regexp_extract_all(content, '" + _re(M.NUMBER) + "'), lambda x: x NOT IN " + _words(M.PLAIN_NUMBERS) + ")) AS k, " + count("content", r'"(?:[^"\\]|\\[^\n])*"') + " AS s FROM f)",
        f"SELECT path, {_div('k', 'n')} AS density, CASE WHEN n > 0 THEN k ELSE 0 END::BIGINT AS magic_number_count, {_div('s', 'n')} AS string_literal_ratio FROM f JOIN m USING (path) LEFT JOIN tn USING (path)",
    ),
    "symbol_density": (
        r"s AS (SELECT path, regexp_extract_all(content, '[^\p{L}\p{N}_\s\p{Z}]') AS s FROM f)",
        f"SELECT path, {_div('len(s)', 'length(content)')} AS density, len(s)::BIGINT AS symbol_count, len(list_distinct(s))::BIGINT AS distinct_symbol_types FROM f JOIN s USING (path)",
    ),
    "vowel_density": (
        "v AS (SELECT path, sum(len(regexp_extract_all(w, '[aeiouyAEIOUY]'))) AS k, sum(length(w)) AS n FROM ids GROUP BY path)",
        f"SELECT path, {_div('k', 'n')} AS density, coalesce(k, 0)::BIGINT AS vowel_count, coalesce(n, 0)::BIGINT AS total_chars FROM f LEFT JOIN v USING (path)",
    ),
    "brevity": (
        _ols("SELECT path, ln(length(t)) AS x, ln(c) AS y FROM tc")
        + ", co AS (SELECT path, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM (SELECT path, length(t)::DOUBLE AS x, c::DOUBLE AS y FROM tc) GROUP BY path)",
        """SELECT path, CASE WHEN coalesce(tn.v, 0) < 3 THEN 0.0 ELSE coalesce(round((co.n * sxy - sx * sy) / nullif(sqrt(greatest((co.n * sxx - sx * sx) * (co.n * syy - sy * sy), 0)), 0), 4) + 0.0, 0.0) END AS correlation,
        CASE WHEN coalesce(tn.v, 0) < 3 OR co.n * sxx = sx * sx THEN 0.0 ELSE coalesce(round(slope, 4) + 0.0, 0.0) END AS slope, coalesce(tn.v, 0) AS sample_size FROM f LEFT JOIN r USING (path) LEFT JOIN co USING (path) LEFT JOIN tn USING (path)""",
    ),
    "separator_counts": (
        "",
        "SELECT path, " + ", ".join(f"len(regexp_extract_all(content, '{p}'))::BIGINT AS {k}" for k, p in (("underscore_count", "_"), ("hyphen_count", "-"), ("slash_count", "/"), ("dot_count", r"\."))) + " FROM f",
    ),
    "comment_structure": (
        r"k AS (SELECT path, count(*) FILTER (regexp_matches(l, '^\s*(?:#|//|/\*|\*)')) AS c FROM nb GROUP BY path)",
        f"SELECT path, {_div('coalesce(c, 0)', 'nb')} AS comment_line_ratio, coalesce(c, 0) AS comment_line_count, {count('content', X.EDGE_L + '(?:TODO|FIXME|HACK|XXX)' + X.EDGE_R)}::BIGINT AS todo_fixme_count FROM f JOIN lc USING (path) LEFT JOIN k USING (path)",
    ),
    "line_patterns": (
        _DEPTH + f", u AS (SELECT path, count(DISTINCT {TRIM}) AS d, count(*) AS n FROM nb GROUP BY path)",
        f"""SELECT path, {_div('lc.n - lc.nb', 'lc.n')} AS blank_line_ratio, coalesce(round(u.d::DOUBLE / u.n, 4), 1.0) AS unique_line_ratio, coalesce(greatest(depth.d, 0), 0)::BIGINT AS max_nesting_depth,
        {_div(count('content', '"[^"]*"|' + "'[^']*'"), 'tn.n')} AS string_literal_ratio FROM f JOIN lc USING (path) LEFT JOIN u USING (path) LEFT JOIN depth USING (path) LEFT JOIN tn USING (path)""",
    ),
    "readability": (
        f"""l AS (SELECT path, count(*) AS n, avg(length(l)) AS a FROM nb WHERE NOT starts_with({TRIM}, '#') GROUP BY path),
        sw AS (SELECT path, avg(s) AS s, avg((s > 2)::INT) AS h FROM (SELECT path, len(list_filter(string_split(regexp_replace(w, '([a-z])([A-Z])', '\\1_\\2', 'g'), '_'), lambda x: x <> '')) AS s FROM w) GROUP BY path),
        q AS (SELECT f.path, l.n, a, coalesce(tn.n, 0) / l.n AS t, coalesce(s, 0) AS s, coalesce(h, 0) AS h FROM f JOIN l USING (path) LEFT JOIN tn USING (path) LEFT JOIN sw USING (path))""",
        "SELECT path, "
        + ", ".join(
            f"coalesce(round({e}, 4) + 0.0, 0.0) AS {k}"
            for e, k in (("t", "avg_tokens_per_line"), ("a", "avg_line_length"), ("s", "avg_sub_words_per_id"), ("206.835 - 1.015 * t - 84.6 * s", "flesch_adapted"), ("0.4 * (t + 100 * h)", "fog_adapted"))
        )
        + ", coalesce(n, 0) AS total_lines FROM f LEFT JOIN q USING (path)",
    ),
    "halstead": (
        f"""o AS (SELECT path, unnest(regexp_extract_all(trim(content), '{_re(M.OPERATOR)}')) AS x FROM f), a AS (SELECT path, x FROM (SELECT path, unnest(regexp_extract_all(content, '{_re(M.OPERAND)}')) AS x FROM f) WHERE x NOT IN {_words(vocab.OPERATOR_WORDS)}),
        h AS (SELECT f.path, coalesce(o1, 0) AS o1, coalesce(a1, 0) AS a1, coalesce(o2, 0) AS o2, coalesce(a2, 0) AS a2 FROM f LEFT JOIN (SELECT path, count(DISTINCT x) AS o1, count(*) AS o2 FROM o GROUP BY path) USING (path) LEFT JOIN (SELECT path, count(DISTINCT x) AS a1, count(*) AS a2 FROM a GROUP BY path) USING (path)),
        v AS (SELECT *, CASE WHEN o1 + a1 > 1 THEN (o2 + a2) * log2(o1 + a1) ELSE 0.0 END AS vol, CASE WHEN o1 + a1 > 1 AND a1 > 0 THEN o1 / 2 * (a2 / a1) ELSE 0.0 END AS dif FROM h)""",
        """SELECT path, o1 AS n1_unique_operators, a1 AS n2_unique_operands, o2 AS N1_total_operators, a2 AS N2_total_operands, o1 + a1 AS vocabulary, o2 + a2 AS length, round(vol, 4) + 0.0 AS volume, round(dif, 4) + 0.0 AS difficulty,
        round(dif * vol, 4) + 0.0 AS effort, round(vol / 3000, 4) + 0.0 AS estimated_bugs, CASE WHEN o1 + a1 <> 1 THEN round(dif * vol / 18, 4) + 0.0 END AS time_to_implement_seconds FROM v""",
    ),
    "rfc": (
        f"""p AS (SELECT path, t, lead(t) OVER (PARTITION BY path ORDER BY pos) AS u FROM tok),
        q AS (SELECT path, count(*) FILTER (t IN {_words(vocab.FUNCTION_WORDS)} AND regexp_matches(u, '^[a-zA-Z_]')) AS d, count(DISTINCT CASE WHEN regexp_matches(t, '^[a-zA-Z_]') AND u = '(' THEN t END) AS c FROM p GROUP BY path)""",
        f"SELECT path, coalesce(d + c, 0) AS rfc_count, {_div('d + c', 'lc.n')} AS rfc_density, coalesce(d, 0) AS function_def_count, coalesce(c, 0) AS distinct_call_count FROM f JOIN lc USING (path) LEFT JOIN q USING (path)",
    ),
    "bradford": (
        """lt AS (SELECT path, no, len(regexp_extract_all(l, '""" + X.TOKEN + """')) AS c FROM ln),
        cu AS (SELECT path, c, row_number() OVER o AS k, sum(c) OVER (PARTITION BY path ORDER BY c DESC, no ROWS UNBOUNDED PRECEDING) AS s, sum(c) OVER (PARTITION BY path) AS n, count(*) OVER (PARTITION BY path) AS m FROM lt WHERE c > 0 WINDOW o AS (PARTITION BY path ORDER BY c DESC, no)),
        z1 AS (SELECT path, min(k) AS n1, min(s) AS s1 FROM cu WHERE s >= n / 3.0 GROUP BY path),
        z2 AS (SELECT cu.path, any_value(m) AS m, any_value(n) AS n, any_value(n1) AS n1, coalesce(min(k) FILTER (k > n1 AND s - s1 >= n / 3.0), any_value(m)) - any_value(n1) AS n2 FROM cu JOIN z1 USING (path) GROUP BY cu.path),
        kk AS (SELECT path, m, n, round(n2 / n1, 4) AS k1, CASE WHEN n2 > 0 THEN round((m - n1 - n2) / n2, 4) ELSE 0.0 END AS k2 FROM z2)""",
        "SELECT path, CASE WHEN m >= 3 AND n >= 3 THEN k1 ELSE 0.0 END AS k1, CASE WHEN m >= 3 AND n >= 3 THEN k2 ELSE 0.0 END AS k2, CASE WHEN m >= 3 AND n >= 3 AND k1 > 0 THEN round(k2 / k1, 4) ELSE 0.0 END AS k_ratio FROM f LEFT JOIN kk USING (path)",
    ),
    "conditional_entropy": (
        """p AS (SELECT path, t, lead(t) OVER (PARTITION BY path ORDER BY pos) AS u FROM tok),
        pc AS (SELECT path, t, u, count(*)::DOUBLE AS c FROM p WHERE u IS NOT NULL GROUP BY ALL),
        h AS (SELECT path, -sum(c / n * log2(c / v)) AS h, count(DISTINCT u) AS s FROM (SELECT *, sum(c) OVER (PARTITION BY path, t) AS v, sum(c) OVER (PARTITION BY path) AS n FROM pc) GROUP BY path)""",
        """SELECT path, coalesce(round(abs(h), 4) + 0.0, 0.0) AS conditional_entropy, coalesce(round(2 ** abs(h), 4), 1.0) AS perplexity, CASE WHEN s > 1 THEN round(abs(h) / log2(s), 4) + 0.0 ELSE 0.0 END AS normalized_conditional_entropy FROM f LEFT JOIN h USING (path)""",
    ),
    "function_metrics": (
        f"""fn AS (SELECT path, no, l FROM ln WHERE regexp_matches(l, '{_re(M.DEFINITION)}') OR regexp_matches(l, '{_re(M.METHOD)}')),
        g AS (SELECT path, coalesce(lead(no) OVER (PARTITION BY path ORDER BY no), lc.n + 1) - no AS len, trim(regexp_extract(l, '\\(([^)]*)\\)', 1)) AS args FROM fn JOIN lc USING (path)),
        a AS (SELECT path, count(*) AS n, avg(len) AS al, max(len) AS ml, avg(k) AS ap, max(k) AS mp FROM (SELECT *, CASE WHEN args = '' THEN 0 ELSE len(regexp_extract_all(args, ',')) + 1 END AS k FROM g) GROUP BY path)""",
        "SELECT path, coalesce(n, 0) AS function_count, coalesce(round(al, 4), 0.0) AS avg_function_lines, coalesce(ml, 0)::BIGINT AS max_function_lines, coalesce(round(ap, 4), 0.0) AS avg_param_count, coalesce(mp, 0)::BIGINT AS max_param_count FROM f LEFT JOIN a USING (path)",
    ),
    "punctuation_density": (
        "",
        "SELECT path, "
        + ", ".join(f"coalesce(round({count('content', p)} / nullif(length(content), 0), 6), 0.0) AS {k}" for p, k in ((r"\?", "question_mark_density"), ("!", "exclamation_density")))
        + ", "
        + ", ".join(
            f"{count('content', p)}::BIGINT AS {k}"
            for p, k in ((r"\.", "dot_count"), (r"[^A-Za-z0-9_\s(\[{][(\[{]", "bracket_nonalpha_prefix_count"), (r"[)\]}][^A-Za-z0-9_\s)\]}]", "bracket_nonalpha_suffix_count"), (r"[(\[][0-9][0-9_]*(?:\.[0-9]+)?[)\]]", "bracket_number_pair_count"))
        )
        + ", "
        + ", ".join(
            f"round({count('content', p)} / greatest(coalesce(n, 0), 1), 4) AS {k}"
            for p, k in ((r"[a-zA-Z_][A-Za-z0-9_]*[^A-Za-z0-9_\s]", "id_nonalpha_suffix_density"), ("->|=>", "arrow_density"), ("[a-zA-Z_][A-Za-z0-9_]*:", "colon_suffix_density"))
        )
        + " FROM f LEFT JOIN tn USING (path)",
    ),
}


def _ngram() -> tuple[str, str]:
    ctes, cols, joins = ["g AS (SELECT path, t, lead(t) OVER o AS u, lead(t, 2) OVER o AS v FROM tok WINDOW o AS (PARTITION BY path ORDER BY pos))"], [], ""
    for name, keys in (("bigram", "t, u"), ("trigram", "t, u, v")):
        last = keys[-1]
        ctes.append(f"{name} AS (SELECT path, sum(c) AS n, count(*) AS d, coalesce(sum(c) FILTER (c > 1), 0) AS r, count(*) FILTER (c = 1) AS h, count(*) FILTER (c > 1) AS u FROM (SELECT path, {keys}, count(*) AS c FROM g WHERE {last} IS NOT NULL GROUP BY ALL) GROUP BY path)")
        a = name
        cols.append(
            f"coalesce({a}.n, 0)::BIGINT AS {name}_total, coalesce({a}.d, 0) AS {name}_unique, {_div(f'{a}.r', f'{a}.n')} AS {name}_repetition_rate, {_div(f'{a}.h', f'{a}.d')} AS {name}_hapax_fraction, coalesce({a}.u, 0) AS {name}_repeated_unique"
        )
        joins += f" LEFT JOIN {name} USING (path)"
    return ", ".join(ctes), f"SELECT path, {', '.join(cols)} FROM f{joins}"


_CTES["ngram"] = _ngram()


def _mtld() -> tuple[str, str]:
    """A fold over a file's identifiers, forwards and backwards: the words of the run, its
    length, the number of runs."""
    state = "{{'w': '', 's': []::VARCHAR[], 'n': 0, 'k': 0}}"
    again = "list_contains(a.s, b.w)"
    step = (
        f"CASE WHEN (len(a.s) + CASE WHEN {again} THEN 0 ELSE 1 END) / (a.n + 1) <= 0.72 THEN {{'w': '', 's': []::VARCHAR[], 'n': 0, 'k': a.k + 1}} "
        f"ELSE {{'w': '', 's': CASE WHEN {again} THEN a.s ELSE list_append(a.s, b.w) END, 'n': a.n + 1, 'k': a.k}} END"
    )
    item = "{'w': w, 's': []::VARCHAR[], 'n': 0, 'k': 0}"
    ctes = [
        f"{name} AS (SELECT path, t, r.k + CASE WHEN r.n > 0 THEN (1 - len(r.s) / r.n) / (1 - 0.72) ELSE 0 END AS k FROM (SELECT path, count(*) AS t, list_reduce(list({item} ORDER BY pos {way}), lambda a, b: {step}, {state.format()}) AS r FROM ids GROUP BY path))"
        for name, way in (("fw", "ASC"), ("bw", "DESC"))
    ]
    of = lambda x: f"coalesce(CASE WHEN {x}.k > 0 THEN {x}.t / {x}.k ELSE {x}.t END, 0.0)"
    return ", ".join(ctes), f"SELECT path, round({of('fw')}, 4) AS mtld_forward, round({of('bw')}, 4) AS mtld_backward, round(({of('fw')} + {of('bw')}) / 2, 4) AS mtld FROM f LEFT JOIN fw USING (path) LEFT JOIN bw USING (path)"


_CTES["mtld"] = _mtld()


def _unreachable() -> tuple[str, str]:
    """A fold over the visible lines: terminal statements, dead lines, and the indent of
    the terminal that is in force, or -1."""
    step = """CASE WHEN a.at >= 0 AND NOT (b.i < a.at OR (b.i <= a.at AND b.b)) THEN {'i': 0, 'b': false, 't': false, 's': false, 'n': a.n, 'u': a.u + 1, 'at': a.at}
      ELSE {'i': 0, 'b': false, 't': false, 's': false, 'n': a.n + (b.t OR b.s)::INT, 'u': a.u, 'at': CASE WHEN b.t THEN b.i ELSE -1 END} END"""
    opened, closed = (f"len(regexp_extract_all(l, '{p}'))" for p in (r"[(\[{]", r"[}\])]"))
    item = f"""{{'i': length(regexp_extract(l, '^(\\s*)', 1)), 'b': regexp_matches(l, '{_re(M.BOUNDARY)}'), 't': regexp_matches(l, '{_re(M.TERMINAL)}') AND {opened} <= {closed},
      's': NOT regexp_matches(l, '{_re(M.TERMINAL)}') AND regexp_matches(l, '{_re(M.INLINE)}'), 'n': 0, 'u': 0, 'at': -1}}"""
    first = "{'i': 0::BIGINT, 'b': false, 't': false, 's': false, 'n': 0, 'u': 0, 'at': -1::BIGINT}"
    ctes = f"k AS (SELECT path, list_reduce(list({item} ORDER BY no), lambda a, b: {step}, {first}) AS r FROM nb GROUP BY path)"
    return ctes, f"SELECT path, {_div('r.u', 'lc.nb')} AS unreachable_after_terminal_ratio, coalesce(r.n, 0)::BIGINT AS terminal_statement_count, coalesce(r.u, 0)::BIGINT AS unreachable_line_count FROM f JOIN lc USING (path) LEFT JOIN k USING (path)"


_CTES["unreachable_code"] = _unreachable()


def sql(name: str) -> str:
    ctes, body = _CTES[name]
    return f"WITH {PRELUDE}{',' + ctes if ctes else ''}\n{body}"


def all_sql() -> dict[str, str]:
    return {f"m_{n}": sql(n) for n in _CTES}


#: The standard metrics; of `compression` what needs no deflate.
STANDARD = [n for n in ["unique_lines", *M.standard()] if n in _CTES]


def long_form(names: list[str] = STANDARD) -> str:
    """CTEs that end in fm (path, snapshot, metric, key, value) over these metrics."""
    parts, union = [PRELUDE], []
    for n in names:
        ctes, body = _CTES[n]
        parts.append(f"x_{n} AS ({f'WITH {ctes} {body}' if ctes else body})")
        left = {"indentation": "path, uses_tabs", "vocabulary": "path, vocabulary"}.get(n, "path")
        union.append(f"SELECT path, '{"compression" if n == "unique_lines" else n}' AS metric, key, value FROM (UNPIVOT (SELECT path, COLUMNS(* EXCLUDE ({left}))::DOUBLE FROM x_{n}) ON COLUMNS(* EXCLUDE (path)) INTO NAME key VALUE value)")
    parts.append("fm0 AS (" + " UNION ALL ".join(union) + ")")
    parts.append("fm AS (SELECT fm0.*, snapshot FROM fm0 JOIN f USING (path))")
    return ", ".join(parts)
