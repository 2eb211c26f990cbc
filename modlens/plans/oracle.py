"""The same results as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from modlens.functions import patterns as P
from modlens.functions import wordlists as W
from modlens.functions.scores import LEXICAL, READABILITY
from modlens.operators.pos import POS, SUFFIX_TAGS

RATIO_LEX = ("avg_word_len", "avg_sentence_len", "type_token_ratio")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(q(w) for w in items) + ")"


def rx(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"


def half_up(x: str, places: int) -> str:
    return f"(floor(({x}) * {10**places} + sign({x}) * 0.5::DOUBLE) / {10**places}::DOUBLE)"


def split_spaces(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {q(P.SPACES)}), lambda t: t <> '')"


def fused(expr: str) -> str:
    for pattern, replacement in P.FUSED:
        expr = rx(expr, pattern, replacement)
    return expr


def treebank(expr: str) -> str:
    """Commas and colons before digits are hidden behind control characters while marks are split off."""
    s = P.SPACE
    expr = rx(expr, r"\.\.\.", " ... ")
    expr = rx(rx(expr, ",([0-9])", "\x01\\1"), ":([0-9])", "\x02\\1")
    expr = rx(expr, r"([;@#$%&?!()\[\]{}<>\":,])", r" \1 ")
    expr = f"replace(replace({expr}, '\x01', ','), '\x02', ':')"
    expr = rx(expr, rf"([^.{s}])\.('*)([{s}]|$)", r"\1 . \2\3")
    expr = rx(expr, "--", " -- ")
    expr = rx(
        expr,
        rf"([^'{s}])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'s|'S|'m|'M|'d|'D|')([{s}]|$)",
        r"\1 \2 ",
    )
    return split_spaces(fused(expr))


def lemma(w: str) -> str:
    nouns, cut = words(W.NOUNS), lambda k: f"left({w}, length({w}) - {k})"
    known = lambda cond, cand: f"CASE WHEN {cond} AND {cand} IN {nouns} THEN {cand} END"
    rules = [
        known(f"regexp_matches({w}, '(s|x|z|ch|sh)es$')", cut(2)),
        known(f"ends_with({w}, 'ves')", f"({cut(3)} || 'f')"),
        known(f"ends_with({w}, 'ies')", f"({cut(3)} || 'y')"),
        known(f"ends_with({w}, 's')", cut(1)),
        known(f"ends_with({w}, 'men')", f"({cut(3)} || 'man')"),
        "CASE " + w + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in W.NOUN_EXCEPTIONS.items()) + " END",
    ]
    return f"coalesce({', '.join(rules)}, {w})"


def kept_tokens(text: str = "text") -> str:
    """Cleaned tokens before lemmatising."""
    expr = rx(rx(f"lower(coalesce({text}, ''))", P.URL), P.MENTION)
    tokens = split_spaces(fused(rx(expr, P.PUNCT)))
    return f"list_filter({tokens}, lambda t: t NOT IN {words(W.STOP_WORDS)})"


def clean(text: str = "text") -> str:
    return f"array_to_string(list_transform({kept_tokens(text)}, lambda w: {lemma('w')}), ' ')"


CLEAN = f"cleaned AS (SELECT doc_id, {clean()} AS clean FROM documents)"
WORDS = f"words AS (SELECT doc_id, regexp_extract_all(lower(clean), {q(P.WORD2)}) AS ws FROM cleaned)"


def grams(high: int) -> str:
    parts = ["SELECT doc_id, w1 AS term FROM seq"]
    for n in range(2, high + 1):
        joined = " || ' ' || ".join(f"w{k}" for k in range(1, n + 1))
        parts.append(f"SELECT doc_id, {joined} FROM seq WHERE w{n} IS NOT NULL")
    lead = "".join(f", lead(w, {n - 1}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{n}" for n in range(2, high + 1))
    return (
        "flat AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM words), "
        f"seq AS (SELECT doc_id, w AS w1{lead} FROM flat), "
        "grams AS (" + " UNION ALL ".join(parts) + ")"
    )


def frequency(high: int = 1, source: str = "") -> str:
    where = f" WHERE doc_id IN (SELECT doc_id FROM {source})" if source else ""
    return (
        f"{grams(high)}, freq AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM grams{where} GROUP BY term)"
    )


def vocab(limit: int, min_df: int, max_df: float, size: str = "SELECT count(*) FROM documents") -> str:
    return (
        f"picked AS (SELECT * FROM freq WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * ({size}) "
        f"ORDER BY tf DESC, term LIMIT {limit}), "
        f"vocab AS (SELECT term, df, tf, row_number() OVER (ORDER BY term) - 1 AS idx, "
        f"ln((1.0::DOUBLE + ({size})) / (1 + df)) + 1 AS idf FROM picked)"
    )


LABELLED = "labelled AS (SELECT d.doc_id, d.text, l.toxic, l.quality FROM documents d JOIN labels l USING (doc_id))"


def lexical(source: str, text: str = "text", extra: str = "") -> str:
    """CTEs ending in ``lex`` with the ten measures."""
    return f"""
lex0 AS (SELECT doc_id{extra}, coalesce({text}, '') AS t,
    list_filter({treebank(f"coalesce({text}, '')")}, lambda w: regexp_full_match(w, '\\p{{L}}+')) AS ws FROM {source}),
lex1 AS (SELECT *, len(ws) AS n, len(regexp_extract_all(t, '[.!?]+')) + 1 AS sents,
    len(list_distinct(ws)) AS uniq FROM lex0),
lex AS (SELECT doc_id{extra}, length(t) AS char_count, n AS word_count, uniq AS unique_word_count,
    CASE WHEN t = '' THEN 0 ELSE sents END AS sentence_count,
    CASE WHEN n = 0 THEN 0 ELSE length(array_to_string(ws, ''))::DOUBLE / n END AS avg_word_len,
    n::DOUBLE / sents AS avg_sentence_len,
    length(t) - length({rx('t', P.PUNCT)}) AS punctuation_count,
    len(regexp_extract_all(t, '\\p{{Lu}}')) AS uppercase_count,
    len(regexp_extract_all(t, '\\p{{Nd}}')) AS digit_count,
    CASE WHEN n = 0 THEN 0 ELSE uniq::DOUBLE / n END AS type_token_ratio FROM lex1)"""


def cast_lex(col: str) -> str:
    return f"{r6(col)} AS {col}" if col in RATIO_LEX else f"{col}::BIGINT AS {col}"


LEX_SELECT = ", ".join(cast_lex(c) for c in LEXICAL)
LEX_LABELLED = f"WITH {LABELLED}, {lexical('labelled', extra=', toxic, quality')}"
LEX_LONG = (
    LEX_LABELLED
    + ", long AS (SELECT doc_id, toxic, quality, feature, value FROM (SELECT doc_id, toxic, quality, "
    + ", ".join(f"{c}::DOUBLE AS {c}" for c in LEXICAL)
    + f" FROM lex) UNPIVOT (value FOR feature IN ({', '.join(LEXICAL)})))"
)


def syllable_list(ws: str) -> str:
    v = P.VOWELS
    silent = rf"(?:([^l{v} ])e|([^td{v} ])ed|([^szxchg{v} ])es)( |$)"
    e = rx(f"array_to_string({ws}, ' ')", silent, r"\1\2\3\4")
    e = rx(rx(e, f"[{v}]+", "*"), "[^* ]")
    return f"list_transform(string_split({e}, ' '), lambda g: greatest(1, length(g)))"


def readability(source: str) -> str:
    per100 = lambda x: half_up(f"{half_up(f'({x}::DOUBLE / w)', 2)} * 100", 2)
    ps, pw = half_up("(w::DOUBLE / s)", 1), half_up("(syl::DOUBLE / w)", 1)
    values = {
        "flesch_ease": half_up(f"206.835::DOUBLE - {ps} * 1.015::DOUBLE - {pw} * 84.6::DOUBLE", 2),
        "fk_grade": half_up(f"{ps} * 0.39::DOUBLE + {pw} * 11.8::DOUBLE - 15.59::DOUBLE", 1),
        "smog": f"CASE WHEN s < 3 THEN 0 ELSE {half_up('sqrt((poly * 30)::DOUBLE / s) * 1.043::DOUBLE + 3.1291::DOUBLE', 1)} END",
        "coleman_liau": half_up(f"{per100('lt')} * 0.058::DOUBLE - {per100('s')} * 0.296::DOUBLE - 15.8::DOUBLE", 2),
        "ari": half_up(
            f"{half_up('(c::DOUBLE / w)', 2)} * 4.71::DOUBLE + {half_up('(w::DOUBLE / s)', 2)} * 0.5::DOUBLE - 21.43::DOUBLE", 1
        ),
    }
    picked = ", ".join(
        f"CASE WHEN trimmed >= 10 AND w > 0 THEN {r6(v)} ELSE 0 END AS {k}" for k, v in values.items()
    )
    return f"""
rd0 AS (SELECT doc_id, coalesce(text, '') AS t, {rx("lower(coalesce(text, ''))", P.PUNCT)} AS plain FROM {source}),
rd1 AS (SELECT *, {split_spaces('plain')} AS ws FROM rd0),
rd2 AS (SELECT *, {syllable_list('ws')} AS sy FROM rd1),
rd3 AS (SELECT doc_id, length(trim(t, ' ')) AS trimmed, len(ws) AS w,
    greatest(1, len(list_filter(regexp_extract_all(t, '[^.!?]+[.!?]*'), lambda c: len({split_spaces('c')}) > 2))) AS s,
    length({rx('t', P.SPACES)}) AS c, length({rx('plain', P.SPACES)}) AS lt,
    list_sum(sy) AS syl, len(list_filter(sy, lambda x: x >= 3)) AS poly FROM rd2),
rd AS (SELECT doc_id, {picked} FROM rd3)"""


def caps(t: str) -> str:
    return f"({t} <> lower({t}) AND {t} = upper({t}))"


def sentiment(source: str, id_col: str = "doc_id") -> str:
    boosters = {*W.BOOST_UP, *W.BOOST_DOWN}
    values = ", ".join(f"({q(w)}, {v}::DOUBLE)" for w, v in W.VALENCE.items() if w not in boosters)
    inner = q(P.PUNCT_CHARS)
    steps, prev = [], "s0"
    for k, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        low = f"lower(p{k})"
        boost = f"CASE WHEN {low} IN {words(W.BOOST_UP)} THEN {W.BOOST} WHEN {low} IN {words(W.BOOST_DOWN)} THEN -{W.BOOST} END"
        step = f"coalesce((({boost})::DOUBLE + CASE WHEN {caps(f'p{k}')} AND mixed THEN {W.CAPS} ELSE 0 END::DOUBLE) * {weight}::DOUBLE, 0)"
        negated = f"({low} IN {words(W.NEGATIONS)} OR contains({low}, 'n''t'))"
        steps.append(
            f"s{k} AS (SELECT * REPLACE (CASE WHEN p{k} IS NULL OR {low} IN (SELECT word FROM val) THEN v "
            f"ELSE (v + CASE WHEN v > 0 THEN {step} ELSE -{step} END) * CASE WHEN {negated} THEN {W.NEGATION} ELSE 1 END::DOUBLE END AS v) FROM {prev})"
        )
        prev = f"s{k}"
    return f"""
val(word, valence) AS (VALUES {values}),
sb AS (SELECT {id_col}, coalesce(text, '') AS t,
    list_transform(list_filter({split_spaces("coalesce(text, '')")}, lambda x: length(x) > 1),
        lambda x: CASE WHEN length(trim(x, {inner})) > 1 THEN trim(x, {inner}) ELSE x END) AS toks FROM {source}),
sd AS (SELECT {id_col}, toks, len(toks) AS n,
    least(len(regexp_extract_all(t, '!')), 4) * 0.292::DOUBLE
      + CASE WHEN len(regexp_extract_all(t, '\\?')) > 3 THEN 0.96 WHEN len(regexp_extract_all(t, '\\?')) > 1
          THEN len(regexp_extract_all(t, '\\?')) * 0.18 ELSE 0 END::DOUBLE AS e,
    len(list_filter(toks, lambda x: {caps('x')})) AS nc,
    list_position(list_transform(toks, lambda x: lower(x)), 'but') - 1 AS but_at FROM sb),
st AS (SELECT {id_col}, (nc > 0 AND nc < n) AS mixed, but_at, unnest(toks) AS tok, unnest(range(0, n)) AS pos FROM sd),
sw AS (SELECT *, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3 FROM st
    WINDOW w AS (PARTITION BY {id_col} ORDER BY pos)),
s0 AS (SELECT sw.*, valence + CASE WHEN {caps('tok')} AND mixed THEN sign(valence) * {W.CAPS} ELSE 0 END::DOUBLE AS v
    FROM sw JOIN val ON lower(tok) = word),
{', '.join(steps)},
s4 AS (SELECT {id_col}, v * CASE WHEN lower(p1) = 'least' AND coalesce(lower(p2), '') NOT IN ('at', 'very') THEN {W.NEGATION} ELSE 1 END::DOUBLE
    * CASE WHEN but_at >= 0 AND pos < but_at THEN 0.5 WHEN but_at >= 0 AND pos > but_at THEN 1.5 ELSE 1 END::DOUBLE AS v FROM s3),
s5 AS (SELECT {id_col}, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS up,
    sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS down, count(*) FILTER (v <> 0) AS rated FROM s4 GROUP BY {id_col}),
s6 AS (SELECT sd.{id_col}, n, e, round(coalesce(s, 0), 6) AS s, round(coalesce(up, 0), 6) AS up,
    round(coalesce(down, 0), 6) AS down, coalesce(rated, 0) AS rated FROM sd LEFT JOIN s5 USING ({id_col})),
s7 AS (SELECT *, s + CASE WHEN s > 0 THEN e WHEN s < 0 THEN -e ELSE 0 END AS total,
    up + CASE WHEN up > down THEN e ELSE 0 END AS su, down + CASE WHEN up < down THEN e ELSE 0 END AS sdn FROM s6),
senti AS (SELECT {id_col},
    CASE WHEN su + sdn + n - rated = 0 THEN 0 ELSE round(su / (su + sdn + n - rated), 3) END AS sent_pos,
    CASE WHEN su + sdn + n - rated = 0 THEN 0 ELSE round(sdn / (su + sdn + n - rated), 3) END AS sent_neg,
    CASE WHEN su + sdn + n - rated = 0 THEN 0 ELSE round((n - rated) / (su + sdn + n - rated), 3) END AS sent_neu,
    round(total / sqrt(total * total + {W.NORMALISER}), 4) AS sent_compound FROM s7)"""


def suffix_tag(w: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({w}, {q(p)}) THEN {q(t)}" for p, t in SUFFIX_TAGS) + " ELSE 'NN' END"


TAG_VALUES = ", ".join(f"({q(w)}, {q(t)})" for t, ws in W.TAGS.items() for w in ws)
TAGGED = f"""
tags(word, tag) AS (VALUES {TAG_VALUES}),
toks AS (SELECT doc_id, lower(unnest({treebank("coalesce(text, '')")})) AS word FROM documents),
tagged AS (SELECT doc_id, toks.word, coalesce(tag, {suffix_tag('toks.word')}) AS tag FROM toks LEFT JOIN tags ON toks.word = tags.word)"""
POS_SELECT = ", ".join(
    f"{r6(f'coalesce(count(*) FILTER (tag IN {words(W.TAG_CATEGORIES[c])})::DOUBLE / nullif(count(word), 0), 0)')} AS pos_{c}"
    for c in POS
)
POS_TABLE = f"pt AS (SELECT d.doc_id, {POS_SELECT} FROM documents d LEFT JOIN tagged t USING (doc_id) GROUP BY d.doc_id)"


def uniform(key: str) -> str:
    return f"(('0x' || {key})::BIGINT / 4294967296.0::DOUBLE)"


def ranked(source: str, strata: str = "", seed: str = "42", id_col: str = "doc_id") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    order = f"ORDER BY md5({id_col}::VARCHAR || '|{seed}'), {id_col}"
    return (
        f"ranked AS (SELECT *, row_number() OVER ({part}{order}) AS rn, count(*) OVER ({part.strip()}) AS n FROM {source})"
    )


SCORES = f"""
WITH {LABELLED},
ct AS (SELECT doc_id, toxic AS label, regexp_extract_all(lower(text), {q(P.WORD2)}) AS ws FROM labelled),
cn AS (SELECT doc_id, label, len(ws)::DOUBLE AS n, len(list_filter(ws, lambda w: w IN {words(W.ABUSE_TERMS)}))::DOUBLE AS hits FROM ct),
scores AS (
  SELECT 'lexicon' AS model, doc_id, label, least(1.0::DOUBLE, hits / 3) AS p FROM cn UNION ALL
  SELECT 'density', doc_id, label, least(1.0::DOUBLE, CASE WHEN n = 0 THEN 0 ELSE hits * 20 / n END) FROM cn UNION ALL
  SELECT 'brevity', doc_id, label, 1.0::DOUBLE / (n / 100 + 1) FROM cn)"""


def counts(threshold: str = "0.5", name: str = "c") -> str:
    t = f"{threshold}::DOUBLE" if threshold[0].isdigit() else threshold
    return (
        f"{name} AS (SELECT model, count(*) FILTER (p >= {t} AND label = 1) AS tp, count(*) FILTER (p >= {t} AND label = 0) AS fp, "
        f"count(*) FILTER (p < {t} AND label = 1) AS fn, count(*) FILTER (p < {t} AND label = 0) AS tn FROM scores GROUP BY model)"
    )


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


AUC = """
rk AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY p)
    + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM scores),
auc AS (SELECT model, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM rk GROUP BY model)"""
METRICS = f"""{SCORES}, {counts()}, {AUC},
metrics AS (SELECT model, {div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {div('2 * tp', '2 * tp + fp + fn')} AS f1, roc_auc
    FROM c JOIN auc USING (model))"""


def report(name: str = "c") -> str:
    f = lambda tp, fp, fn: div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    return f"""
k AS (SELECT model, '0' AS class, {div('tn', 'tn + fn')} AS precision, {div('tn', 'tn + fp')} AS recall, {f('tn', 'fn', 'fp')} AS f1, tn + fp AS support FROM {name}
  UNION ALL SELECT model, '1', {div('tp', 'tp + fp')}, {div('tp', 'tp + fn')}, {f('tp', 'fp', 'fn')}, tp + fn FROM {name}),
report AS (SELECT * FROM k
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM k GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM k GROUP BY model
  UNION ALL SELECT model, 'accuracy', a, a, a, n FROM (SELECT model, {div('tp + tn', 'tp + fp + fn + tn')} AS a, tp + fp + fn + tn AS n FROM {name}))"""


CURVE = """
pts AS (SELECT s.model, s.p, count(*) FILTER (t.p >= s.p AND t.label = 1) AS tp, count(*) FILTER (t.p >= s.p AND t.label = 0) AS fp,
    count(*) FILTER (t.label = 1) AS pos, count(*) FILTER (t.label = 0) AS neg
  FROM (SELECT DISTINCT model, p FROM scores) s JOIN scores t ON s.model = t.model GROUP BY s.model, s.p),
pr AS (SELECT model, p AS threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / pos AS recall FROM pts
  UNION ALL SELECT DISTINCT model, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM scores)"""
BEST = """
f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9::DOUBLE) AS f1 FROM pr),
best AS (SELECT model, coalesce(threshold, 0.5) AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model
    ORDER BY f1 DESC, coalesce(threshold, 9)) AS rn FROM f) WHERE rn = 1)"""
SWEEP = f"""
ts AS (SELECT (10 + 5 * i) / 100.0::DOUBLE AS threshold FROM range(12) r(i)),
sc AS (SELECT model, threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold AND label = 0) AS fp,
    count(*) FILTER (p < threshold AND label = 1) AS fn FROM scores, ts GROUP BY model, threshold),
sweep AS (SELECT model, threshold, {div('2 * tp', '2 * tp + fp + fn')} AS f1, {div('tp', 'tp + fp')} AS precision,
    {div('tp', 'tp + fn')} AS recall, fp AS false_positives, fn AS false_negatives FROM sc)"""

VECTORS = """
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (label = 0)::INT AS y FROM embeddings)"""


def nearest(k: int, queries: str, candidates: str = "TRUE", name: str = "nn") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT a.id AS query_id, b.id AS neighbour_id, b.y AS ny, list_distance(a.x, b.x) AS dist,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank
  FROM vec a JOIN vec b ON a.id <> b.id WHERE {queries} AND {candidates}) WHERE rank <= {k})"""


SIZES = "sz AS (SELECT count(*) FILTER (y = 0) AS maj, count(*) FILTER (y = 1) AS mino FROM vec)"
SHARES = "shares AS (SELECT query_id AS id, count(*) FILTER (ny = 0) AS majority, count(*) AS k FROM nn GROUP BY query_id)"


def undersample(ratio: float) -> str:
    return (
        f"WITH {VECTORS}, {ranked('vec', 'y', id_col='id')}, {SIZES} SELECT id, y FROM ranked, sz "
        f"WHERE y = 1 OR rn <= floor(mino / {ratio}::DOUBLE)"
    )


def k2_sql(n: str, g1: str, g2: str) -> str:
    """CTE columns of the normality test, step by step."""
    return f"""
m1 AS (SELECT feature, {n} AS n, {g1} AS g1, {g2} AS g2 FROM mom),
m2 AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
    3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta, 3*(n-1)/(n+1) AS ex,
    24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS va,
    6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS b FROM m1),
m3 AS (SELECT *, sqrt(2*(beta-1))-1 AS w2, 6+8/b*(2/b+sqrt(1+4/(b*b))) AS a, (g2+3-ex)/sqrt(va) AS x FROM m2),
m4 AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) AS z1,
    ((1-2/(9*a)) - cbrt((1-2/a)/(1+x*sqrt(2/(a-4)))))/sqrt(2/(9*a)) AS z2 FROM m3),
m5 AS (SELECT feature, z1*z1+z2*z2 AS k2 FROM m4)"""


def porter(source: str) -> str:
    """Stems of the words of ``source (word)`` as a chain of steps ending in ``stems (word, stem)``."""
    from modlens.functions.stemming import STEP2, STEP3, STEP4

    vowel = "ch IN ('a','e','i','o','u') OR (ch = 'y' AND right(acc, 1) = 'c')"
    shape = f"list_reduce(list_prepend('', string_split(w, '')), lambda acc, ch: acc || CASE WHEN {vowel} THEN 'v' ELSE 'c' END)"
    cut = lambda k: f"left(w, length(w) - {k})"
    part = lambda k: f"left(shape, length(shape) - {k})"
    measure = lambda k: f"len(regexp_extract_all({part(k)}, 'v+c'))"
    short = lambda k: f"({part(k)} LIKE '%cvc' AND right({cut(k)}, 1) NOT IN ('w', 'x', 'y'))"
    ends = lambda *suffixes: "(" + " OR ".join(f"w LIKE '%{x}'" for x in suffixes) + ")"

    def longest(table, then) -> str:
        order = sorted(table, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN {ends(x)} THEN {then(x)}" for x in order) + " ELSE w END"

    def replaced(table):
        return longest(table, lambda x: f"CASE WHEN {measure(len(x))} > 0 THEN {cut(len(x))} || '{table[x]}' ELSE w END")

    def dropped(x: str) -> str:
        k = 3 if x in ("sion", "tion") else len(x)
        return f"CASE WHEN {measure(k)} > 1 THEN {cut(k)} ELSE w END"

    verbal = lambda x: f"{ends(x)} AND contains({part(len(x))}, 'v')"
    double = "length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(shape, 1) = 'c' AND right(w, 1) NOT IN ('l', 's', 'z')"
    restored = (
        f"CASE WHEN w = before OR before LIKE '%eed' THEN w WHEN {ends('at', 'bl', 'iz')} THEN w || 'e' WHEN {double} THEN {cut(1)} "
        f"WHEN {measure(0)} = 1 AND {short(0)} THEN w || 'e' ELSE w END"
    )
    steps = [
        f"CASE WHEN {ends('sses', 'ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {measure(3)} > 0 THEN {cut(1)} ELSE w END "
        f"WHEN {verbal('ed')} THEN {cut(2)} WHEN {verbal('ing')} THEN {cut(3)} ELSE w END",
        restored,
        f"CASE WHEN {verbal('y')} THEN {cut(1)} || 'i' ELSE w END",
        replaced(STEP2), replaced(STEP3), longest(STEP4, dropped),
        f"CASE WHEN {ends('e')} AND ({measure(1)} > 1 OR ({measure(1)} = 1 AND NOT {short(1)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {measure(1)} > 1 THEN {cut(1)} ELSE w END",
    ]
    chain, last = [f"s0 AS (SELECT word, word AS w, '' AS before FROM {source} WHERE length(word) > 2)"], "s0"
    for i, step in enumerate(steps, 1):
        chain.append(f"s{i} AS (SELECT word, {step} AS w, w AS before FROM (SELECT *, {shape} AS shape FROM {last}))")
        last = f"s{i}"
    return ", ".join([*chain, f"stems AS (SELECT word, w AS stem FROM {last} UNION ALL SELECT word, word FROM {source} WHERE length(word) <= 2)"])


def _grid_trees() -> dict[str, str]:
    """One boosted tree written out: gains of all cuts, the best cut of each node, leaf values."""

    def tree(lam: float, weight: float, least: int, rate: float, leaves: int) -> str:
        score = lambda g, h: f"(({g}) * ({g}) / (({h}) + {lam}::DOUBLE))"
        gains = (
            "count(*) FILTER (x <= cut) AS nl, count(*) AS n, sum(g) AS sg, count(*) * 0.25::DOUBLE AS sh, "
            "coalesce(sum(g) FILTER (x <= cut), 0) AS gl, count(*) FILTER (x <= cut) * 0.25::DOUBLE AS hl"
        )
        enough = f"nl >= {least} AND n - nl >= {least} AND hl >= {weight} AND sh - hl >= {weight}"
        gain = f"{score('gl', 'hl')} + {score('sg - gl', 'sh - hl')} - {score('sg', 'sh')} AS gain"
        pick = "row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, i) AS place"
        counts = ", ".join(
            f"({f}, {q(name)}, {value})" for f, (name, value) in enumerate((
                ("chars", "length(t)"), ("spaces", "length(t) - length(replace(t, ' ', ''))"),
                ("commas", "length(t) - length(replace(t, ',', ''))"), ("letter_a", "length(t) - length(replace(t, 'a', ''))"),
            ))
        )
        return (
            "WITH docs AS (SELECT doc_id, quality AS label, 0.5::DOUBLE - quality AS g, coalesce(text, '') AS t FROM documents JOIN labels USING (doc_id)), "
            f"vals AS (SELECT doc_id, label, g, f, feature, x FROM docs, LATERAL (VALUES {counts}) v(f, feature, x)), "
            "grid AS (SELECT f, i, width, i * width AS cut FROM (VALUES (0, 100, 200), (1, 20, 200), (2, 2, 100), (3, 1, 200)) w(f, width, n), "
            "LATERAL (SELECT unnest(range(n)) AS i)), "
            f"g0 AS (SELECT 0 AS node, f, feature, i, cut, {gains} FROM vals JOIN grid USING (f) GROUP BY ALL), "
            f"s0 AS (SELECT *, {gain} FROM g0 WHERE {enough}), "
            f"b0 AS (SELECT * FROM (SELECT *, {pick} FROM s0) WHERE place = 1 AND gain > 1e-6), "
            "side AS (SELECT doc_id, CASE WHEN x <= cut THEN 1 ELSE 2 END AS node FROM vals JOIN b0 USING (f)), "
            f"g1 AS (SELECT node, f, i, cut, {gains} FROM vals JOIN side USING (doc_id) JOIN grid USING (f) GROUP BY ALL), "
            f"s1 AS (SELECT *, {gain} FROM g1 WHERE {enough}), "
            f"b1 AS (SELECT * FROM (SELECT *, {pick} FROM s1) WHERE place = 1 AND gain > 1e-6 "
            f"ORDER BY gain DESC, node LIMIT {leaves - 2}), "
            "leaf AS (SELECT vals.doc_id, side.node * 10 + CASE WHEN x <= cut THEN 1 ELSE 2 END AS leaf FROM vals JOIN side USING (doc_id) "
            "JOIN b1 USING (node, f)), "
            "ends AS (SELECT doc_id, label, g, coalesce(leaf, node, 0) AS leaf FROM docs LEFT JOIN side USING (doc_id) LEFT JOIN leaf USING (doc_id)), "
            f"v AS (SELECT leaf, -{rate} * sum(g) / (count(*) * 0.25::DOUBLE + {lam}) AS value FROM ends GROUP BY leaf) "
        )

    level = tree(1.0, 1.0, 1, 0.3, 4)
    scores = f"SELECT doc_id, label, {r6('1 / (1 + exp(-value))')} AS p FROM ends JOIN v USING (leaf)"
    return {
        "boosted_tree": level + scores,
        "leafwise_tree": tree(0.0, 1e-3, 20, 0.1, 3) + scores,
        "split_gains": f"{level} SELECT feature, cut::BIGINT AS cut, nl AS n_left, {r6('gain')} AS gain FROM s0 "
        "WHERE (f, i) IN (SELECT (f, ceil(x / width)::BIGINT) FROM vals JOIN grid USING (f))",
    }


def _oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["read_labelled"] = "SELECT doc_id, lang, n_chars, toxic, quality FROM documents JOIN labels USING (doc_id)"
    o["target_select"] = "SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)"
    o["head_n"] = "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100"
    o["label_balance"] = (
        "SELECT 'toxic' AS label, toxic AS value, count(*) AS n FROM labels GROUP BY toxic UNION ALL "
        "SELECT 'quality', quality, count(*) FROM labels GROUP BY quality"
    )
    part = "CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS part"
    o["stratified_split"] = f"WITH {ranked('labels', 'toxic')} SELECT doc_id, toxic, {part} FROM ranked"
    o["any_label_split"] = (
        f"WITH f AS (SELECT doc_id, toxic, (toxic > 0)::INT AS any_label FROM labels), {ranked('f', 'any_label')} "
        f"SELECT doc_id, toxic, any_label, {part} FROM ranked"
    )
    o["stratified_sample"] = (
        f"WITH {ranked('labels', 'toxic')} SELECT doc_id, toxic FROM ranked WHERE rn <= floor(n * 0.3::DOUBLE + 0.5::DOUBLE)"
    )
    o["random_split"] = f"WITH {ranked('documents')} SELECT doc_id, {part} FROM ranked"
    o["capped_sample"] = (
        f"WITH {ranked('documents')} SELECT doc_id, n_chars FROM ranked WHERE rn <= least(20000, floor(n * 0.2::DOUBLE))"
    )
    o["stratified_folds"] = f"WITH {ranked('labels', 'toxic')} SELECT doc_id, toxic, (((rn - 1) * 5) // n)::INT AS fold FROM ranked"
    o["examples_per_class"] = (
        "SELECT doc_id, toxic, rn::INT AS rn FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rn "
        "FROM labels) WHERE rn <= 3"
    )
    # Text
    o["clean_text"] = f"WITH {CLEAN} SELECT doc_id, clean FROM cleaned"
    o["stemmed_text"] = (
        f"WITH {CLEAN}, u AS (SELECT doc_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS pos FROM "
        "(SELECT doc_id, string_split(clean, ' ') AS ts FROM cleaned) ), d AS (SELECT DISTINCT word FROM u), "
        f"{porter('d')} SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS stemmed FROM u JOIN stems USING (word) GROUP BY doc_id"
    )
    o["porter_stems"] = (
        f"WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{P.WORD2}')) AS word FROM documents), {porter('d')} "
        "SELECT word, stem FROM stems"
    )
    o["word_vector_invariants"] = (
        f"WITH {CLEAN}, w AS (SELECT DISTINCT unnest(string_split(clean, ' ')) AS word FROM cleaned) "
        "SELECT count(*) AS words, count(*) AS with_vector FROM w WHERE word <> ''"
    )
    n_docs = "(SELECT count(*) FROM documents)"
    o["saved_pipeline_scores"] = f"SELECT {n_docs} AS documents, {n_docs} AS batch_equal, {n_docs} AS stream_equal"
    o["registry_roundtrip"] = (
        "SELECT model, n AS documents, n AS equal FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id)), "
        "(VALUES ('logistic'), ('random_forest'), ('voting'), ('weighted_voting'), ('stacking')) AS m(model)"
    )
    o["clean_turns"] = f"SELECT conv_id, turn, role, {clean()} AS clean FROM conversations"
    o["strip_urls"] = f"SELECT page_id, {rx('html', P.URL)} AS html FROM pages"
    o["strip_mentions"] = f"SELECT doc_id, {rx('lower(text)', P.MENTION)} AS text FROM documents"
    o["tokens"] = (
        f"WITH t AS (SELECT doc_id, {treebank('text')} AS ts FROM documents) "
        "SELECT doc_id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM t"
    )
    o["stopwords_removed"] = f"SELECT doc_id, array_to_string({kept_tokens()}, ' ') AS kept FROM documents"
    o["noun_lemmas"] = (
        f"WITH w AS (SELECT DISTINCT unnest({kept_tokens()}) AS word FROM documents), l AS (SELECT word, {lemma('word')} AS lemma FROM w) "
        "SELECT word, lemma FROM l WHERE word <> lemma"
    )
    cut = lambda k: f"CASE WHEN length(text) > {k} THEN left(text, {k}) || '...' ELSE text END"
    o["preview_text"] = f"SELECT doc_id, {cut(50)} AS short, {cut(100)} AS long FROM documents"
    # Vectorisers
    o["bag_of_words"] = f"WITH {CLEAN}, {WORDS}, {grams(1)} SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL"
    o["doc_frequency"] = f"WITH {CLEAN}, {WORDS}, {frequency()} SELECT term, df, tf FROM freq"
    o["ngram_counts"] = f"WITH {CLEAN}, {WORDS}, {frequency(3)} SELECT term, df, tf FROM freq WHERE df >= 2"
    o["vocabulary"] = (
        f"WITH {CLEAN}, {WORDS}, {frequency(2)}, {vocab(1000, 3, 0.9)} SELECT term, df, tf, idx, {r6('idf')} AS idf FROM vocab"
    )
    weight = "c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY doc_id))"
    tf = "tfs AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY ALL)"
    o["tfidf"] = (
        f"WITH {CLEAN}, {WORDS}, {frequency()}, {vocab(1000, 3, 0.9)}, {tf} "
        f"SELECT doc_id, term, {r6(weight)} AS weight FROM tfs JOIN vocab USING (term)"
    )
    size = "SELECT count(*) FROM tr"
    o["tfidf_transform_holdout"] = (
        f"WITH {CLEAN}, {WORDS}, {ranked('documents')}, tr AS (SELECT doc_id FROM ranked WHERE rn > ceil(n * 0.2::DOUBLE)), "
        f"{frequency(1, 'tr')}, {vocab(1000, 3, 0.9, size)}, {tf} "
        f"SELECT doc_id, term, {r6(weight)} AS weight FROM tfs JOIN vocab USING (term) "
        "WHERE doc_id NOT IN (SELECT doc_id FROM tr)"
    )
    # Scalar families
    o["lexical_features"] = f"WITH {lexical('documents')} SELECT doc_id, {LEX_SELECT} FROM lex"
    o["lexical_by_class"] = (
        f"{LEX_LABELLED} SELECT toxic, count(*) AS n, " + ", ".join(f"{r6(f'avg({c})')} AS mean_{c}" for c in LEXICAL)
        + " FROM lex GROUP BY toxic"
    )
    o["pos_shares"] = f"WITH {TAGGED}, {POS_TABLE} SELECT * FROM pt"
    o["tag_lexicon"] = (
        f"WITH {TAGGED}, c AS (SELECT word, tag, count(*) AS n FROM tagged GROUP BY ALL) "
        "SELECT word, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS rn FROM c) WHERE rn = 1"
    )
    o["sentiment_scores"] = f"WITH {sentiment('documents')} SELECT * FROM senti"
    o["sentiment_turns"] = (
        "WITH turns AS (SELECT conv_id || '|' || turn AS turn_id, role, text FROM conversations), "
        f"{sentiment('turns', 'turn_id')} SELECT role, count(*) AS n, {r6('avg(sent_compound)')} AS compound, "
        f"{r6('avg(sent_neg)')} AS negative FROM senti JOIN turns USING (turn_id) GROUP BY role"
    )
    o["readability_scores"] = f"WITH {readability('documents')} SELECT doc_id, {', '.join(READABILITY)} FROM rd"
    o["syllables"] = (
        f"WITH w AS (SELECT DISTINCT unnest({split_spaces(rx('lower(text)', P.PUNCT))}) AS word FROM documents) "
        f"SELECT word, {syllable_list('[word]')}[1]::BIGINT AS n_syllables FROM w"
    )
    o["mean_pooled_vectors"] = (
        f"WITH {CLEAN}, {WORDS}, {frequency()}, {vocab(10**9, 2, 0.9)}, v AS (SELECT term, embedding::DOUBLE[] AS x FROM vocab JOIN embeddings ON idx = vec_id), "
        f"{tf}, j AS (SELECT doc_id, c, unnest(x) AS val, unnest(range(64)) AS dim FROM tfs JOIN v USING (term)), "
        "m AS (SELECT doc_id, dim, sum(c * val) / sum(c) AS value FROM j GROUP BY ALL), "
        "g AS (SELECT doc_id, dim FROM documents, range(64) r(dim)) "
        f"SELECT g.doc_id, g.dim, {r6('coalesce(value, 0)')} AS value FROM g LEFT JOIN m USING (doc_id, dim)"
    )
    # Combination and selection
    o["feature_layout"] = (
        f"WITH {CLEAN}, {WORDS}, {frequency()}, {vocab(1000, 3, 0.9)}, s(pos, family, size) AS (SELECT 0, 'tfidf', count(*) FROM vocab "
        "UNION ALL VALUES (1, 'lexical', 10), (2, 'pos', 9), (3, 'readability', 5), (4, 'sentiment', 4)) "
        "SELECT family, (sum(size) OVER (ORDER BY pos) - size)::BIGINT AS \"start\", (sum(size) OVER (ORDER BY pos))::BIGINT AS \"end\", size FROM s"
    )
    o["combined_scalar_features"] = (
        f"WITH {lexical('documents')}, {TAGGED}, {POS_TABLE}, {readability('documents')}, {sentiment('documents')} "
        f"SELECT doc_id, {LEX_SELECT}, {', '.join(f'pos_{c}' for c in POS)}, {', '.join(READABILITY)}, "
        f"{', '.join(r6(c) + ' AS ' + c for c in ('sent_pos', 'sent_neg', 'sent_neu', 'sent_compound'))} "
        "FROM lex JOIN pt USING (doc_id) JOIN rd USING (doc_id) JOIN senti USING (doc_id)"
    )
    sums = "g AS (SELECT feature, toxic, count(*) AS n, sum(value) AS s FROM long GROUP BY ALL)"
    chi2 = (
        f"{LEX_LONG}, {sums}, e AS (SELECT *, sum(s) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM g), "
        f"sc AS (SELECT feature, {r6('sum((s - e) * (s - e) / e)')} AS score FROM e GROUP BY feature)"
    )
    o |= _grid_trees()
    o["chi2_scores"] = f"{chi2} SELECT * FROM sc"
    o["top_chi2_features"] = f"{chi2} SELECT * FROM sc ORDER BY score DESC, feature LIMIT 5"
    o["anova_f_scores"] = (
        f"{LEX_LONG}, gm AS (SELECT feature, avg(value) AS m, count(*) AS n FROM long GROUP BY feature), "
        "cm AS (SELECT feature, toxic, avg(value) AS m, count(*) AS n FROM long GROUP BY ALL), "
        "b AS (SELECT cm.feature, sum(cm.n * (cm.m - gm.m) * (cm.m - gm.m)) / (count(*) - 1) AS b, any_value(gm.n) - count(*) AS df FROM cm JOIN gm USING (feature) GROUP BY cm.feature), "
        "w AS (SELECT long.feature, sum((value - m) * (value - m)) AS w FROM long JOIN cm ON long.feature = cm.feature AND long.toxic = cm.toxic GROUP BY long.feature) "
        f"SELECT feature, {r6('b / nullif(w / df, 0)')} AS score FROM b JOIN w USING (feature)"
    )
    o["mutual_info_scores"] = (
        f"{LEX_LONG}, e AS (SELECT feature, quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM long GROUP BY feature), "
        "b AS (SELECT long.feature, toxic, len(list_filter(q, lambda t: t < value)) AS bin FROM long JOIN e USING (feature)), "
        "j AS (SELECT feature, bin, toxic, count(*)::DOUBLE AS n FROM b GROUP BY ALL), "
        "t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nt, sum(n) OVER (PARTITION BY feature, bin) AS nb, "
        "sum(n) OVER (PARTITION BY feature, toxic) AS nl FROM j) "
        f"SELECT feature, {r6('sum(n / nt * ln(n * nt / (nb * nl)))')} AS score FROM t GROUP BY feature"
    )
    o["correlated_pairs"] = (
        f"{LEX_LONG}, r AS (SELECT a.feature AS feature_a, b.feature AS feature_b, corr(a.value, b.value) AS r FROM long a JOIN long b "
        "ON a.doc_id = b.doc_id AND a.feature < b.feature GROUP BY ALL) "
        f"SELECT feature_a, feature_b, {r6('r')} AS r FROM r WHERE abs(r) >= 0.4 AND NOT isnan(r)"
    )
    o["normality_k2"] = (
        "WITH long AS (SELECT unnest(embedding)::DOUBLE AS value, unnest(range(64)) AS feature FROM embeddings), "
        "mu AS (SELECT feature, avg(value) AS m FROM long GROUP BY feature), "
        "mom AS (SELECT feature, count(*)::DOUBLE AS cnt, avg(pow(value - m, 2)) AS c2, avg(pow(value - m, 3)) AS c3, "
        "avg(pow(value - m, 4)) AS c4 FROM long JOIN mu USING (feature) GROUP BY feature), "
        f"{k2_sql('cnt', 'c3 / pow(c2, 1.5)', 'c4 / (c2 * c2) - 3')} "
        f"SELECT feature, {r6('k2')} AS k2, {r6('exp(-k2 / 2)')} AS p, "
        "CASE WHEN exp(-k2 / 2) > 0.05 THEN 'normally distributed' ELSE 'NOT normally distributed' END AS verdict FROM m5"
    )
    o["class_densities"] = (
        f"{LEX_LONG}, f AS (SELECT feature, toxic AS label, value AS x FROM long), "
        "s AS (SELECT feature, label, count(*) AS n, stddev_samp(x) * pow(count(*)::DOUBLE, -0.2) AS bw, min(x) AS lo, max(x) AS hi FROM f GROUP BY ALL), "
        "g AS (SELECT *, lo - 3 * bw + (hi + 3 * bw - (lo - 3 * bw)) * i / 199.0::DOUBLE AS \"at\" FROM s, range(200) r(i) WHERE bw > 0) "
        f"SELECT g.feature, g.label, g.i, {r6('any_value(g.at)')} AS \"at\", "
        f"{r6('sum(exp(-0.5 * pow((g.at - x) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi()))')} AS density "
        "FROM g JOIN f ON g.feature = f.feature AND g.label = f.label GROUP BY g.feature, g.label, g.i"
    )
    corr = lambda y: f"CASE WHEN isnan(corr(value, {y})) THEN NULL ELSE corr(value, {y}) END"
    o["coef_cull"] = (
        f"{LEX_LONG}, c AS (SELECT feature, {corr('toxic')} AS coefficient FROM long GROUP BY feature) "
        f"SELECT feature, {r6('coefficient')} AS coefficient, coalesce(abs(coefficient) >= 0.05, FALSE) AS kept FROM c"
    )
    o["top_importances"] = (
        f"{LEX_LONG}, c AS (SELECT 'toxic' AS model, feature, round(abs({corr('toxic')}), 6) AS importance FROM long GROUP BY feature UNION ALL "
        f"SELECT 'quality', feature, round(abs({corr('quality')}), 6) FROM long GROUP BY feature), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM c WHERE importance IS NOT NULL) "
        "SELECT * FROM r WHERE rank <= 5"
    )
    o["holdout_mse"] = f"{SCORES} SELECT model, {r6('avg((label - p) * (label - p))')} AS mse FROM scores GROUP BY model"
    # Scaling and resampling
    o["standardise"] = (
        "WITH long AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings), "
        "m AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY dim) "
        f"SELECT id, dim, {r6('(v - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END')} AS z FROM long JOIN m USING (dim)"
    )
    o["balanced_weights"] = (
        f"SELECT doc_id, toxic, {r6('count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY toxic))')} AS weight FROM labels"
    )
    o["undersample_1_1"], o["undersample_2_1"] = undersample(1.0), undersample(0.5)
    minority = f"WITH {VECTORS}, {nearest(5, 'a.y = 1', 'b.y = 1')}"
    o["knn_minority"] = f"{minority} SELECT query_id, rank::INT AS rank, neighbour_id, {r6('dist')} AS dist FROM nn"
    o["borderline_danger"] = (
        f"WITH {VECTORS}, {nearest(10, 'a.y = 1')}, {SHARES} SELECT id, majority FROM shares WHERE 2 * majority >= k AND majority < k"
    )
    quota = "round_even((majority::DOUBLE / k) / sum(majority::DOUBLE / k) OVER () * (maj - mino), 0)::BIGINT"
    o["adasyn_quota"] = (
        f"WITH {VECTORS}, {nearest(5, 'a.y = 1')}, {SHARES}, {SIZES} "
        f"SELECT id, {r6('majority::DOUBLE / k')} AS share, {quota} AS quota FROM shares, sz"
    )
    o["tomek_links"] = (
        f"WITH {VECTORS}, {nearest(1, 'a.y = 1')}, {nearest(1, 'a.y = 0 AND a.id IN (SELECT neighbour_id FROM nn)', name='back')} "
        "SELECT a.query_id AS minority_id, a.neighbour_id AS majority_id FROM nn a JOIN back b "
        "ON a.neighbour_id = b.query_id AND b.neighbour_id = a.query_id JOIN vec va ON va.id = a.query_id JOIN vec vb ON vb.id = a.neighbour_id "
        "WHERE va.y = 1 AND vb.y = 0"
    )
    o["smote_points"] = (
        f"WITH {VECTORS}, {nearest(5, 'a.y = 1', 'b.y = 1')}, {SIZES}, seeds AS (SELECT id FROM vec WHERE y = 1), {ranked('seeds', id_col='id')}, "
        "quota AS (SELECT id, (maj - mino) // n + (rn <= (maj - mino) % n)::INT AS quota FROM ranked, sz), "
        "deg AS (SELECT query_id AS id, count(*) AS deg FROM nn GROUP BY query_id), "
        "copies AS (SELECT id, unnest(range(1, quota + 1)) AS copy_no FROM quota), "
        "keyed AS (SELECT *, md5(id || '|' || copy_no || '|42') AS key FROM copies JOIN deg USING (id)), "
        f"picked AS (SELECT keyed.id, copy_no, neighbour_id, {uniform('substr(key, 1, 8)')} AS gap FROM keyed JOIN nn "
        f"ON nn.query_id = keyed.id AND nn.rank = floor({uniform('substr(key, 9, 8)')} * deg) + 1), "
        "wide AS (SELECT p.id AS seed_id, copy_no, neighbour_id, gap, unnest(a.x) AS xa, unnest(b.x) AS xb, unnest(range(64)) AS dim "
        "FROM picked p JOIN vec a ON a.id = p.id JOIN vec b ON b.id = p.neighbour_id) "
        f"SELECT seed_id, copy_no, neighbour_id, dim, {r6('xa + gap * (xb - xa)')} AS value FROM wide"
    )
    # Search and ensembles
    o["halving_schedule"] = (
        "WITH c AS (SELECT count(*) AS n FROM labels), s AS (SELECT greatest(1, least(1500, n // 3)) AS low, least(50000, n) AS top FROM c), "
        "r AS (SELECT low, greatest(1, top // low) AS first, i AS rung, pow(3, i)::BIGINT AS f FROM s, range(21) t(i)) "
        "SELECT rung, low * f AS rows, ceil(first::DOUBLE / f)::BIGINT AS candidates FROM r WHERE f <= first"
    )
    o["candidate_survivors"] = (
        f"{SCORES}, {ranked('labels', 'toxic')}, folds AS (SELECT doc_id, ((rn - 1) * 5) // n AS fold FROM ranked), "
        "x AS (SELECT model || '@' || cut AS candidate, fold, p >= cut::DOUBLE AS hit, label = 1 AS pos FROM scores JOIN folds USING (doc_id), "
        "(VALUES ('0.2'), ('0.4'), ('0.6')) t(cut)), "
        "c AS (SELECT candidate, fold, count(*) FILTER (hit AND pos) AS tp, count(*) FILTER (hit AND NOT pos) AS fp, "
        "count(*) FILTER (NOT hit AND pos) AS fn FROM x GROUP BY ALL), "
        f"m AS (SELECT candidate, round(avg(round({div('2 * tp', '2 * tp + fp + fn')}, 9)), 9) AS score FROM c GROUP BY candidate), "
        "r AS (SELECT candidate, score, row_number() OVER (ORDER BY score DESC, candidate) AS rank, count(*) OVER () AS n FROM m) "
        f"SELECT candidate, {r6('score')} AS score, rank FROM r WHERE rank <= ceil(n / 3.0::DOUBLE)"
    )
    vote = lambda name: (
        f"SELECT '{name}' AS model, doc_id, label, {r6('p')} AS p, (p >= 0.5)::INT AS pred FROM v"
    )
    o["soft_vote"] = f"{SCORES}, v AS (SELECT doc_id, max(label) AS label, avg(p) AS p FROM scores GROUP BY doc_id) {vote('voting')}"
    o["weighted_vote"] = (
        f"{METRICS}, v AS (SELECT doc_id, max(label) AS label, sum(p * f1) / sum(f1) AS p FROM scores JOIN metrics USING (model) GROUP BY doc_id) "
        + vote("weighted_voting")
    )
    # Evaluation
    o["eval_metrics"] = f"{METRICS} SELECT model, {r6('accuracy')} AS accuracy, {r6('f1')} AS f1, {r6('roc_auc')} AS roc_auc FROM metrics"
    grid = (
        f"{SCORES}, g AS (SELECT * FROM (SELECT DISTINCT model FROM scores), (VALUES (0), (1)) a(label), (VALUES (0), (1)) b(pred)), "
        "h AS (SELECT model, label, (p >= 0.5)::INT AS pred, count(*) AS n FROM scores GROUP BY ALL), "
        "m AS (SELECT g.model, g.label, g.pred, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (model, label, pred))"
    )
    o["confusion"] = f"{grid} SELECT model, label, pred, n FROM m"
    o["confusion_normalised"] = (
        f"{grid} SELECT model, label, pred, {r6('n / (sum(n) OVER (PARTITION BY model, label))::DOUBLE')} AS row_share FROM m"
    )
    rounded = ", ".join(f"{r6(c)} AS {c}" for c in ("precision", "recall", "f1"))
    o["class_report"] = f"{SCORES}, {counts()}, {report()} SELECT model, class, {rounded}, support::BIGINT AS support FROM report"
    o["macro_scores"] = (
        f"{SCORES}, {counts()}, {report()} SELECT a.model, {r6('a.f1')} AS f1, {r6('a.precision')} AS precision, {r6('a.recall')} AS recall, "
        f"{r6('b.f1')} AS accuracy FROM report a JOIN report b ON a.model = b.model WHERE a.class = 'macro avg' AND b.class = 'accuracy'"
    )
    o["pr_curve"] = f"{SCORES}, {CURVE} SELECT model, {r6('threshold')} AS threshold, {r6('precision')} AS precision, {r6('recall')} AS recall FROM pr"
    o["roc_curve"] = (
        f"{SCORES}, {CURVE} SELECT model, {r6('p')} AS threshold, {r6('fp::DOUBLE / neg')} AS fpr, {r6('tp::DOUBLE / pos')} AS tpr FROM pts "
        "UNION ALL SELECT DISTINCT model, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM scores"
    )
    best = f"{SCORES}, {CURVE}, {BEST}"
    o["best_threshold"] = f"{best} SELECT model, {r6('threshold')} AS threshold, {r6('f1')} AS f1 FROM best"
    o["best_overall"] = f"{best} SELECT model, {r6('threshold')} AS threshold, {r6('f1')} AS f1 FROM best ORDER BY f1 DESC, model LIMIT 1"
    o["errors_at_threshold"] = (
        f"{best} SELECT model, {r6('any_value(threshold)')} AS threshold, count(*) FILTER (p >= threshold AND label = 0) AS false_positives, "
        "count(*) FILTER (p < threshold AND label = 1) AS false_negatives FROM scores JOIN best USING (model) GROUP BY model"
    )
    o["threshold_sweep"] = f"{SCORES}, {SWEEP} SELECT model, threshold, {r6('f1')} AS f1, {r6('precision')} AS precision, {r6('recall')} AS recall, false_positives, false_negatives FROM sweep"
    o["sweep_optima"] = (
        f"{SCORES}, {SWEEP}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS a, "
        "row_number() OVER (PARTITION BY model ORDER BY abs(false_positives - false_negatives), threshold) AS b FROM sweep) "
        "SELECT model, max(threshold) FILTER (a = 1) AS best_f1_threshold, max(threshold) FILTER (b = 1) AS balanced_threshold, "
        "min(threshold) AS min_threshold FROM o GROUP BY model"
    )
    o["best_model"] = f"{METRICS} SELECT model, {r6('f1')} AS f1 FROM metrics ORDER BY f1 DESC, model LIMIT 1"
    title = "array_to_string(list_transform(string_split(model, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    o["metrics_long"] = " UNION ALL ".join(
        f"SELECT {title} AS model, {q(n)} AS metric, {r6(c)} AS value FROM ({METRICS} SELECT * FROM metrics) WHERE {c} IS NOT NULL"
        for n, c in (("Accuracy", "accuracy"), ("F1 Score", "f1"), ("ROC AUC", "roc_auc"))
    )
    o["sample_predictions"] = (
        f"{SCORES}, e AS (SELECT * FROM (SELECT doc_id, toxic, {cut(100)} AS text, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rn FROM labelled) WHERE rn <= 3) "
        f"SELECT e.doc_id, model, e.text, CASE WHEN p >= 0.5 THEN 'Toxic' ELSE 'Non-toxic' END AS predicted, {r6('p')} AS p, "
        "CASE WHEN toxic = 1 THEN 'Toxic' ELSE 'Non-toxic' END AS actual FROM e JOIN scores ON e.doc_id = scores.doc_id"
    )
    o["performance_at_threshold"] = (
        f"{SCORES}, {counts('0.3')}, {counts(name='d')}, {report()} SELECT report.model, class, {rounded}, support::BIGINT AS support, "
        f"{r6(div('tp + tn', 'tp + fp + fn + tn'))} AS default_accuracy FROM report JOIN d ON report.model = d.model"
    )
    # Invariants of fitted models
    everything = "SELECT {} (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents) AS {}"
    o["topic_invariants"] = everything.format("", "proper")
    o["stream_equals_batch"] = everything.format("", '"equal"')
    o["pca_invariants"] = "SELECT i, j, TRUE AS uncorrelated FROM range(8) a(i), range(8) b(j) WHERE i < j"
    return o


ORACLE = _oracle()
