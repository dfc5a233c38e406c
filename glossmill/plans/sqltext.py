"""DuckDB SQL fragments that say what the Column functions compute."""

from __future__ import annotations

from glossmill.functions import text as tx
from glossmill.operators import words


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(items) -> str:
    return ", ".join(quote(x) if "\n" not in x else "chr(10)" for x in items)


def values(rows: list[tuple], names: tuple[str, ...], select: bool = False) -> str:
    one = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"
    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    table = f"(SELECT * FROM (VALUES {body}) _v({', '.join(names)}))"
    return f"SELECT * FROM {table}" if select else table


def normalize(x: str) -> str:
    return f"lower(translate(nfc_normalize({x}), {quote(tx.APOSTROPHES)}, {quote(chr(39) * len(tx.APOSTROPHES))}))"


def fold(x: str) -> str:
    return f"translate({x}, 'èò', 'ɛɔ')"


def kind(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, {quote(tx.CLITIC_FULL)}) THEN 'CLITIC' WHEN regexp_matches({w}, {quote(tx.WORD_FULL)}) THEN 'WORD' ELSE 'UNIV' END"


def tokens(table: str, key: str, text: str, *keep: str) -> str:
    """A subquery with key, kept columns, pos, text, start, end, kind."""
    k = ", ".join((key, *keep))
    word = f"regexp_matches(tile, {quote(tx.WORD_FULL)})"
    head, rest = (f"regexp_extract(tile, {quote(tx.CLITIC)}, {i})" for i in (1, 2))
    split = f"{word} AND {head} <> '' AND {normalize(rest)} NOT IN ({strings(tx.CONTRACTIONS)})"
    parts = f"CASE WHEN {split} THEN [{{'t': {head}, 's': 0, 'k': 'CLITIC'}}, {{'t': {rest}, 's': length({head}), 'k': 'WORD'}}] ELSE [{{'t': tile, 's': 0, 'k': CASE WHEN {word} THEN 'WORD' ELSE 'UNIV' END}}] END"
    tiles = f"(SELECT {k}, generate_subscripts(a, 1) AS i, unnest(a) AS tile FROM (SELECT {k}, regexp_extract_all({text}, {quote(tx.TILE)}) AS a FROM {table}))"
    laid = f"(SELECT *, sum(length(tile)) OVER (PARTITION BY {key} ORDER BY i) - length(tile) AS base FROM {tiles})"
    cut = f"(SELECT {k}, i, base, generate_subscripts(p, 1) AS j, unnest(p) AS q FROM (SELECT *, {parts} AS p FROM {laid} WHERE NOT regexp_matches(tile, {quote(tx.BLANK)})))"
    return f"(SELECT {k}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i, j) - 1 AS INT) AS pos, q.t AS text, CAST(base + q.s AS BIGINT) AS \"start\", CAST(base + q.s + length(q.t) AS BIGINT) AS \"end\", q.k AS kind FROM {cut})"


def hard(text: str, kind_: str) -> str:
    n = normalize(text)
    m = lambda p: f"regexp_matches({n}, {quote(p)})"
    roman = f"regexp_matches({text}, {quote(tx.ROMAN)}) AND {text} NOT IN ('', 'I')"
    return f"CASE WHEN {kind_} = 'UNIV' OR ({roman}) THEN 'univ' WHEN {m(tx.NKO)} THEN 'bam' WHEN {m(tx.ARABIC)} THEN 'univ' WHEN {m(tx.BAM_LETTERS)} THEN 'bam' END"


def spelling(text: str, kind_: str) -> str:
    n = normalize(text)
    m = lambda p: f"regexp_matches({n}, {quote(p)})"
    return f"CASE WHEN {kind_} = 'CLITIC' AND {n} IN ({strings(tx.FRA_CLITICS)}) THEN ['fra', '0.95'] WHEN {kind_} = 'CLITIC' AND {n} IN ({strings(tx.BAM_CLITICS)}) THEN ['bam', '0.95'] WHEN {kind_} <> 'CLITIC' AND {m(tx.FRA_MARKS)} THEN ['fra', '0.97'] WHEN {kind_} <> 'CLITIC' AND {m(tx.BAM_TONES)} THEN ['bam', '0.9'] END"


def variants(word: str) -> str:
    def swap(x: str, table) -> str:
        for a, b in table:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    plain = [swap(word, t) for t in (words.STRIPPED, words.OLD_FRENCH)]
    return f"[{', '.join([*plain, *(swap(p, words.COLONIAL) for p in plain)])}]"


def grams(norm: str, longest: int = 5) -> str:
    b = f"('<' || {norm} || '>')"
    return f"flatten(list_transform(range(1, least({longest}, length({b})) + 1), lambda n: list_transform(range(1, length({b}) - n + 2), lambda i: substr({b}, i, n))))"


def splice(pairs: str, prime: int = 7919) -> str:
    full = quote(tx.WORD_FULL)
    rows = f"(SELECT id, list_filter(string_split(host, ' '), lambda w: w <> '') AS h, list_filter(string_split(guest, ' '), lambda w: w <> '' AND regexp_matches(w, {full})) AS g FROM {pairs})"
    rows = f"(SELECT *, least(1 + (id * {prime}) % 3, len(g)) AS k FROM {rows} WHERE len(h) >= 2 AND len(g) >= 1)"
    rows = f"(SELECT *, (id * {prime} + 11) % (len(g) - k + 1) AS i, 1 + (id * {prime} + 23) % (len(h) - 1) AS c FROM {rows})"
    rows = f"(SELECT *, array_to_string(g[i + 1:i + k], ' ') AS raw, array_to_string(h[1:c], ' ') AS l, array_to_string(h[c + 1:], ' ') AS r FROM {rows})"
    rows = f"(SELECT *, CASE WHEN i = 0 THEN lower(substr(raw, 1, 1)) || substr(raw, 2) ELSE raw END AS part FROM {rows})"
    return f"SELECT id, l || ' ' || part || ' ' || r AS text, CAST(length(l) + 1 AS BIGINT) AS lo, CAST(length(l) + 1 + length(part) AS BIGINT) AS hi FROM {rows}"


def _messages(chain: str, stay: float = 0.8) -> str:
    """CTEs c, f and b: forward and backward messages of each chain (id, pos, e0, e1, e2), rescaled step by step."""
    leave = (1 - stay) / 2
    keep = stay - leave
    step = lambda v, k: f"({keep}::DOUBLE * {v}{k} + {leave}::DOUBLE * ({v}0 + {v}1 + {v}2))"
    f_next = norm([f"c.e{k} * {step('f.a', k)}" for k in range(3)])
    back = [f"({keep}::DOUBLE * c.e{k} * b.b{k} + {leave}::DOUBLE * (c.e0 * b.b0 + c.e1 * b.b1 + c.e2 * b.b2))" for k in range(3)]
    return f"""c AS MATERIALIZED (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS t, count(*) OVER (PARTITION BY id) AS n, e0, e1, e2 FROM {chain}),
f AS (SELECT id, t, {', '.join(f'e{k} / (e0 + e1 + e2) AS a{k}' for k in range(3))} FROM c WHERE t = 1 UNION ALL SELECT c.id, c.t, {', '.join(f_next)} FROM f JOIN c ON c.id = f.id AND c.t = f.t + 1),
b AS (SELECT id, t, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM c WHERE t = n UNION ALL SELECT c.id, b.t - 1, {', '.join(f'{x} AS b{k}' for k, x in enumerate(norm(back)))} FROM b JOIN c ON c.id = b.id AND c.t = b.t WHERE b.t > 1)"""


def norm(xs: list[str]) -> list[str]:
    return [f"({x}) / ({' + '.join(xs)})" for x in xs]


def posteriors(chain: str, confidence: float = 0.6) -> str:
    """Posteriors of chains (id, pos, label)."""
    labels = tx.LANGUAGES
    e = ", ".join(f"CASE WHEN label = '{x}' THEN {confidence}::DOUBLE ELSE {(1 - confidence) / 2}::DOUBLE END AS e{k}" for k, x in enumerate(labels))
    both = norm([f"a{k} * b{k}" for k in range(3)])
    return f"WITH RECURSIVE {_messages(f'(SELECT id, pos, {e} FROM {chain})')} SELECT id, pos, {', '.join(f'round({x}, 4) AS {labels[k]}' for k, x in enumerate(both))} FROM f JOIN b USING (id, t) JOIN c USING (id, t)"


def informal(texts: str, strip: int = 70, colonial: int = 25, prime: int = 7919) -> str:
    """Texts (id, text) as ``informalize`` spells them."""

    def swap(x: str, table) -> str:
        for a, b in table:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    coin = lambda place: f"((id * {prime} + {place} * 104729) % 100 + 100) % 100"
    base = f"CASE WHEN {coin('0')} < {strip} THEN {swap('w', words.STRIPPED)} ELSE {swap('w', words.OLD_FRENCH)} END"
    word = f"CASE WHEN {coin('i')} < {colonial} THEN {swap(f'({base})', words.COLONIAL)} ELSE {base} END"
    return f"SELECT id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: {word}), ' ') AS text FROM {texts}"


def identify(texts: str, lexicon: str, gram_counts: str, label_stats: str) -> str:
    """A query of tokens with label, confidence and source of texts (id, text), a rule at a time.

    ``lexicon`` has form, label, weight; ``gram_counts`` gram, label, n; ``label_stats`` label, total, log_prior, vocabulary.
    """
    labels = tx.LANGUAGES
    mid = f"coalesce(last_value(CASE WHEN kind <> 'UNIV' THEN true WHEN text IN ({strings(tx.SENTENCE_END)}) THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"
    hot = lambda label, conf: [f"CASE WHEN {label} = '{x}' THEN {conf}::DOUBLE ELSE (1 - {conf}::DOUBLE) / 2 END" for x in labels]
    rules = [("hard IS NOT NULL", hot("hard", "0.999")), ("n = 1", hot("sole", "0.995")), ("n > 1", ["w0", "w1", "w2"]), ("spell IS NOT NULL", hot("spell[1]", "spell[2]")), ("kind = 'CLITIC'", ["0.5::DOUBLE", "0.5::DOUBLE", "0.0::DOUBLE"])]
    emit = ", ".join("CASE WHEN hard = 'univ' THEN NULL " + " ".join(f"WHEN {when} THEN {values_[k]}" for when, values_ in rules) + f" ELSE p{k} END AS r{k}" for k in range(3))
    best = lambda v: f"CASE WHEN {v}0 >= {v}1 AND {v}0 >= {v}2 THEN 'bam' WHEN {v}1 >= {v}2 THEN 'fra' ELSE 'eng' END"
    own = lambda v: f"CASE label WHEN 'bam' THEN {v}0 WHEN 'fra' THEN {v}1 ELSE {v}2 END"
    upper = "regexp_matches(substr(text, 1, 1), '^\\p{Lu}') AND NOT (upper(text) = text AND lower(text) <> text)"
    use = "mid AND source = 'classifier' AND " + upper
    post = norm([f"a{k} * b{k}" for k in range(3)])
    return f"""WITH RECURSIVE tok AS MATERIALIZED (SELECT *, {mid} AS mid FROM {tokens(texts, 'id', 'text')}),
lex AS (SELECT {normalize('form')} AS form, count(*) AS n, min(label) AS sole, {', '.join(f"coalesce(sum(weight) FILTER (label = '{x}'), 0) / sum(weight) AS w{k}" for k, x in enumerate(labels))} FROM {lexicon} GROUP BY 1),
seen AS (SELECT *, {fold('norm')} AS folded, {hard('text', 'kind')} AS hard, {spelling('text', 'kind')} AS spell FROM (SELECT DISTINCT text, kind, {normalize('text')} AS norm FROM tok WHERE kind <> 'UNIV')),
known AS MATERIALIZED (SELECT seen.*, {', '.join(f'CASE WHEN d.form IS NOT NULL THEN d.{c} ELSE o.{c} END AS {c}' for c in ('n', 'sole', 'w0', 'w1', 'w2'))} FROM seen LEFT JOIN lex d ON d.form = norm LEFT JOIN lex o ON o.form = folded),
asked AS (SELECT text AS word, unnest({grams('norm')}) AS gram FROM known WHERE hard IS NULL AND n IS NULL AND spell IS NULL AND kind = 'WORD'),
score AS (SELECT word, s.label, any_value(s.log_prior) + sum(ln((coalesce(g.n, 0) + 0.1) / (s.total + 0.1 * (s.vocabulary + 1)))) / sqrt(count(*)) AS score FROM (SELECT * FROM asked WHERE gram NOT IN ('<', '>')) x CROSS JOIN {label_stats} s LEFT JOIN {gram_counts} g ON g.gram = x.gram AND g.label = s.label GROUP BY word, s.label),
soft AS (SELECT word, label, exp(score - max(score) OVER (PARTITION BY word)) AS e FROM score),
prob AS (SELECT word, {', '.join(f"sum(e) FILTER (label = '{x}') / sum(e) AS p{k}" for k, x in enumerate(labels))} FROM soft GROUP BY word),
said AS MATERIALIZED (SELECT text, kind, hard, {emit}, p0, p1, p2, CASE WHEN hard IS NOT NULL THEN 'router' WHEN n IS NOT NULL THEN 'lexicon' WHEN spell IS NOT NULL THEN 'router' WHEN kind = 'CLITIC' THEN 'context' ELSE 'classifier' END AS source, CASE WHEN hard IS NOT NULL THEN hard WHEN n IS NULL AND kind <> 'CLITIC' AND spell[1] = 'fra' THEN 'fra' END AS forced FROM known LEFT JOIN prob ON word = text),
each AS MATERIALIZED (SELECT tok.id, tok.pos, tok.text, tok."start", tok."end", tok.kind <> 'UNIV' AND coalesce(forced, '') <> 'univ' AS chain, forced, CASE WHEN {use.replace('text', 'tok.text')} THEN 'context' ELSE source END AS source, {', '.join(f"CASE WHEN {use.replace('text', 'tok.text')} THEN 0.3::DOUBLE * p{k} + 0.7::DOUBLE / 3 ELSE r{k} END AS r{k}" for k in range(3))} FROM tok LEFT JOIN said ON said.text = tok.text AND said.kind = tok.kind),
{_messages('(SELECT id, pos, greatest(r0, 0.0001::DOUBLE) AS e0, greatest(r1, 0.0001::DOUBLE) AS e1, greatest(r2, 0.0001::DOUBLE) AS e2 FROM each WHERE chain)')},
post AS (SELECT id, pos, {', '.join(f'{x} AS q{k}' for k, x in enumerate(post))} FROM f JOIN b USING (id, t) JOIN c USING (id, t)),
told AS (SELECT each.*, q0, q1, q2, CASE WHEN NOT chain THEN 'univ' WHEN forced IS NOT NULL THEN forced ELSE {best('q')} END AS label FROM each LEFT JOIN post USING (id, pos))
SELECT id, pos, text, "start", "end", label, round(CASE WHEN NOT chain THEN 1.0::DOUBLE WHEN forced IS NOT NULL THEN greatest({own('q')}, {own('r')}) ELSE {own('q')} END, 4) AS confidence, CASE WHEN NOT chain OR forced IS NOT NULL THEN 'router' WHEN label = {best('r')} THEN source ELSE 'context' END AS source FROM told"""
