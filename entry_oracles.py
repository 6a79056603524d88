"""The registered queries restated in DuckDB SQL, independently of the library's expressions."""

from __future__ import annotations

from functools import reduce

from twinloom.functions.subwords import SCRIPTS

WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NBSP = "\u00a0"

# The Moses punctuation rules as (pattern, replacement), in order.
PUNCT = [
    (r"\r", ""),
    (r"\(", " ("),
    (r"\)", ") "),
    (r" +", " "),
    (r"\) ([.!:?;,])", r")\1"),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"(\p{Nd}) %", r"\1%"),
    (r" :", ":"),
    (r" ;", ";"),
    (r"`", "'"),
    (r"''", ' " '),
    (r"„", '"'),
    (r"“", '"'),
    (r"”", '"'),
    (r"–", "-"),
    (r"—", " - "),
    (r" +", " "),
    (r"´", "'"),
    (r"([a-zA-Z])‘([a-zA-Z])", r"\1'\2"),
    (r"([a-zA-Z])’([a-zA-Z])", r"\1'\2"),
    (r"‘", "'"),
    (r"‚", "'"),
    (r"’", "'"),
    (r"''", '"'),
    (r"´´", '"'),
    (r"…", "..."),
    (f"{NBSP}«{NBSP}", '"'),
    (f"«{NBSP}", '"'),
    (r"«", '"'),
    (f"{NBSP}»{NBSP}", '"'),
    (f"{NBSP}»", '"'),
    (r"»", '"'),
    (f"{NBSP}%", "%"),
    (f"nº{NBSP}", "nº "),
    (f"{NBSP}:", ":"),
    (f"{NBSP}ºC", " ºC"),
    (f"{NBSP}cm", " cm"),
    (rf"{NBSP}\?", "?"),
    (rf"{NBSP}\!", "!"),
    (f"{NBSP};", ";"),
    (f",{NBSP}", ", "),
    (r" +", " "),
    (r'"([,.]+)', r'\1"'),
    (rf"(\p{{Nd}}){NBSP}(\p{{Nd}})", r"\1.\2"),
]

TOKENIZE_13A = [
    (r"<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
]
TOKENIZE_13A_SPLIT = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]

SCRIPT_GROUPS = [" ".join(group) for group in SCRIPTS]


def q(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def chain(expr: str, rules: list[tuple[str, str]]) -> str:
    return reduce(lambda e, r: f"regexp_replace({e}, {q(r[0])}, {q(r[1])}, 'g')", rules, expr)


def punct(expr: str) -> str:
    return f"regexp_replace({chain(expr, PUNCT)}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def clean(expr: str) -> str:
    return f"nfc_normalize(regexp_replace({punct(expr)}, '\\p{{C}}', ' ', 'g'))"


def words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {q(WS + '+')}), lambda w: w <> '')"


def hash32(*parts: str) -> str:
    return f"concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def hash60(*parts: str) -> str:
    return f"concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def word_ids(expr: str) -> str:
    return f"list_transform({words(expr)}, lambda w: ({hash32('w')} % 1000 + 10)::INT)"


PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS ru, a.text AS lez
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL
)"""

INDEXED = f"""{PAIRS},
indexed AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx FROM pairs
),
batched AS (SELECT *, row_idx // 16 AS batch_id FROM indexed)"""

DIRECTED = f"""{INDEXED},
coin AS (SELECT *, {hash32("'42'", "'0'", "batch_id")} % 2 = 0 AS fwd FROM batched),
directed AS (
  SELECT conv_id, turn, row_idx, batch_id,
    CASE WHEN fwd THEN ru ELSE lez END AS src_text,
    CASE WHEN fwd THEN lez ELSE ru END AS tgt_text,
    CASE WHEN fwd THEN 'rus_Cyrl' ELSE 'lez_Cyrl' END AS src_lang,
    CASE WHEN fwd THEN 'lez_Cyrl' ELSE 'rus_Cyrl' END AS tgt_lang
  FROM coin
)"""

ENCODED = f"""{DIRECTED},
encoded AS (
  SELECT *, {word_ids('src_text')} AS xs, {word_ids('tgt_text')} AS ys,
    CASE src_lang WHEN 'rus_Cyrl' THEN 3 ELSE 4 END AS src_id,
    CASE tgt_lang WHEN 'rus_Cyrl' THEN 3 ELSE 4 END AS tgt_id
  FROM directed
)"""

SPLIT = f"""{PAIRS},
split_pairs AS (
  SELECT ru, lez, CASE WHEN slot < 9000 THEN 'train' WHEN slot < 9500 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {hash32("'42'", 'conv_id', 'turn')} % 10000 AS slot FROM pairs)
)"""


def padded(ids: str, width: str, fill: str) -> str:
    """List ``ids`` right-filled to ``width``."""
    return f"list_concat({ids}, list_transform(range({width} - len({ids})), lambda i: {fill}))"


def mask(ids: str, width: str) -> str:
    return f"list_transform(range({width}), lambda i: CASE WHEN i < len({ids}) THEN 1 ELSE 0 END)"


FIRST = "coalesce(lang, '') IN ('en', 'de')"


def vocab(name: str, where: str = "true") -> str:
    return f"""
{name}_words AS (SELECT unnest({words('text')}) AS piece FROM documents WHERE {where}),
{name}_counts AS (SELECT piece, count(*) AS n FROM {name}_words GROUP BY piece),
{name}_ranked AS (
  SELECT (row_number() OVER (ORDER BY n DESC, piece) - 1)::INT AS id, piece,
    round(ln(n / (SELECT sum(n) FROM {name}_counts)), 6) AS score FROM {name}_counts
),
{name} AS (SELECT *, CASE WHEN id < 3 THEN 3 ELSE 1 END AS type FROM {name}_ranked)"""


DOCUMENT_IDS = f"""
doc_ids AS (
  SELECT doc_id, {word_ids('text')} AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id
  FROM documents
),
wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM doc_ids)"""

METRICS = """
metrics AS (
  SELECT day(ts)::INT AS epoch, event_type AS loader, event_id AS step, value, event_id % 16 + 1 AS n_rows
  FROM events
),
means AS (
  SELECT epoch, loader, sum(value * n_rows) / sum(n_rows) AS val_loss FROM metrics GROUP BY ALL
)"""


def bleu(source: str, group: str) -> str:
    """CTEs from ``source(id, g, hyp, ref)`` to ``bleu(g, bleu, precision_1, ..., hyp_len, ref_len)``."""
    def tokens(column: str) -> str:
        trimmed = f"regexp_replace({column}, {q(WS + '+$')}, '')"
        return words(chain(f"concat(' ', {chain(trimmed, TOKENIZE_13A)}, ' ')", TOKENIZE_13A_SPLIT))

    hyp, ref = tokens("hyp"), tokens("ref")
    gram = "unnest(list_transform(range(1, greatest(len({0}) - n + 2, 1)), lambda i: array_to_string({0}[i:i+n-1], ' ')))"
    return f"""
b_tok AS (SELECT id, {group} AS g, {hyp} AS h, {ref} AS r FROM {source}),
b_n AS (SELECT unnest([1, 2, 3, 4]) AS n),
b_h AS (SELECT id, g, n, gram, count(*) AS c FROM (SELECT id, g, n, {gram.format('h')} AS gram FROM b_tok, b_n) GROUP BY ALL),
b_r AS (SELECT id, g, n, gram, count(*) AS c FROM (SELECT id, g, n, {gram.format('r')} AS gram FROM b_tok, b_n) GROUP BY ALL),
b_match AS (
  SELECT b_h.g, b_h.n, sum(least(b_h.c, b_r.c)) AS m FROM b_h JOIN b_r USING (id, n, gram) GROUP BY ALL
),
b_total AS (
  SELECT g, n, sum(greatest(len(h) - n + 1, 0)) AS t, sum(len(h)) AS sys, sum(len(r)) AS refs
  FROM b_tok, b_n GROUP BY ALL
),
b_stat AS (
  SELECT t.*, coalesce(m, 0) AS m,
    sum(CASE WHEN coalesce(m, 0) = 0 AND t > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t.g ORDER BY t.n) AS missed
  FROM b_total t LEFT JOIN b_match b ON b.g = t.g AND b.n = t.n
),
b_part AS (
  SELECT *, CASE WHEN m > 0 THEN 100 * m / t WHEN t > 0 THEN 100 / (pow(2, missed) * t) ELSE 0 END AS p FROM b_stat
),
b_sum AS (
  SELECT g, sum(m) AS matched, min(t) AS least, min(sys) AS hyp_len, min(refs) AS ref_len,
    sum(ln(CASE WHEN p > 0 THEN p ELSE 1 END)) / 4 AS mean,
    CASE WHEN min(sys) >= min(refs) THEN 1 WHEN min(sys) = 0 THEN 0 ELSE exp(1 - min(refs) / min(sys)) END AS brevity_penalty,
    {", ".join(f"CASE WHEN sum(m) = 0 THEN 0 ELSE sum(p) FILTER (n = {n}) END AS precision_{n}" for n in range(1, 5))}
  FROM b_part GROUP BY g
),
bleu AS (
  SELECT *, CASE WHEN matched = 0 OR least = 0 THEN 0 ELSE brevity_penalty * exp(mean) END AS bleu FROM b_sum
)"""


#: The parts of a score as they are compared.
SCORE_PARTS = ", ".join(
    ["round(bleu, 6) AS bleu", *(f"round(precision_{n}, 6) AS precision_{n}" for n in range(1, 5)),
     "round(brevity_penalty, 6) AS brevity_penalty", "hyp_len::BIGINT AS hyp_len", "ref_len::BIGINT AS ref_len",
     "round(chrf, 6) AS chrf"]
)


def chrf(source: str, group: str) -> str:
    """CTEs from ``source(id, g, hyp, ref)`` to ``chrf(g, chrf)``."""
    punct_set = q("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    def cut(column: str) -> str:
        return (
            f"flatten(list_transform({words(column)}, lambda w: CASE WHEN length(w) = 1 THEN [w] "
            f"WHEN strpos({punct_set}, right(w, 1)) > 0 THEN [left(w, length(w) - 1), right(w, 1)] "
            f"WHEN strpos({punct_set}, left(w, 1)) > 0 THEN [left(w, 1), substr(w, 2)] ELSE [w] END))"
        )

    def letters(column: str) -> str:
        bare = f"regexp_replace({column}, {q(WS + '+')}, '', 'g')"
        return f"list_filter(string_split({bare}, ''), lambda c: c <> '')"

    return f"""
c_tok AS (
  SELECT id, {group} AS g, {letters('hyp')} AS hc, {letters('ref')} AS rc, {cut('hyp')} AS hw, {cut('ref')} AS rw
  FROM {source}
),
c_side AS (
  SELECT id, g, 'char' AS kind, hc AS h, rc AS r, unnest([1, 2, 3, 4, 5, 6]) AS n FROM c_tok
  UNION ALL SELECT id, g, 'word', hw, rw, unnest([1, 2]) FROM c_tok
),
c_h AS (
  SELECT id, kind, n, gram, count(*) AS c FROM (SELECT id, kind, n,
    unnest(list_transform(range(1, greatest(len(h) - n + 2, 1)), lambda i: CASE WHEN kind = 'char' THEN array_to_string(h[i:i+n-1], '') ELSE array_to_string(h[i:i+n-1], ' ') END)) AS gram FROM c_side)
  GROUP BY ALL
),
c_r AS (
  SELECT id, g, kind, n, gram, count(*) AS c FROM (SELECT id, g, kind, n,
    unnest(list_transform(range(1, greatest(len(r) - n + 2, 1)), lambda i: CASE WHEN kind = 'char' THEN array_to_string(r[i:i+n-1], '') ELSE array_to_string(r[i:i+n-1], ' ') END)) AS gram FROM c_side)
  GROUP BY ALL
),
c_match AS (
  SELECT c_r.g, kind, n, sum(least(c_h.c, c_r.c)) AS m FROM c_h JOIN c_r USING (id, kind, n, gram) GROUP BY ALL
),
c_total AS (
  SELECT g, kind, n,
    sum(CASE WHEN len(r) >= n THEN greatest(len(h) - n + 1, 0) ELSE 0 END) AS hyps,
    sum(greatest(len(r) - n + 1, 0)) AS refs
  FROM c_side GROUP BY ALL
),
c_mean AS (
  SELECT t.g, avg(coalesce(m, 0) / hyps) FILTER (hyps > 0 AND refs > 0) AS p,
    avg(coalesce(m, 0) / refs) FILTER (hyps > 0 AND refs > 0) AS r
  FROM c_total t LEFT JOIN c_match b ON b.g = t.g AND b.kind = t.kind AND b.n = t.n GROUP BY t.g
),
chrf AS (SELECT g, CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END AS chrf FROM c_mean)"""


SCORED = f"{PAIRS}, src AS (SELECT conv_id * 1000 + turn AS id, turn, ru AS hyp, lez AS ref FROM pairs)"
REVERSED = "array_to_string(list_reverse(string_split({}, ' ')), ' ')"


def _runs() -> str:
    listed = "".join(rf"\p{{{s}}}" for g in SCRIPT_GROUPS for s in g.split())
    parts = ["[" + "".join(rf"\p{{{s}}}" for s in g.split()) + r"\p{Inherited}]+" for g in SCRIPT_GROUPS]
    return "▁?(?:" + "|".join([*parts, f"[^{listed}]+"]) + ")"


UNITS = f"""
cleaned AS (SELECT {clean('text')} AS t FROM documents),
marked AS (
  SELECT unnest(list_transform({words('t')}, lambda w, i: CASE WHEN i = 1 THEN w ELSE '▁' || w END)) AS w
  FROM cleaned
),
marked_n AS (SELECT w, count(*) AS n FROM marked GROUP BY w),
units AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT unnest(regexp_extract_all(w, {q(_runs())})) AS word, n FROM marked_n) GROUP BY word
)"""

SEED_VOCAB = f"""
seed_marked AS (
  SELECT unnest(list_transform({words('t')}, lambda w: '▁' || w)) AS w
  FROM (SELECT {clean('text')} AS t FROM documents)
),
seed_units AS (
  SELECT word, sum(n) AS n FROM (
    SELECT unnest(regexp_extract_all(w, {q(_runs())})) AS word, n FROM (SELECT w, count(*) AS n FROM seed_marked GROUP BY w)
  ) GROUP BY word
),
seed_parts AS (
  SELECT n, word[s + 1:s + k] AS piece, k FROM (
    SELECT word, n, s, unnest(range(1, least(128, length(word) - s) + 1)) AS k
    FROM (SELECT word, n, unnest(range(length(word))) AS s FROM seed_units))
),
seed_weights AS (
  SELECT piece, k, sum(n) * k AS weight FROM seed_parts GROUP BY piece, k HAVING k = 1 OR sum(n) >= 2
),
seed_best AS (
  SELECT * FROM seed_weights WHERE k = 1
  UNION ALL (SELECT * FROM seed_weights WHERE k > 1 ORDER BY weight DESC, piece LIMIT 8000)
),
seed_vocab AS (
  SELECT piece, (row_number() OVER (ORDER BY k > 1, weight DESC, piece) + 4)::INT AS pid,
    round(ln(weight / (SELECT sum(weight) FROM seed_best)) * 10000) AS score
  FROM seed_best
)"""


def segmented(source: str) -> str:
    """CTEs from ``source(word)`` to ``segments(word, ids)``: best path, position by position.

    A state carries the best score and path of every position so far; on equal scores the
    longer last piece wins.
    """
    return f"""
seg_parts AS (
  SELECT word, s, s + k AS e, word[s + 1:s + k] AS piece FROM (
    SELECT word, s, unnest(range(1, least(128, length(word) - s) + 1)) AS k
    FROM (SELECT word, unnest(range(length(word))) AS s FROM {source}))
),
seg_edges AS (
  SELECT word, s, e, coalesce(v.pid, 2) AS pid, coalesce(v.score, (SELECT min(score) - 10 FROM seed_vocab)) AS score
  FROM seg_parts p LEFT JOIN seed_vocab v USING (piece) WHERE v.pid IS NOT NULL OR e - s = 1
),
seg_into AS (SELECT word, e, list({{'s': s, 'pid': pid, 'score': score}}) AS edges FROM seg_edges GROUP BY word, e),
seg_walk AS (
  SELECT word, 0 AS pos, [0.0::DOUBLE] AS best, [[]::INT[]] AS paths FROM {source}
  UNION ALL
  SELECT word, pos, list_append(best, top.total), list_append(paths, list_append(paths[top.s + 1], top.pid::INT))
  FROM (
    SELECT w.word, w.pos + 1 AS pos, w.best, w.paths,
      list_sort(list_transform(i.edges, lambda x: {{'total': w.best[x.s + 1] + x.score, 'back': -x.s, 's': x.s, 'pid': x.pid}}), 'DESC')[1] AS top
    FROM seg_walk w JOIN seg_into i ON i.word = w.word AND i.e = w.pos + 1
  )
),
segments AS (SELECT word, paths[pos + 1] AS ids FROM seg_walk WHERE pos = length(word))"""


def encoded(source: str, *key: str) -> str:
    """CTEs from ``source(*key, text)``, texts normalised, to ``ids(*key, ids)``."""
    keys = ", ".join(key)
    return f"""
enc_words AS (
  SELECT {keys}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT {keys}, list_transform({words('text')}, lambda w: '▁' || w) AS ws FROM {source})
),
enc_distinct AS (SELECT DISTINCT word FROM enc_words),
{segmented('enc_distinct')},
enc_joined AS (
  SELECT {keys}, flatten(list(ids ORDER BY pos)) AS raw FROM enc_words JOIN segments USING (word) GROUP BY ALL
),
ids AS (
  SELECT {', '.join(f'x.{k}' for k in key)},
    list_filter(coalesce(raw, []), lambda t, i: t <> 2 OR i = 1 OR raw[i - 1] <> 2) AS ids
  FROM {source} x LEFT JOIN enc_joined y ON {' AND '.join(f'x.{k} = y.{k}' for k in key)}
)"""


def batch_rows(sides: str, extra: str = "") -> str:
    """Padded training rows from ``sides(batch_id, row_idx, src_lang, xs, ys)``."""
    return f"""
framed AS (
  SELECT *, list_concat([CASE src_lang WHEN 'rus_Cyrl' THEN 3 ELSE 4 END], xs[1:126], [1]) AS x,
    list_concat([CASE src_lang WHEN 'rus_Cyrl' THEN 4 ELSE 3 END], ys[1:126], [1]) AS y FROM {sides}
),
wide AS (
  SELECT *, max(len(x)) OVER (PARTITION BY batch_id, src_lang) AS xw, max(len(y)) OVER (PARTITION BY batch_id, src_lang) AS yw
  FROM framed
)
SELECT batch_id, row_idx, {joined(padded('x', 'xw', '0'))} AS x, {joined(mask('x', 'xw'))} AS x_mask,
  {joined(padded('y', 'yw', '-100'))} AS y, {joined(mask('y', 'yw'))} AS y_mask{extra} FROM wide"""


CHARS_CLEAN = f"""
ch AS (SELECT unnest(string_split({clean('text')}, '')) AS ch FROM documents),
counts AS (SELECT ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY ch)"""
CHARS_RAW = """
ch AS (SELECT unnest(string_split(text, '')) AS ch FROM documents),
counts AS (SELECT ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY ch)"""

MATRIX_DIMS = "SELECT vec_id AS id, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings"


def trained_batches(order: str) -> str:
    """Training batches of the pairs as ``order`` numbers them, CTEs up to ``shuffled(..., row_idx)``."""
    return f"""
      WITH RECURSIVE {SEED_VOCAB}, {PAIRS}, {order},
      coin AS (SELECT *, row_idx // 16 AS batch_id, {hash32("'42'", "'0'", 'row_idx // 16')} % 2 = 0 AS fwd FROM shuffled),
      src AS (
        SELECT row_idx, 'x' AS side, {clean('CASE WHEN fwd THEN ru ELSE lez END')} AS text FROM coin
        UNION ALL SELECT row_idx, 'y', {clean('CASE WHEN fwd THEN lez ELSE ru END')} FROM coin
      ),
      {encoded('src', 'row_idx', 'side')},
      sides AS (
        SELECT batch_id, row_idx, CASE WHEN fwd THEN 'rus_Cyrl' ELSE 'lez_Cyrl' END AS src_lang, a.ids AS xs, b.ids AS ys
        FROM coin JOIN ids a USING (row_idx) JOIN ids b USING (row_idx) WHERE a.side = 'x' AND b.side = 'y'
      ),
      {batch_rows('sides')}"""


ORACLES = {
    "parallel_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "read_parallel": f"WITH {PAIRS} SELECT ru, lez FROM pairs",
    "write_splits": f"WITH {SPLIT} SELECT ru, lez, split FROM split_pairs",
    "read_split": f"WITH {SPLIT} SELECT ru, lez FROM split_pairs WHERE split = 'train'",
    "load_corpora": f"WITH {SPLIT} SELECT ru, lez FROM split_pairs",
    "write_plain_text": r"SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS value FROM documents WHERE text IS NOT NULL",
    "write_vocab": f"WITH {vocab('v')} SELECT id, piece, score, type FROM v",
    "write_embeddings": f"SELECT id::INT AS id, dim::INT AS dim, round(v::DOUBLE, 5) AS v FROM ({MATRIX_DIMS})",
    "drop_missing": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL",
    "char_filter": f"WITH {CHARS_RAW} SELECT ch, n FROM counts WHERE n >= 3 AND ch <> ' '",
    "normal_pieces": f"WITH {vocab('v')} SELECT id, piece, score, type FROM v WHERE type = 1",
    "reserved_tokens": """
      SELECT conv_id, turn, concat_ws(' ',
        CASE WHEN turn IN (0, 1, 2, 3) THEN turn || '=' || role END,
        CASE WHEN turn + 3 IN (0, 1, 2, 3) THEN (turn + 3) || '=later' END) AS kept
      FROM conversations""",
    "resolve_lang": "SELECT doc_id, CASE lang WHEN 'en' THEN 'rus_Cyrl' WHEN 'fr' THEN 'lez_Cyrl' ELSE lang END AS code FROM documents",
    "lang_to_column": f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN ru ELSE lez END AS text FROM pairs",
    "check_direction": f"WITH {DIRECTED} SELECT conv_id, turn, src_lang || '>' || tgt_lang AS direction FROM directed",
    "normalize_punct": f"SELECT doc_id, {punct('text')} AS text FROM documents",
    "normalize_punct_pages": f"SELECT page_id, {punct('html')} AS text FROM pages",
    "replace_nonprint": r"SELECT doc_id, regexp_replace(text, '\p{C}', ' ', 'g') AS text FROM documents",
    "nfkc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "preprocess": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "explode_chars": f"WITH {CHARS_RAW} SELECT ord(ch)::BIGINT AS code_point, n FROM counts",
    "char_counts": f"WITH {CHARS_CLEAN} SELECT ch, n FROM counts",
    "required_chars": f"WITH {CHARS_CLEAN} SELECT string_agg(ch, '' ORDER BY n DESC, ch) AS required_chars FROM counts WHERE n >= 3 AND ch <> ' '",
    "most_common": f"WITH {CHARS_RAW} SELECT ch, n FROM counts ORDER BY n DESC, ch",
    "split_90_5_5": f"""
      SELECT doc_id, CASE WHEN slot < 9000 THEN 'train' WHEN slot < 9500 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT doc_id, {hash32("'42'", 'doc_id')} % 10000 AS slot FROM documents)""",
    "split_exact": f"""
      WITH ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY {hash32("'42'", 'doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n
        FROM documents
      ), sized AS (SELECT *, ceil(0.1 * n) AS held, ceil(0.5 * ceil(0.1 * n)) AS test FROM ranked)
      SELECT doc_id, CASE WHEN pos < n - held THEN 'train' WHEN pos < n - test THEN 'val' ELSE 'test' END AS split
      FROM sized""",
    "with_row_idx": "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_idx FROM documents",
    "take_positional": """
      SELECT doc_id, lang, row_idx FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_idx FROM documents)
      WHERE row_idx IN (0, 17, 123)""",
    "epoch_shuffle": f"""
      SELECT doc_id, row_number() OVER (ORDER BY {hash32("'42'", "'3'", 'doc_id')}, doc_id) - 1 AS row_idx FROM documents""",
    "sample_with_replacement": f"""
      WITH indexed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents),
      draws AS (SELECT unnest(range((SELECT count(*) FROM documents))) AS draw)
      SELECT draw, doc_id FROM draws JOIN indexed
        ON row_idx = {hash60("'42'", "'0'", 'draw')} % (SELECT count(*) FROM documents)""",
    "assign_batches": f"WITH {INDEXED} SELECT conv_id, turn, row_idx, batch_id FROM batched",
    "random_direction": f"WITH {DIRECTED} SELECT conv_id, turn, src_text, tgt_text, src_lang, tgt_lang FROM directed",
    "fixed_direction": f"""
      WITH {PAIRS} SELECT conv_id, turn, lez AS src_text, ru AS tgt_text, 'lez_Cyrl' AS src_lang, 'rus_Cyrl' AS tgt_lang FROM pairs""",
    "both_directions": f"""
      WITH {PAIRS}
      SELECT conv_id, turn, ru AS src_text, lez AS tgt_text, 'rus_Cyrl' AS src_lang, 'lez_Cyrl' AS tgt_lang, 0 AS loader FROM pairs
      UNION ALL SELECT conv_id, turn, lez, ru, 'lez_Cyrl', 'rus_Cyrl', 1 FROM pairs""",
    "add_special": f"WITH {DOCUMENT_IDS} SELECT doc_id, {joined('list_concat([3], ids, [1])')} AS ids FROM doc_ids",
    "truncate_ids": f"WITH {DOCUMENT_IDS} SELECT doc_id, {joined('ids[1:126]')} AS ids FROM doc_ids",
    "pad_batch": f"""
      WITH {DOCUMENT_IDS} SELECT doc_id, {joined(padded('ids', 'width', '0'))} AS ids, {joined(mask('ids', 'width'))} AS mask FROM wide""",
    "mask_labels": f"WITH {DOCUMENT_IDS} SELECT doc_id, {joined(padded('ids', 'width', '-100'))} AS ids FROM wide",
    "max_new_tokens": f"WITH {DOCUMENT_IDS} SELECT doc_id, (32 + 3 * width)::INT AS \"limit\" FROM wide",
    "token_id": f"""
      WITH {vocab('f', f'NOT {FIRST}')}, {vocab('e', FIRST)}
      SELECT f.piece, coalesce(e.id, 2)::INT AS token_id FROM f LEFT JOIN e USING (piece)""",
    "train_batch": f"""
      WITH {ENCODED},
      framed AS (
        SELECT batch_id, row_idx, list_concat([src_id], xs[1:126], [1]) AS x, list_concat([tgt_id], ys[1:126], [1]) AS y FROM encoded
      ),
      wide AS (
        SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS xw, max(len(y)) OVER (PARTITION BY batch_id) AS yw FROM framed
      )
      SELECT batch_id, row_idx, {joined(padded('x', 'xw', '0'))} AS x, {joined(mask('x', 'xw'))} AS x_mask,
        {joined(padded('y', 'yw', '-100'))} AS y, {joined(mask('y', 'yw'))} AS y_mask FROM wide""",
    "test_batch": f"""
      WITH {ENCODED},
      framed AS (SELECT *, list_concat([src_id], xs, [1]) AS f FROM encoded),
      wide AS (SELECT *, max(len(f)) OVER (PARTITION BY batch_id) AS xw FROM framed)
      SELECT batch_id, row_idx, {joined(padded('f', 'xw', '0'))} AS x, {joined(mask('f', 'xw'))} AS x_mask,
        tgt_id::INT AS forced_bos_token_id, (32 + 3 * xw)::INT AS max_new_tokens, 4 AS num_beams, tgt_text, src_lang, tgt_lang
      FROM wide""",
    "collect_batches": f"""
      WITH {ENCODED},
      framed AS (SELECT batch_id, row_idx, list_concat([src_id], xs[1:126], [1]) AS x FROM encoded),
      wide AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS xw FROM framed)
      SELECT batch_id, string_agg(row_idx || ':' || {joined(padded('x', 'xw', '0'))}, ',' ORDER BY row_idx) AS items
      FROM wide GROUP BY batch_id""",
    "encode": f"""
      WITH RECURSIVE {SEED_VOCAB}, src AS (SELECT doc_id, {clean('text')} AS text FROM documents),
      {encoded('src', 'doc_id')}
      SELECT doc_id, {joined('ids')} AS ids FROM ids""",
    "training_batches": trained_batches(f"""
      shuffled AS (
        SELECT *, row_number() OVER (ORDER BY {hash32("'42'", "'0'", 'conv_id', 'turn')}, conv_id, turn) - 1 AS row_idx FROM pairs
      )"""),
    "drawn_batches": trained_batches(f"""
      placed AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM pairs),
      draws AS (SELECT unnest(range((SELECT count(*) FROM pairs))) AS row_idx),
      shuffled AS (
        SELECT placed.*, row_idx FROM draws JOIN placed
          ON place = {hash60("'42'", "'0'", 'row_idx')} % (SELECT count(*) FROM pairs)
      )"""),
    "validation_batches": f"""
      WITH RECURSIVE {SEED_VOCAB}, {INDEXED},
      src AS (
        SELECT row_idx, 'ru' AS side, {clean('ru')} AS text FROM batched UNION ALL SELECT row_idx, 'lez', {clean('lez')} FROM batched
      ),
      {encoded('src', 'row_idx', 'side')},
      both_ids AS (
        SELECT batch_id, row_idx, a.ids AS ru_ids, b.ids AS lez_ids
        FROM batched JOIN ids a USING (row_idx) JOIN ids b USING (row_idx) WHERE a.side = 'ru' AND b.side = 'lez'
      ),
      sides AS (
        SELECT batch_id, row_idx, 'rus_Cyrl' AS src_lang, ru_ids AS xs, lez_ids AS ys, 0 AS loader FROM both_ids
        UNION ALL SELECT batch_id, row_idx, 'lez_Cyrl', lez_ids, ru_ids, 1 FROM both_ids
      ),
      {batch_rows('sides', ', loader')}""",
    "evaluation_batches": f"""
      WITH RECURSIVE {SEED_VOCAB}, {INDEXED},
      src AS (SELECT row_idx, {clean('ru')} AS text FROM batched),
      {encoded('src', 'row_idx')},
      framed AS (SELECT row_idx, {clean('lez')} AS tgt_text, list_concat([3], ids, [1]) AS f FROM ids JOIN batched USING (row_idx))
      SELECT row_idx AS batch_id, row_idx, {joined('f')} AS x, {joined(mask('f', 'len(f)'))} AS x_mask,
        4 AS forced_bos_token_id, (32 + 3 * len(f))::INT AS max_new_tokens, 4 AS num_beams, tgt_text,
        'rus_Cyrl' AS src_lang, 'lez_Cyrl' AS tgt_lang FROM framed""",
    "decode": f"SELECT doc_id, {joined(words(clean('text')))} AS text FROM documents",
    "corpus_size": "SELECT count(*) AS n FROM documents",
    "distinct_pieces": f"WITH {vocab('f', f'NOT {FIRST}')}, {vocab('e', FIRST)} SELECT piece FROM f UNION SELECT piece FROM e",
    "mean_loss_by_loader": f"WITH {METRICS} SELECT epoch, loader, round(val_loss, 9) AS val_loss FROM means",
    "macro_loss": f"""
      WITH {METRICS} SELECT epoch, round(CASE WHEN count(*) = 5 THEN avg(val_loss) END, 9) AS val_loss FROM means GROUP BY epoch""",
    "best_checkpoints": f"""
      WITH {METRICS},
      placed AS (
        SELECT loader AS run, epoch, step, value AS val_loss,
          row_number() OVER (PARTITION BY loader ORDER BY value, step) AS best,
          row_number() OVER (PARTITION BY loader ORDER BY step DESC) AS late
        FROM metrics
      )
      SELECT run, epoch, step, val_loss, 'best' AS kept_as FROM placed WHERE best <= 3
      UNION ALL SELECT run, epoch, step, val_loss, 'last' FROM placed WHERE late = 1""",
    "checkpoint_name": f"""
      WITH {METRICS} SELECT step, printf('epoch=%02d-val_loss=%.5f.ckpt', epoch, value) AS name, epoch, value AS val_loss FROM metrics""",
    "embedding_mean": f"""
      SELECT label, dim::INT AS dim, round(avg(v::DOUBLE), 5) AS v
      FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings) GROUP BY ALL""",
    "corpus_bleu": f"WITH {SCORED}, {bleu('src', '0')} SELECT round(bleu, 6) AS bleu FROM bleu",
    "corpus_bleu_by_turn": f"WITH {SCORED}, {bleu('src', 'turn')} SELECT g AS turn, round(bleu, 6) AS bleu FROM bleu",
    "corpus_chrf": f"WITH {SCORED}, {chrf('src', '0')} SELECT round(chrf, 6) AS chrf FROM chrf",
    "metrics_row": f"""
      WITH {SCORED}, {bleu('src', 'turn')}, {chrf('src', 'turn')}
      SELECT turn, {SCORE_PARTS}, n
      FROM (SELECT turn, count(*) AS n FROM src GROUP BY turn) s JOIN bleu b ON b.g = turn JOIN chrf c ON c.g = turn""",
    "word_counts": f"WITH {UNITS} SELECT word, n FROM units",
    "substring_seeds": f"""
      WITH {UNITS},
      starts AS (SELECT word, n, unnest(range(length(word))) AS s FROM units),
      parts AS (SELECT n, word[s + 1:s + k] AS piece, k FROM (
        SELECT word, n, s, unnest(range(1, least(128, length(word) - s) + 1)) AS k FROM starts)),
      counted AS (SELECT piece, sum(n)::BIGINT AS freq, k::INT AS size FROM parts GROUP BY piece, k),
      weighted AS (SELECT *, freq * size AS weight FROM counted WHERE size = 1 OR freq >= 2)
      SELECT * FROM weighted""",
    "learn_vocab": f"""
      WITH {UNITS}, letters AS (SELECT DISTINCT unnest(string_split(word, '')) AS piece FROM units)
      SELECT 13398 AS pieces, 13398 AS distinct_pieces, 13398 AS span, 0 AS too_long, true AS probable,
        (SELECT count(*) FROM letters WHERE piece <> '') AS letters, 0 AS out_of_order""",
    "extend_vocabulary": f"""
      WITH {SEED_VOCAB} SELECT 0 AS gaps, 0 AS without_vector, 1 AS new_codes, 0 AS repeated,
        (SELECT count(*) + 5 FROM seed_vocab) AS base_kept""",
    "sample_poisson": "SELECT count(*) AS n, true AS near, 0 AS strangers FROM documents",
    "prep_corpus_for_vocab": f"""
      WITH {PAIRS},
      ch AS (SELECT unnest(string_split({clean('lez')}, '')) AS ch FROM pairs),
      counts AS (SELECT ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY ch)
      SELECT string_agg(ch, '' ORDER BY n DESC, ch) AS required_chars, (SELECT count(*) FROM pairs) AS n_lines
      FROM counts WHERE n >= 3 AND ch <> ' '""",
    "merge_vocab": f"""
      WITH {vocab('f', f'NOT {FIRST}')}, {vocab('e', FIRST)},
      lacking AS (SELECT * FROM f WHERE type = 1 AND piece NOT IN (SELECT piece FROM e))
      SELECT id, piece, round(score, 6) AS score, type FROM e
      UNION ALL
      SELECT ((SELECT max(id) FROM e) + row_number() OVER (ORDER BY id))::INT, piece,
        round(score + (SELECT arg_max(score, id) FROM e), 6), type FROM lacking""",
    "shift_scores": f"""
      WITH {vocab('f', f'NOT {FIRST}')}, {vocab('e', FIRST)}
      SELECT id, piece, round(score + (SELECT arg_max(score, id) FROM e), 6) AS score, type FROM f""",
    "added_vocab": f"WITH {vocab('f', f'NOT {FIRST}')}, {vocab('e', FIRST)} SELECT piece FROM f EXCEPT SELECT piece FROM e",
    "extend_codes": """
      SELECT DISTINCT lang AS code FROM documents UNION ALL SELECT DISTINCT role FROM conversations
      UNION ALL SELECT DISTINCT lang FROM documents WHERE lang = 'fr'""",
    "sorted_codes": """
      SELECT code, row_number() OVER (ORDER BY code) - 1 AS row_idx FROM (
        SELECT DISTINCT lang AS code FROM documents UNION ALL SELECT DISTINCT role FROM conversations
        UNION ALL SELECT DISTINCT lang FROM documents WHERE lang = 'fr')""",
    "init_embeddings": f"""
      WITH pieces AS (SELECT DISTINCT unnest({words('text')}) AS piece FROM benchmark),
      ids AS (SELECT piece, list_filter(list_transform(string_split(piece, ''),
        lambda c: ord(c) % size), lambda t: true) AS ids
        FROM pieces, (SELECT count(*) AS size FROM embeddings)),
      members AS (SELECT piece, unnest(CASE WHEN len(ids) = 0 THEN [2] ELSE ids END) AS id FROM ids),
      dims AS ({MATRIX_DIMS})
      SELECT piece, dim::INT AS dim, round(avg(v::DOUBLE), 5) AS v FROM members JOIN dims USING (id) GROUP BY ALL""",
    "resize_embeddings": f"""
      WITH dims AS ({MATRIX_DIMS}), top AS (SELECT max(vec_id) AS top FROM embeddings)
      SELECT (top - id)::INT AS id, dim::INT AS dim, round(v::DOUBLE, 5) AS v FROM dims, top
      UNION ALL
      SELECT (top + 1 + label)::INT, dim::INT, round(avg(v::DOUBLE)::FLOAT::DOUBLE, 5)
      FROM dims JOIN embeddings ON vec_id = id, top GROUP BY top, label, dim""",
    "translate_texts": f"SELECT item_id, {REVERSED.format('text')} AS translation FROM benchmark",
    "translate_split": f"WITH {PAIRS} SELECT conv_id, turn, {REVERSED.format(clean('ru'))} AS hyp, {clean('lez')} AS ref FROM pairs",
    "evaluate": f"""
      WITH {PAIRS}, src AS (SELECT conv_id * 1000 + turn AS id, {REVERSED.format(clean('ru'))} AS hyp, {clean('lez')} AS ref FROM pairs),
      {bleu('src', '0')}, {chrf('src', '0')}
      SELECT {SCORE_PARTS}, (SELECT count(*) FROM src) AS n FROM bleu, chrf""",
}
