"""SQL for the queries that SQL can express; it runs on the same tables in another engine."""

from __future__ import annotations

SPACE = r"\x20\x09-\x0D"

#: Jump consistent hashing: a recursive walk over the buckets, in unsigned 128-bit arithmetic.
_OP1 = """
WITH RECURSIVE walk AS (
  SELECT doc_id, 0 AS shards, (doc_id::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS state,
         0::BIGINT AS bucket, 0::BIGINT AS target
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, 1, next, target,
         floor((target + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, target,
               (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next
        FROM walk WHERE target < 41)
),
path AS (
  SELECT doc_id, max(bucket) FILTER (WHERE bucket < 40) AS shard, max(bucket) AS grown_shard
  FROM walk WHERE bucket < 41 GROUP BY doc_id
),
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(b))
),
sized AS (
  SELECT d.doc_id, coalesce(strlen(text), 0) + 16 AS size, shard, grown_shard,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT FOR h IN
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents d JOIN path USING (doc_id), crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY ((doc_id % 256 + 256) % 256 + text_crc32 % 256) % 256,
                          doc_id, size, text_crc32) - 1 AS slot
FROM sized
"""

_SECRET = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, turn: int, pattern: str, group: int, least: int) -> str:
    # Ends of the pieces between matches and of the matches give the places of both.
    return f"""
  SELECT doc_id, '{kind}' AS kind, {turn} AS turn, unnest(s) AS s FROM (
    SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
        'start': list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
        'end': list_sum(list_transform(gap[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
        'size': length(c[i])}}), lambda r: r['size'] >= {least}) AS s
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS c,
                 string_split_regex(text, '{pattern}') AS gap FROM whole))"""


# Runs of one class of characters are found whole or not at all, so their least length may stand in the pattern.
_OP2 = f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_spans('assign', 0, _SECRET, 2, 8)}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]{12,}', 0, 16)}
  UNION ALL {_spans('hex', 2, '[0-9a-f]{32,}', 0, 32)}),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE turn = 0) AS n_assign, count(*) FILTER (WHERE turn = 1) AS n_access,
         count(*) FILTER (WHERE turn = 2) AS n_hex,
         string_agg(concat(kind, ':', s.start::BIGINT, ':', s."end"::BIGINT), ',' ORDER BY s.start, turn) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


def _mixing(power: float, sweeps: int, tolerance: float, spare: float) -> str:
    """Sweeps stop by the rule of the operator: when no sum was further from its target than the tolerance.

    The largest ratio leaves out the cells at the top that hold the share ``spare`` of the tokens: it is
    the percentile of the ratios, each counted once a token, between two neighbours where it falls between.
    """
    margins = ("source", "lang", "topic")

    def fitted(table: str, m: str) -> str:
        found = f"sum(share) OVER (PARTITION BY {m})"
        return (f"SELECT * REPLACE (share * target_{m} / {found} AS share, greatest(away, abs(target_{m} - {found})) AS away) "
                f"FROM ({table})")

    step = f"SELECT * REPLACE (0.0::DOUBLE AS away) FROM sweep WHERE n < {sweeps} AND worst > {tolerance}"
    for m in margins:
        step = fitted(step, m)
    targets = ", ".join(f"""
  target_{m}s AS (SELECT {m}, pow(f, {power}) / sum(pow(f, {power})) OVER () AS target_{m}
                  FROM (SELECT {m}, sum(tokens) AS f FROM cells GROUP BY {m}) WHERE f > 0)""" for m in margins)
    joined = " ".join(f"JOIN target_{m}s ON cells.{m} IS NOT DISTINCT FROM target_{m}s.{m}" for m in margins)
    names = ", ".join(f"cells.{m}" for m in margins)
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS tokens FROM documents),
marked AS (
  SELECT *, length(text) - length(regexp_replace(text, '[0-9|=<>{{}}#$%&*]', '', 'g')) AS marks FROM words),
docs AS (
  SELECT *, CASE WHEN marks > 0 AND marks * 5 >= length(text) THEN 'figures' WHEN tokens < 100 THEN 'brief'
                 WHEN tokens >= 2000 THEN 'long' ELSE 'prose' END AS topic FROM marked),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM docs GROUP BY ALL),{targets},
sweep AS (
  SELECT 0 AS n, {names}, tokens, tokens::DOUBLE / sum(tokens) OVER () AS share, target_source, target_lang, target_topic,
         0.0::DOUBLE AS away, 'inf'::DOUBLE AS worst
  FROM cells {joined} WHERE tokens > 0
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens, share, target_source, target_lang, target_topic, away, max(away) OVER () FROM ({step})),
raked AS (SELECT *, share / tokens AS ratio FROM sweep WHERE n = (SELECT max(n) FROM sweep)),
counted AS (SELECT ratio, sum(tokens) OVER (ORDER BY ratio) AS upto FROM raked WHERE ratio > 0),
place AS (SELECT (sum(tokens) - 1)::DOUBLE * (1.0::DOUBLE - {spare}) AS spot FROM raked WHERE ratio > 0),
ends AS (SELECT spot, (SELECT min(ratio) FROM counted WHERE upto > floor(spot)) AS low,
                (SELECT min(ratio) FROM counted WHERE upto > ceil(spot)) AS high FROM place),
most AS (SELECT CASE WHEN low = high THEN low ELSE (ceil(spot) - spot) * low + (spot - floor(spot)) * high END AS top FROM ends),
rates AS (SELECT source, lang, topic, least(ratio / top, 1.0) AS rate FROM raked, most)
SELECT doc_id, docs.source, docs.lang, docs.topic, tokens AS n_tokens,
       round(CASE WHEN tokens = 0 THEN 1.0 ELSE coalesce(rate, 0.0) END, 6) AS rate,
       ('0x' || substr(md5(concat(doc_id, ':0')), 1, 13))::BIGINT / 4503599627370496.0
         < CASE WHEN tokens = 0 THEN 1.0 ELSE coalesce(rate, 0.0) END AS kept
FROM docs LEFT JOIN rates ON {" AND ".join(f"docs.{m} IS NOT DISTINCT FROM rates.{m}" for m in margins)}
"""


_OP6 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM whole),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM parts q JOIN parts c ON q.i = c.i WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM ranked WHERE rank <= 10
"""

_OP10 = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^{SPACE}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM shingles x JOIN shingles y
                    ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= 80 * (p.n + q.n - same)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

#: Batches: all documents; those marked toxic leave; poor ones count only words with a letter; byte counts join.
_OP8 = f"""
WITH docs AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]*[A-Za-z][^{SPACE}]*')) AS lettered,
         coalesce(strlen(text), 0) AS bytes FROM documents),
marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
kept AS (SELECT docs.*, quality FROM docs LEFT JOIN marks USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
counts AS (
  SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN quality = 0 THEN lettered ELSE words END AS tokens FROM kept
  UNION ALL SELECT source, lang, 'bytes-1', bytes FROM kept)
SELECT source, lang, tokenizer, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM counts GROUP BY ALL
"""


#: CRC-32 of every byte value.
_CRC = """crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(b)))"""


def _manifest(levels: int = 7) -> str:
    """Trees of up to 8 ** levels leaves, level by level: ``node`` is the original, ``fold`` the recomputed digest."""
    def field(c: str) -> str:
        return f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f", {field(text)}))"

    def tree(name: str, group: str) -> str:
        """Siblings of every node on its way up. A group of one node is done and has no run."""
        steps = ""
        for n in range(levels):
            a, b = f"{name}{n}", f"{name}{n + 1}"
            steps += f""",
  {a}r AS (SELECT {group} AS g, i // 8 AS up, list(node ORDER BY i) AS run, max(many) AS many
           FROM (SELECT *, count(*) OVER (PARTITION BY {group}) > 1 AS many FROM {a}) GROUP BY ALL),
  {b} AS (SELECT g AS {group}, up AS i, CASE WHEN many THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {a}r)"""
        return steps

    def walk(source: str, name: str, group: str) -> str:
        steps, last = "", source
        for n in range(levels):
            steps += f""",
  {name}w{n} AS (SELECT w.* REPLACE (
      w.i // 8 AS i,
      CASE WHEN many THEN sha256(concat(array_to_string(run[1:w.i % 8], ''), fold, array_to_string(run[w.i % 8 + 2:], ''))) ELSE fold END AS fold,
      CASE WHEN many THEN concat(proof, array_to_string(run[1:w.i % 8], ''), array_to_string(run[w.i % 8 + 2:], '')) ELSE proof END AS proof)
    FROM {last} w JOIN {name}{n}r r ON w.{group} IS NOT DISTINCT FROM r.g AND w.i // 8 = r.up)"""
            last = f"{name}w{n}"
        return steps

    return f"""
WITH {_CRC},
hashed AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("lowered")} AS seen,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT FOR h IN
               regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..')]),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0 AS changed
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents), crc_table),
a0 AS (SELECT doc_id, lang, leaf, leaf AS node, CASE WHEN changed THEN seen ELSE leaf END AS fold, '' AS proof,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed){tree("a", "lang")},
subroots AS (SELECT lang, node AS subroot FROM a{levels}),
b0 AS (SELECT 0 AS one, lang, subroot AS node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM subroots){tree("b", "one")}{walk("a0", "a", "lang")},
joined AS (SELECT w.doc_id, w.leaf, w.fold, w.proof, b0.i, b0.node AS subroot, 0 AS one
           FROM aw{levels - 1} w JOIN b0 ON w.lang IS NOT DISTINCT FROM b0.lang){walk("joined", "b", "one")}
SELECT doc_id, leaf, subroot, b{levels}.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{levels}.node AS verified
FROM bw{levels - 1} JOIN b{levels} USING (one)
"""


#: Windows are compared as joined words, a length of windows at a time.
_OP12 = """
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, w, least(len(w), 10) AS width FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS words
  FROM items),
places AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS spot,
         unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS words
  FROM lowered, (SELECT DISTINCT width FROM items) WHERE len(w) >= width),
found AS (SELECT doc_id, item_id, spot, width FROM places JOIN windows USING (width, words)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
           SELECT doc_id, unnest(range(spot, spot + width)) AS place FROM (SELECT DISTINCT doc_id, spot, width FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def statements(temper: float, sweeps: int, tolerance: float, spare: float) -> dict[str, str]:
    return {"op1_sharding": _OP1, "op2_secrets": _OP2, "op3_mixing": _mixing(temper, sweeps, tolerance, spare), "op6_top_k": _OP6,
            "op8_token_counts": _OP8, "op10_near_dedup": _OP10, "op11_manifest": _manifest(),
            "op12_decontamination": _OP12}
