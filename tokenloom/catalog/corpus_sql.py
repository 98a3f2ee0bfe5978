"""DuckDB statements that compute what the queries of ``corpus`` compute."""

from __future__ import annotations

from tokenloom.catalog.inputs import RUNS, TOY_MERGES

FIELDS = ("text", "code", "content", "instruction", "func_code_string", "whole_func_string")

RAW = "raw AS (SELECT doc_id, lang, " + ", ".join(
    f"CASE WHEN doc_id % 17 <> 0 AND doc_id % 6 = {i} THEN text WHEN doc_id % 2 = 0 THEN '' END AS {name}"
    for i, name in enumerate(FIELDS)) + " FROM documents)"


def _resolved(n: int) -> str:
    inner = ", ".join(f"nullif({f}, '')" for f in FIELDS[:n])
    return f"{RAW}, resolved AS (SELECT doc_id, lang, coalesce({inner}) AS text FROM raw)"


def _ids(hex_text: str, top: int = 255) -> str:
    return f"[least(('0x' || h)::INT, {top}) for h in regexp_extract_all({hex_text}, '..')]"


def _md5(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


BYTES = _ids("hex(encode(text))")

# Every byte of the corpus with its position in the stream.
STREAM = """
sized AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents),
placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
stream AS (SELECT start + unnest(range(n)) AS pos, unnest(%s) AS id FROM placed)
""" % _ids("hex(encode(text))")

BLOCK = 512
# Window starts, and each window's bytes as hex text cut from the documents it touches.
STARTS = f"""
total AS (SELECT sum(octet_length(encode(text)))::BIGINT AS n FROM documents),
starts AS (SELECT i AS sample_id, (i * 1103515245 + 12345) % (n - {BLOCK}) AS start FROM total, range(n // {BLOCK}) t(i))
"""


def _windows(length: int) -> str:
    return f"""
sized AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM sized),
{STARTS},
parts AS (
  SELECT sample_id, start, doc_id,
         substr(h, (2 * greatest(start - lo, 0) + 1)::BIGINT,
                (2 * (least(start + {length}, lo + n) - greatest(start, lo)))::BIGINT) AS part
  FROM starts JOIN placed ON lo < start + {length} AND lo + n > start),
windows AS (SELECT sample_id, start, string_agg(part, '' ORDER BY doc_id) AS h FROM parts GROUP BY ALL)
"""


# Toy BPE: pieces split as GPT-2 does (merges never touch whitespace, so its lookahead
# does not matter), then merges in rank order as replacements by private characters.
PIECES = r"""regexp_extract_all(text, '''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')"""
_MARKS = {t: f"chr({0xE000 + i})" for i, t in enumerate(TOY_MERGES)}


def _merge(piece: str) -> str:
    steps = {"th": "'th'", "he": "'he'", "in": "'in'", "er": "'er'", "an": "'an'",
             "the": f"{_MARKS['th']} || 'e'", "ing": f"{_MARKS['in']} || 'g'", "on": "'on'", "ti": "'ti'",
             "tion": f"{_MARKS['ti']} || {_MARKS['on']}"}
    for token, source in steps.items():
        piece = f"replace({piece}, {source}, {_MARKS[token]})"
    return piece


BPE = f"""
marked AS (SELECT doc_id, array_to_string([{_merge('p')} for p in {PIECES}], '') AS m FROM documents),
bpe AS (SELECT doc_id, [CASE WHEN length(h) = 6 THEN 256 + ('0x' || right(h, 2))::INT - 128 ELSE ('0x' || h)::INT END
                        for h in regexp_extract_all(hex(encode(m)), 'EE80[0-9A-F][0-9A-F]|..')] AS ids FROM marked)
"""

CODEPOINTS = "[least(unicode(c), 255) for c in string_split(text, '')]"

RUN_TABLE = "runs AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in RUNS) + """) r(run, vocab_size, block_size,
n_layers, d_model, n_heads, dropout, batch_size, lr, grad_accum_steps, warmup_ratio, min_lr_ratio, iterations))"""

POINTS = """
numbered AS (
  SELECT event_type AS run, ts, event_id, value AS loss, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY event_type) AS c FROM events),
points AS (
  SELECT run, 100 * rn AS iteration, 100 * c AS total, loss, k, ts, event_id, 100 * rn AS line_no,
         k / 64 AS time_per_iter, k * 1e-6::DOUBLE AS lr FROM numbered)
"""

_TOTALS = """count(*) AS samples, sum(octet_length(encode(text)))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars,
round(sum(octet_length(encode(text))) / count(*), 6) AS avg_tokens"""
def _files(group: str) -> str:
    """Documents as lines of text files, numbered by the text before them in their group."""
    return f"""files AS (SELECT lang, doc_id, regexp_replace(coalesce(text, '') || chr(10), '\\r\\n?', chr(10), 'g') AS t,
        coalesce(sum(strlen(coalesce(text, '')) + 1) OVER ({group} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
          // 1048576 AS file FROM documents)"""


_FREQUENCY = "counts AS (SELECT id AS token_id, count(*) AS n FROM (SELECT unnest({ids}) AS id FROM {source}) GROUP BY 1)"
_BYTE_COUNTS = _FREQUENCY.format(ids=BYTES, source="documents")
_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')"
# A single byte that is no character of its own decodes to the replacement character.
_LABEL = (r"CASE WHEN token_id IN (9, 10, 13) OR token_id BETWEEN 32 AND 126 THEN " + _ESCAPED.format("chr(token_id)")
          + r" ELSE '\x' || lower(lpad(to_hex(token_id), 2, '0')) END")

SQL = {
    "s1_read_split": """SELECT doc_id, lang AS config, CASE WHEN n_chars > 1000 THEN 'train' ELSE 'validation' END AS split,
        md5(text) AS text_md5 FROM documents""",
    "s2_read_text_files": f"""WITH {_files('')} SELECT file, length(t) AS chars, md5(t) AS text_md5
        FROM (SELECT file, string_agg(t, '' ORDER BY doc_id) AS t FROM files GROUP BY 1)""",
    "s2_prepare_text_files": f"""WITH {_files('PARTITION BY lang')},
        placed AS (SELECT hex(encode(t)) AS h, coalesce(sum(strlen(t)) OVER (ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0)::BIGINT AS start FROM files),
        stream AS (SELECT start + unnest(range(length(h) // 2)) AS pos, unnest(regexp_extract_all(h, '..')) AS b FROM placed)
        SELECT pos // 512 AS chunk_id, count(*) AS n, md5(string_agg(('0x' || b)::INT::VARCHAR, ',' ORDER BY pos)) AS ids_md5
        FROM stream GROUP BY 1""",
    "s6_file_metadata": f"""WITH {_files('PARTITION BY lang')} SELECT lang, file, sum(strlen(t))::BIGINT AS total_tokens,
        sum(length(t))::BIGINT AS total_chars, 256 AS vocab_size, 'byte_level' AS tokenizer FROM files GROUP BY ALL""",
    "s7_dataset_size": """SELECT b AS bytes, round(b / 1048576, 6) AS mb
        FROM (SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS b FROM documents)""",
    "s4_s5_token_dataset": f"""WITH {STREAM} SELECT pos // 512 AS chunk_id, count(*) AS n,
        md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS ids_md5 FROM stream GROUP BY 1""",
    "s5_token_dataset_metadata": """SELECT 'documents' AS dataset_name, 'train' AS split, count(*) AS samples_processed,
        sum(octet_length(encode(text)))::BIGINT AS total_tokens, sum(length(text))::BIGINT AS total_chars,
        256 AS vocab_size, 'byte_level' AS tokenizer FROM documents""",
    "s6_dataset_metadata": f"""WITH {_resolved(6)} SELECT 'documents' AS dataset_name, 'all' AS config, 'train' AS split,
        count(*) AS samples_processed, sum(octet_length(encode(text)))::BIGINT AS total_tokens,
        sum(length(text))::BIGINT AS total_chars, 256 AS vocab_size, 'byte_level' AS tokenizer,
        '{{"dataset_name":"documents","samples_processed":' || count(*) || ',"tokenizer":"byte_level"}}' AS as_json
        FROM resolved WHERE length(text) > 0""",
    "p1_resolve_text": f"WITH {_resolved(4)} SELECT doc_id, md5(text) AS text_md5 FROM resolved",
    "p2_resolve_text_preparer": f"WITH {_resolved(6)} SELECT doc_id, md5(text) AS text_md5 FROM resolved",
    "p3_drop_empty_text": f"WITH {_resolved(4)} SELECT doc_id, lang FROM resolved WHERE length(text) > 0",
    "p4_take_budget_bytes": """WITH s AS (SELECT doc_id, octet_length(encode(text)) AS utf8_bytes,
        coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM documents WHERE length(text) > 0)
        SELECT doc_id, utf8_bytes FROM s WHERE start < 1000000 OR start = 0""",
    "p4_take_budget_chars": f"""WITH {_resolved(6)}, s AS (SELECT doc_id, length(text) AS chars,
        coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM resolved WHERE length(text) > 0)
        SELECT doc_id, chars FROM s WHERE start < 500000 OR start = 0""",
    "p5_take_samples": f"""WITH {_resolved(6)} SELECT doc_id, length(text) AS chars FROM resolved
        WHERE length(text) > 0 ORDER BY doc_id LIMIT 700""",
    "p6_crop_context": f"""SELECT doc_id, least(octet_length(encode(text)), 512) AS n,
        {_md5(_ids("right(hex(encode(text)), 1024)"))} AS ids_md5 FROM documents""",
    "p7_text_lengths": """SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS utf8_bytes FROM documents""",
    "k1_encode_bytes": f"SELECT doc_id, octet_length(encode(text)) AS n, {_md5(BYTES)} AS ids_md5 FROM documents",
    "k1_encode_bytes_clamped": f"SELECT doc_id, {_md5(_ids('hex(encode(text))', 99))} AS ids_md5 FROM documents",
    "k1_encode_bytes_builtin": f"SELECT doc_id, {_md5(_ids('hex(encode(text))', 99))} AS ids_md5 FROM documents",
    "k2_encode_bpe": f"WITH {BPE} SELECT doc_id, len(ids) AS n, {_md5('ids')} AS ids_md5 FROM bpe",
    "k2_bpe_token_frequency": f"""WITH {BPE}, {_FREQUENCY.format(ids='ids', source='bpe')},
        top AS (SELECT token_id, n, n / sum(n) OVER () * 100 AS pct FROM counts ORDER BY n DESC, token_id LIMIT 20)
        SELECT token_id, n, round(pct, 6) AS pct, left(CASE WHEN token_id < 128 THEN {_LABEL}
          WHEN token_id > 255 THEN {TOY_MERGES}[token_id - 255] ELSE chr(65533) END, 20) AS label FROM top""",
    "k5_decode_public_bpe": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "k3_encode_codepoints": f"SELECT doc_id, length(text) AS n, {_md5(CODEPOINTS)} AS ids_md5 FROM documents",
    "k4_decode_bytes": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "k5_decode_bpe": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "k6_decode_codepoints": f"""SELECT doc_id, md5(array_to_string([chr(i) for i in {CODEPOINTS}], '')) AS text_md5
        FROM documents""",
    "k7_token_label": f"""WITH {_BYTE_COUNTS} SELECT token_id, n,
        left(CASE WHEN token_id < 128 THEN {_LABEL} ELSE chr(65533) END, 20) AS label,
        left('<token_' || token_id || '>', 20) AS bare_label FROM counts""",
    "k8_tokenizer_label": """SELECT lang, count(*) AS docs, 'byte_level' AS byte_label, 'tiktoken_gpt2' AS bpe_label
        FROM documents GROUP BY lang""",
    "a1_corpus_totals": f"SELECT lang, source, {_TOTALS} FROM documents GROUP BY lang, source",
    "a1_corpus_totals_rollup": f"SELECT lang, source, {_TOTALS} FROM documents GROUP BY ROLLUP (lang, source)",
    "a2_token_stats": f"""WITH {_BYTE_COUNTS} SELECT sum(n)::BIGINT AS total_tokens, min(token_id) AS min_id,
        max(token_id) AS max_id, count(*) AS distinct_ids FROM counts""",
    "a2_approximate_distinct": """SELECT lang, count(DISTINCT p) AS exact, TRUE AS within_error FROM (
        SELECT lang, unnest([text[i:i + 1] for i in range(1, length(text))]) AS p FROM documents WHERE length(text) > 1) GROUP BY lang""",
    "a3_token_frequency": f"""WITH {_BYTE_COUNTS} SELECT token_id, n, round(n / sum(n) OVER () * 100, 6) AS pct,
        '<token_' || token_id || '>' AS label FROM counts ORDER BY n DESC, token_id LIMIT 20""",
    "a4_progress_points": f"""WITH {_resolved(6)}, s AS (SELECT row_number() OVER (ORDER BY doc_id) AS rows_seen, text,
        sum(coalesce(octet_length(encode(text)), 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_so_far
        FROM resolved) SELECT rows_seen, tokens_so_far FROM s WHERE rows_seen % 50 = 0 AND length(text) > 0""",
    "a5_throughput": f"""WITH {RUN_TABLE}, {POINTS} SELECT run, iteration,
        (iteration * batch_size * block_size)::BIGINT AS tokens_seen,
        (iteration * batch_size * block_size * grad_accum_steps)::BIGINT AS effective_tokens,
        round(iteration * batch_size * block_size / (iteration * 1.25::DOUBLE), 6) AS tok_per_s,
        round(iteration * batch_size * block_size / 46187514, 6) AS epochs FROM points LEFT JOIN runs USING (run)""",
    "w1_global_offsets": """WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)
        SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s""",
    "w2_chunk_layout": f"""WITH {STREAM} SELECT pos // 512 AS chunk_id, count(*) AS n,
        md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS ids_md5 FROM stream GROUP BY 1""",
    "w2_chunk_layout_bpe": f"""WITH {BPE}, placed AS (SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM bpe),
        stream AS (SELECT start + unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM placed)
        SELECT pos // 512 AS chunk_id, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS ids_md5
        FROM stream GROUP BY 1""",
    "w3_sample_starts": f"WITH {STARTS} SELECT sample_id, start FROM starts",
    "w4_gather_windows": f"""WITH {_windows(BLOCK + 1)} SELECT sample_id, start,
        {_md5(_ids("left(h, 1024)"))} AS x_md5, {_md5(_ids("right(h, 1024)"))} AS y_md5 FROM windows""",
    "w5_make_batches": f"""WITH {_windows(BLOCK + 1)} SELECT sample_id, sample_id // 8 AS step, sample_id % 8 AS row,
        sample_id // 32 AS optimizer_step, (sample_id // 8 + 1) % 4 = 0 AS updates,
        {_md5(_ids("left(h, 1024)"))} AS x_md5 FROM windows""",
    # Bytes of a character cut at either end become replacement characters.
    "w6_inspect_samples": rf"""WITH {_windows(BLOCK)},
        cut AS (SELECT *, regexp_extract(h, '^([89AB].)*') AS lead_part,
          regexp_extract(h, '([CD].|E.([89AB].)?|F.([89AB].)?([89AB].)?)$') AS tail_part FROM windows),
        shown AS (SELECT *, repeat('�', length(lead_part) // 2)
          || decode(unhex(substr(h, 1 + length(lead_part), length(h) - length(lead_part) - length(tail_part))))
          || CASE WHEN tail_part <> '' THEN '�' ELSE '' END AS t FROM cut)
        SELECT sample_id, start AS range_start, start + {BLOCK} AS range_end, length(t) > 500 AS truncated,
          md5(left(t, 500)) AS text_md5 FROM shown""",
    "w7_sample_records": f"""WITH {_windows(BLOCK)} SELECT sample_id, start AS start_index,
        array_to_string({_ids("left(h, 200)")}, ',') AS token_ids FROM windows""",
    "s12_samples_json": rf"""WITH {_windows(BLOCK)},
        cut AS (SELECT start, left(h, 200) AS h FROM windows),
        ends AS (SELECT *, regexp_extract(h, '^([89AB].)*') AS lead_part,
          regexp_extract(h, '([CD].|E.([89AB].)?|F.([89AB].)?([89AB].)?)$') AS tail_part FROM cut)
        SELECT start AS start_index, array_to_string({_ids("h")}, ',') AS token_ids,
          md5(repeat('�', length(lead_part) // 2)
          || decode(unhex(substr(h, 1 + length(lead_part), length(h) - length(lead_part) - length(tail_part))))
          || CASE WHEN tail_part <> '' THEN '�' ELSE '' END) AS text_md5 FROM ends""",
    "u3_sql_functions": """SELECT doc_id, round(exp(least(n_chars / 10000, 20)), 6) AS ppl,
        CASE WHEN s < 60 THEN printf('%.0fs', s) WHEN s < 3600 THEN printf('%.0fm', s / 60)
          WHEN s / 3600 < 24 THEN printf('%.1fh', s / 3600) ELSE printf('%.1fd', s / 3600 / 24) END AS took,
        md5(text) AS text_md5, length(text) AS n_codepoints
        FROM (SELECT *, n_chars + 0.25::DOUBLE AS s FROM documents)""",
}
