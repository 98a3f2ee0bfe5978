"""DuckDB statements that compute what the queries of ``training`` compute."""

from __future__ import annotations

from tokenloom.catalog.corpus_sql import _TOTALS, BYTES, POINTS, RUN_TABLE, _ids, _md5

_NL = "chr(10)"
_PREAMBLE = ("'Below is an instruction that describes a task. "
             "Write a response that appropriately completes the request.'")
PAIRS = """
led AS (SELECT conv_id, turn, role, text AS instruction, lead(text) OVER w AS output, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, instruction, output FROM led WHERE role = 'user' AND next_role = 'assistant')
"""
PROMPT = (f"{_PREAMBLE} || {_NL} || {_NL} || '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} "
          f"|| '### Response:' || {_NL}")
MASKED = f"""{PAIRS}, tokens AS (SELECT conv_id, turn, {_ids(f'hex(encode({PROMPT}))')} AS p, {_ids('hex(encode(output))')} AS r FROM pairs),
masked AS (SELECT conv_id, turn, list_concat(p, r) AS ids, list_concat([-100 for x in p], r) AS labels FROM tokens)"""

BATCHES = """
mixed AS (SELECT doc_id, octet_length(encode(text)) AS n,
          row_number() OVER (ORDER BY ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT, doc_id) - 1 AS i FROM documents),
ranked AS (SELECT doc_id, n, i // 200 AS pool, row_number() OVER (PARTITION BY i // 200 ORDER BY n DESC, doc_id) - 1 AS r FROM mixed),
batches AS (SELECT doc_id, n, pool * 50 + r // 4 AS batch_id FROM ranked)
"""

BIGRAMS = f"""
byte_ids AS (SELECT doc_id, {BYTES} AS ids FROM documents),
grams AS (SELECT doc_id, unnest(ids[1:len(ids) - 1]) AS context, unnest(ids[2:]) AS token_id FROM byte_ids),
counts AS (SELECT context, token_id, count(*) AS n FROM grams GROUP BY ALL)
"""
LOSSES = f"""{BIGRAMS},
contexts AS (SELECT context, sum(n) AS c FROM counts GROUP BY 1),
per_row AS (SELECT doc_id, context, token_id, count(*) AS times FROM grams GROUP BY ALL),
losses AS (SELECT doc_id, sum(times)::BIGINT AS n_pairs, sum(times * -ln((n + 1.0) / (c + 256.0))) / sum(times) AS loss
           FROM per_row JOIN counts USING (context, token_id) JOIN contexts USING (context) GROUP BY 1)
"""


def _model(temperature: float, top_k: int) -> str:
    return f"""{BIGRAMS},
with_marginal AS (SELECT * FROM counts UNION ALL SELECT -1, token_id, sum(n) FROM counts GROUP BY token_id),
kept AS (SELECT * FROM with_marginal QUALIFY rank() OVER (PARTITION BY context ORDER BY n DESC) <= {top_k}),
weighed AS (SELECT *, pow(n::DOUBLE, 1.0::DOUBLE / {temperature}::DOUBLE) AS w FROM kept),
cdf AS (SELECT context, token_id, n, sum(w) OVER (PARTITION BY context ORDER BY n DESC, token_id ROWS UNBOUNDED PRECEDING)
        / sum(w) OVER (PARTITION BY context) AS cum FROM weighed),
model AS (SELECT context, list(token_id ORDER BY n DESC, token_id) AS tokens, list(cum ORDER BY n DESC, token_id) AS cum
          FROM cdf GROUP BY 1)
"""


def _generation(prompts: str, stop: int) -> str:
    """Recursion over steps for ``prompts(prompt_id, context, max_new)``."""
    return f"""prompts AS ({prompts}),
gen AS (
  SELECT prompt_id, max_new, 0 AS step, context, []::INTEGER[] AS produced, TRUE AS live FROM prompts
  UNION ALL
  SELECT prompt_id, max_new, step + 1, token, CASE WHEN token = {stop} THEN produced ELSE list_append(produced, token) END,
         token <> {stop}
  FROM (SELECT g.*, coalesce(m.tokens, f.tokens) AS t, coalesce(m.cum, f.cum) AS c,
          ('0x' || substr(md5('7:' || prompt_id || ':' || (step + 1)), 1, 13))::BIGINT / pow(2.0::DOUBLE, 52) AS u,
          t[least(len([x for x in c if x < u]) + 1, len(t))]::INTEGER AS token
        FROM gen g LEFT JOIN model m ON m.context = g.context JOIN model f ON f.context = -1
        WHERE live AND step < max_new)),
done AS (SELECT prompt_id, arg_max(produced, step) AS produced FROM gen GROUP BY 1)"""


LINES = """
train_lines AS (
  SELECT run, 2 * line_no AS line_no, 'Iter ' || printf('%5d', iteration) || '/' || total || ' | Loss: ' || printf('%.4f', loss)
    || ' | PPL: ' || printf('%.2f', loss + 1) || ' | LR: ' || k || 'e-06 | ' || format('{:,}', k * 1234) || ' tok/s' AS line FROM points
  UNION ALL SELECT run, 2 * line_no + 1, 'Iter note | Loss: none ' || iteration FROM points)
"""

ROLLING = """
rolling AS (SELECT run, iteration, total, loss, CASE WHEN count(*) OVER w = 10 THEN sum(loss) OVER w / 10 END AS recent_avg FROM points
            WINDOW w AS (PARTITION BY run ORDER BY iteration ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
"""
STOPPING = f"""{POINTS}, {ROLLING},
evals AS (SELECT run, iteration, recent_avg, row_number() OVER (PARTITION BY run ORDER BY iteration) AS i
          FROM rolling WHERE recent_avg IS NOT NULL AND iteration % 500 = 0),
fold AS (
  SELECT DISTINCT run, 0::BIGINT AS i, NULL::BIGINT AS iteration, NULL::DOUBLE AS recent_avg, FALSE AS improved,
         'Infinity'::DOUBLE AS best_loss, NULL::BIGINT AS best_iteration, 0 AS counter, FALSE AS stopped FROM evals
  UNION ALL
  SELECT e.run, e.i, e.iteration, e.recent_avg, e.recent_avg < f.best_loss - 0.01::DOUBLE,
         CASE WHEN e.recent_avg < f.best_loss - 0.01::DOUBLE THEN e.recent_avg ELSE f.best_loss END,
         CASE WHEN e.recent_avg < f.best_loss - 0.01::DOUBLE THEN e.iteration ELSE f.best_iteration END,
         CASE WHEN e.recent_avg < f.best_loss - 0.01::DOUBLE THEN 0 ELSE f.counter + 1 END,
         NOT (e.recent_avg < f.best_loss - 0.01::DOUBLE) AND f.counter + 1 >= 5
  FROM fold f JOIN evals e ON e.run = f.run AND e.i = f.i + 1 WHERE NOT f.stopped),
outcome AS (SELECT * FROM fold WHERE i > 0)
"""
_STOP_ROWS = f"""WITH RECURSIVE {STOPPING} SELECT run, iteration, round(recent_avg, 6) AS recent_avg, improved,
    round(best_loss, 6) AS best_loss, best_iteration, counter, stopped FROM outcome"""

GPU = """
numbers AS (SELECT event_id, event_type AS run, ts, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k FROM events),
gpu AS (SELECT event_id, run, ts, k::DOUBLE AS gpu_util, (1000 * k)::DOUBLE AS mem_used, 80000::DOUBLE AS mem_total,
          (40 + k % 60)::DOUBLE AS temp, (7 * k)::DOUBLE AS power
        FROM numbers WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)
"""


def _bar(value: str, top: str) -> str:
    filled = f"trunc({value} / {top} * 40)::INT"
    return f"repeat('█', greatest({filled}, 0)) || repeat('░', greatest(40 - {filled}, 0))"


def _gpu_windows(having: str = "") -> str:
    means = ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in ("gpu_util", "mem_used", "mem_total", "temp", "power"))
    return f"""WITH {GPU} SELECT run, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start,
        count(*) AS readings, {means}, max(temp) AS max_temp FROM gpu GROUP BY run, date_trunc('hour', ts) {having}"""


def _duration(s: str) -> str:
    return (f"CASE WHEN {s} < 60 THEN printf('%.0fs', {s}) WHEN {s} < 3600 THEN printf('%.0fm', {s} / 60) "
            f"WHEN {s} / 3600 < 24 THEN printf('%.1fh', {s} / 3600) ELSE printf('%.1fd', {s} / 3600 / 24) END")


_WAVE = "0.1::DOUBLE + (1 - 0.1::DOUBLE) * ((cos(pi() * ({step} - {warm}) / ({total} - {warm})) + 1) / 2)"
_EMBEDDED = "[x::DOUBLE for x in embedding]"
_TRAIN_PARSED = """iteration, total, loss, printf('%.2f', loss + 1)::DOUBLE AS ppl, (k || 'e-06')::DOUBLE AS lr,
    k * 1234 AS tok_per_s FROM points"""

SQL = {
    "f1_render_sft": f"""WITH {PAIRS}, r AS (SELECT *, {PROMPT} || output AS t FROM pairs)
        SELECT conv_id, turn, length(t) AS chars, md5(t) AS text_md5 FROM r""",
    "f2_pair_turns": f"""WITH {PAIRS} SELECT conv_id, turn, md5(instruction) AS instruction_md5, md5(output) AS output_md5 FROM pairs""",
    "f3_mask_prompt": f"""WITH {MASKED} SELECT conv_id, turn, {_md5('ids')} AS ids_md5, {_md5('labels')} AS labels_md5 FROM masked""",
    "f4_truncate_pad": f"""WITH {MASKED} SELECT conv_id, turn, {_md5('list_resize(ids[1:1024], 1024, 0)')} AS ids_md5,
        {_md5('list_resize(labels[1:1024], 1024, -100)')} AS labels_md5, least(len(ids), 1024) AS used FROM masked""",
    "f5_length_group_batches": f"WITH {BATCHES} SELECT doc_id, n, batch_id FROM batches",
    "f5_padding_waste": f"""WITH {BATCHES} SELECT batch_id, count(*) AS rows, max(n) AS max_len, sum(n)::BIGINT AS used,
        (count(*) * max(n) - sum(n))::BIGINT AS padding FROM batches GROUP BY 1""",
    "u1_apply_formatter": f"""WITH {PAIRS} SELECT conv_id, turn,
        md5('Q (' || length(instruction) || '): ' || instruction || {_NL} || 'A: ' || output) AS text_md5 FROM pairs""",
    "m1_fit_ngrams": f"WITH {BIGRAMS} SELECT context, token_id, n FROM counts",
    "m1_fit_trigrams": f"""WITH byte_ids AS (SELECT {BYTES} AS ids FROM documents),
        grams AS (SELECT unnest(ids[1:len(ids) - 2]) AS a, unnest(ids[2:len(ids) - 1]) AS b, unnest(ids[3:]) AS token_id FROM byte_ids)
        SELECT a * 256 + b AS context, token_id, count(*) AS n FROM grams GROUP BY ALL""",
    "m2_cross_entropy": f"WITH {LOSSES} SELECT doc_id, n_pairs, round(loss, 6) AS loss FROM losses",
    "m2_cross_entropy_total": f"""WITH {LOSSES}, t AS (SELECT sum(n_pairs)::BIGINT AS n_pairs, sum(loss * n_pairs) / sum(n_pairs) AS loss FROM losses)
        SELECT n_pairs, round(loss, 6) AS loss, round(exp(least(loss, 20)), 6) AS ppl FROM t""",
    "m3_perplexity": """SELECT event_id, round(exp(least(value / 10, 20)), 3) AS ppl,
        round(pow(2.0::DOUBLE, value / 10 / 10), 6) AS ppl_base2 FROM events""",
    "m4_next_token_probs": """WITH l AS (SELECT vec_id AS prompt_id, unnest(range(len(embedding))) AS token_id,
          unnest(embedding)::DOUBLE * 10 / 0.8::DOUBLE AS z FROM embeddings),
        kept AS (SELECT * FROM l QUALIFY rank() OVER (PARTITION BY prompt_id ORDER BY z DESC) <= 40),
        raised AS (SELECT *, exp(z - max(z) OVER (PARTITION BY prompt_id)) AS e FROM kept)
        SELECT prompt_id, token_id, round(e / sum(e) OVER (PARTITION BY prompt_id), 8) AS prob FROM raised""",
    "m5_continuations": f"""WITH {_model(0.8, 40)} SELECT context, array_to_string(tokens, ',') AS tokens,
        array_to_string([floor(c * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT for c in cum], ',') AS cum_millionths FROM model""",
    "m5_generate": f"""WITH RECURSIVE {_model(0.8, 40)}, {_generation(
        "SELECT item_id AS prompt_id, ('0x' || right(hex(encode(text)), 2))::INT AS context, 64 AS max_new FROM benchmark", -5)}
        SELECT prompt_id, octet_length(encode(text)) AS n_prompt, array_to_string(produced, ',') AS produced
        FROM done JOIN benchmark ON item_id = prompt_id""",
    "m6_prompt_suite": f"""WITH RECURSIVE {_model(0.7, 40)}, {_generation(
        "SELECT 'item_' || item_id AS prompt_id, ('0x' || right(hex(encode(text)), 2))::INT AS context, "
        "100 + item_id % 3 * 50 AS max_new FROM benchmark WHERE item_id % 10 NOT IN (3, 7, 8)", 46)},
        joined AS (SELECT 'item_' || item_id AS name, item_id, item_id % 10 IN (3, 7, 8) AS blank,
          hex(encode(text)) || array_to_string([printf('%02X', i) for i in produced], '') AS h
          FROM benchmark LEFT JOIN done ON prompt_id = 'item_' || item_id),
        cut AS (SELECT *, regexp_extract(h, '([CD].)$') AS tail_part FROM joined)
        SELECT name, CASE WHEN NOT blank THEN md5(decode(unhex(left(h, length(h) - length(tail_part))))
            || CASE WHEN tail_part <> '' THEN '�' ELSE '' END) END AS output_md5,
          CASE item_id % 10 WHEN 3 THEN 'empty prompt' WHEN 7 THEN 'negative token limit: -' || item_id WHEN 8 THEN 'no token limit' END AS error
        FROM cut""",
    "s8_append_metrics": f"""WITH {POINTS} SELECT run, 'train/loss' AS tag, iteration AS step, loss AS value FROM points
        UNION ALL SELECT run, 'train/k', iteration, k::DOUBLE FROM points""",
    "s9_append_samples": f"""WITH {PAIRS} SELECT 'sft' AS run, conv_id * 100 + turn AS step, md5(instruction) AS prompt_md5,
        md5(left(output, 512)) AS generated_md5, left(output, 256) || CASE WHEN length(output) > 256 THEN '...' ELSE '' END AS display FROM pairs""",
    "s10_read_log": f"""WITH {POINTS}, {LINES}, placed AS (SELECT run, 2 * (line_no // 200 - 1) + line_no % 200 AS i, line FROM train_lines)
        SELECT run, i // 20000 AS part, i % 20000 AS line_no, line FROM placed""",
    "s11_read_telemetry": f"WITH {GPU} SELECT event_id, gpu_util, mem_used, mem_total, temp, power FROM gpu",
    "l1_parse_train_lines": f"WITH {POINTS} SELECT run, {_TRAIN_PARSED}",
    "l2_parse_monitor_lines": f"""WITH {POINTS} SELECT run, iteration, total, loss,
        CASE WHEN k % 5 <> 0 THEN k + 0.25::DOUBLE END AS time_per_iter, CASE WHEN k % 7 <> 0 THEN (k || 'e-05')::DOUBLE END AS lr
        FROM points WHERE k % 7 = 0 OR k % 11 <> 0""",
    "l1_l2_parse_points": f"""WITH {POINTS} SELECT run, iteration, 1 + (k % 7 = 0 OR k % 11 <> 0)::INT AS lines, loss FROM points""",
    "l3_parse_events": f"""WITH {POINTS} SELECT run,
        ['best_checkpoint', 'no_improvement', 'stopped', 'best_loss', 'idle', 'sample'][k % 7 + 1] AS event,
        CASE WHEN k % 7 IN (2, 5) THEN iteration END AS iteration, CASE WHEN k % 7 IN (0, 1, 3) THEN loss END AS loss,
        CASE WHEN k % 7 = 1 THEN k END AS counter, CASE k % 7 WHEN 1 THEN 100 WHEN 2 THEN total END AS limit,
        CASE WHEN k % 7 = 4 THEN iteration END AS idle_iterations,
        CASE WHEN k % 7 = 0 THEN 'models/best_' || iteration || '.pt' END AS path FROM points WHERE k % 7 < 6""",
    "l4_tail_lines": f"""WITH {POINTS}, {LINES} SELECT run, line_no, line FROM train_lines
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 100""",
    "l5_current_status": f"""WITH {POINTS} SELECT run, iteration, total, loss / 64 AS loss, lr, time_per_iter,
        round(iteration / total * 100, 6) AS progress_pct, round(exp(least(loss / 64, 20)), 6) AS ppl,
        round(pow(2.0::DOUBLE, loss / 64), 6) AS ppl_base2 FROM points
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) = 1""",
    "l6_loss_change": f"""WITH {POINTS}, d AS (SELECT run, iteration, loss - lag(loss) OVER (PARTITION BY run ORDER BY line_no) AS change FROM points)
        SELECT run, iteration, round(change, 6) AS change, CASE WHEN change > 0 THEN 'up' ELSE 'down' END AS trend FROM d WHERE change IS NOT NULL""",
    "l7_sparkline": f"""WITH {POINTS}, recent AS (SELECT run, line_no, loss FROM points
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 20),
        ranged AS (SELECT *, min(loss) OVER (PARTITION BY run) AS lo, max(loss) OVER (PARTITION BY run) AS hi FROM recent)
        SELECT run, CASE WHEN count(*) < 2 OR min(lo) = max(hi) THEN repeat('─', 20) ELSE
          string_agg(substr('▁▂▃▄▅▆▇█', trunc((loss - lo) / (hi - lo) * 7)::INT + 1, 1), '' ORDER BY line_no) END AS sparkline
        FROM ranged GROUP BY run""",
    "l8_eta": f"""WITH {POINTS}, last AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) = 1),
        e AS (SELECT run, (total * 2 - iteration) * time_per_iter AS s FROM last WHERE time_per_iter <> 0)
        SELECT run, round(s, 6) AS eta_seconds, {_duration('s')} AS eta,
          strftime(TIMESTAMP '2024-06-01 12:00:00' + to_milliseconds(floor(s * 1000)::BIGINT), '%Y-%m-%d %H:%M') AS completion FROM e""",
    "l9_format_duration": f"""WITH d AS (SELECT event_id, event_id * 37 + 0.26::DOUBLE AS s FROM events)
        SELECT event_id, {_duration('s')} AS took FROM d""",
    "l10_recent_history": f"""WITH {POINTS}, recent AS (SELECT *, count(*) OVER (PARTITION BY run) AS c FROM points
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 5)
        SELECT run, iteration, loss, CASE WHEN k % 2 = 0 THEN printf('%.2fs', k + 0.25::DOUBLE) ELSE 'N/A' END AS time_text
        FROM recent WHERE c >= 5""",
    "l11_lr_audit": f"""WITH {RUN_TABLE}, {POINTS}, j AS (SELECT run, iteration, points.lr AS logged, runs.lr::DOUBLE AS base,
          iteration // grad_accum_steps AS step, trunc(iterations * warmup_ratio::DOUBLE)::BIGINT AS warm, iterations AS total,
          min_lr_ratio::DOUBLE AS floor_ratio FROM points LEFT JOIN runs USING (run)),
        m AS (SELECT *, base * CASE WHEN step < warm THEN step / warm ELSE
          floor_ratio + (1 - floor_ratio) * ((cos(pi() * (step - warm) / (total - warm)) + 1) / 2) END AS expected FROM j)
        SELECT run, iteration, step AS scheduler_step, round(expected, 12) AS expected_lr, round(abs(logged - expected), 12) AS abs_diff FROM m""",
    "l12_early_stopping": _STOP_ROWS,
    "l13_rolling_loss": f"WITH {POINTS}, {ROLLING} SELECT run, iteration, round(recent_avg, 6) AS recent_avg FROM rolling",
    "l14_best_checkpoint": f"""WITH RECURSIVE {RUN_TABLE}, {STOPPING}, best AS (SELECT run, max(iteration) AS iteration,
          arg_max(recent_avg, iteration) AS loss FROM outcome WHERE improved GROUP BY run)
        SELECT run, iteration, round(loss, 6) AS loss, vocab_size, block_size, n_layers, d_model, n_heads, dropout::DOUBLE AS dropout
        FROM best LEFT JOIN runs USING (run)""",
    "l15_early_stop_savings": f"""WITH RECURSIVE {RUN_TABLE}, {STOPPING},
        ended AS (SELECT run, max(iteration) AS ended_at, bool_or(stopped) AS stopped FROM outcome GROUP BY run),
        r AS (SELECT run, iterations AS planned, CASE WHEN stopped THEN ended_at ELSE iterations END AS iterations_run,
          coalesce(stopped, FALSE) AS stopped FROM runs LEFT JOIN ended USING (run))
        SELECT run, planned, iterations_run, round(1 - iterations_run / planned, 6) AS saved_share,
          CASE WHEN stopped THEN 2500 ELSE 0 END AS idle_iterations, round(planned * (12.0::DOUBLE / 3600), 6) AS planned_cost,
          round(iterations_run * (12.0::DOUBLE / 3600), 6) AS cost FROM r""",
    "l16_auto_step": f"""WITH {POINTS} SELECT run, event_id AS call_no, CASE WHEN k % 3 > 0 THEN iteration ELSE
        count(*) FILTER (k % 3 = 0) OVER (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 END AS step,
        loss AS value FROM points""",
    "l17_l2_norm": f"""WITH v AS (SELECT label, unnest({_EMBEDDED}) AS x FROM embeddings)
        SELECT label, round(sqrt(sum(x * x)), 6) AS norm FROM v GROUP BY label""",
    "l18_value_histograms": f"""WITH v AS (SELECT label, unnest({_EMBEDDED}) AS x FROM embeddings),
        r AS (SELECT *, min(x) OVER (PARTITION BY label) AS lo, max(x) OVER (PARTITION BY label) AS hi FROM v)
        SELECT label, least(floor((x - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM r GROUP BY ALL""",
    "l19_compare_runs": f"WITH {POINTS} SELECT iteration AS step, " + ", ".join(
        f"max(CASE WHEN run = '{r}' THEN loss END) AS \"{r}\"" for r in ("click", "error", "purchase", "signup", "view"))
        + " FROM points GROUP BY 1",
    "l20_runs_with_config": f"""WITH {RUN_TABLE}, {POINTS}, last AS (SELECT run, 'train/loss' AS tag, max(iteration) AS last_step,
          arg_max(loss, iteration) AS last_value FROM points GROUP BY run)
        SELECT run, n_layers || 'L-' || d_model || 'd' AS name, n_layers, d_model, lr::DOUBLE AS lr, tag, last_step, last_value
        FROM runs LEFT JOIN last USING (run)""",
    "u2_apply_schedule": f"""WITH {POINTS} SELECT run, iteration, pow(0.5::DOUBLE, iteration // 50000) AS multiplier,
        round(CASE WHEN iteration < 450 THEN iteration / 450 ELSE
        {_WAVE.format(step='iteration', warm=450, total=250000)} END, 9) AS cosine FROM points""",
    "g1_g2_g3_gpu_panel": f"""WITH {GPU} SELECT event_id, round(mem_used / mem_total * 100, 6) AS mem_pct,
        CASE WHEN temp < 70 THEN 'green' WHEN temp < 85 THEN 'amber' ELSE 'red' END AS temp_status,
        {_bar('gpu_util', '100')} AS gpu_bar, {_bar('mem_used', 'mem_total')} AS mem_bar, {_bar('temp', '100')} AS temp_bar,
        {_bar('power', '700')} AS power_bar FROM gpu""",
    "g4_cost_tracking": f"""WITH {GPU}, h AS (SELECT run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::DOUBLE AS hours FROM gpu GROUP BY run)
        SELECT run, round(hours, 6) AS hours, round(hours * 2.69::DOUBLE, 6) AS cost, round(800 * 2.69::DOUBLE, 6) AS estimated_cost,
        round(greatest(0, 800 - hours), 6) AS remaining_hours FROM h""",
    "g5_run_liveness": f"""WITH {GPU}, m AS (SELECT max(ts) AS now FROM gpu)
        SELECT run, CASE WHEN (epoch_us(any_value(now)) - epoch_us(max(ts))) / 1e6 <= 600 THEN 'TRAINING' ELSE 'STOPPED' END AS status
        FROM gpu, m GROUP BY run""",
    "r1_stream_log_points": f"""WITH {POINTS}, {LINES}, placed AS (SELECT run, line_no, part,
          (sum(strlen(line) + 1) OVER (PARTITION BY run, part ORDER BY line_no) - strlen(line) - 1)::BIGINT AS position
          FROM (SELECT *, (2 * (line_no // 200 - 1) + line_no % 200) // 20000 AS part FROM train_lines))
        SELECT run, part, position, {_TRAIN_PARSED} JOIN (SELECT run, line_no // 2 AS line_no, part, position FROM placed
          WHERE line_no % 2 = 0) USING (run, line_no)""",
    "r2_batch_telemetry": _gpu_windows(),
    "r2_stream_telemetry": _gpu_windows(
        "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM gpu)"),
    "r3_stream_early_stopping": _STOP_ROWS.replace("counter, stopped FROM outcome", "counter, stopped, 0 AS late_points FROM outcome"),
    "r4_stream_token_totals": f"SELECT lang, {_TOTALS} FROM documents GROUP BY lang",
}
