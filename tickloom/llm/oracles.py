"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from tickloom.llm import chat
from tickloom.llm.quality_rules import Limits

WORD = r"[^\x20\x09-\x0D]"


def chat_sql() -> str:
    """Turns in order, digests, and the length of the rendering."""
    escaped = lambda x: f"length(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))"
    marks = len(chat.HEAD) + len(chat.HEAD_END) + len(chat.END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    lost = f"coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')"
    return f"""WITH every AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(length({lost}) AS BIGINT) AS loss_chars,
        sha256({lost}) AS loss_sha256, CAST({len(chat.BEGIN)} + sum({marks} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars FROM every GROUP BY conv_id"""


def rules_sql(limits: Limits = Limits()) -> str:
    """All measures and the verdict; n-grams are strings of their words here, and not hashes."""
    dup, top = dict(limits.dup), dict(limits.top)
    sizes = sorted({5, *dup, *top})
    parts, columns = [], []
    for k in sizes:
        back = f"(PARTITION BY r ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"""g{k} AS (SELECT r, i, size, CASE WHEN i + {k - 1} <= n THEN array_to_string(list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING), ' ') END AS gram FROM w JOIN n USING (r)),
          c{k} AS (SELECT *, CASE WHEN gram IS NOT NULL THEN count(*) OVER (PARTITION BY r, gram) ELSE 0 END AS c FROM g{k}),
          t{k} AS (SELECT *, first_value(gram) OVER (PARTITION BY r ORDER BY c DESC, i) AS best, max(c) OVER (PARTITION BY r) AS most FROM c{k}),
          v{k} AS (SELECT r, size, max(CAST(c >= 2 AS INTEGER)) OVER {back} AS twice, max(CAST(most >= 3 AND gram IS NOT NULL AND gram = best AS INTEGER)) OVER {back} AS often FROM t{k}),
          s{k} AS (SELECT r, sum(twice) AS words, sum(size * twice)::DOUBLE / sum(size) AS dup, sum(size * often)::DOUBLE / sum(size) AS top FROM v{k} GROUP BY r)""")
        columns.append(f"s{k}")
    joins = " ".join(f"LEFT JOIN {c} ON {c}.r = d.r" for c in columns)
    dups = "greatest(0, " + ", ".join(f"coalesce(s{k}.dup, 0)" for k in dup) + ")"
    tops = "greatest(0, " + ", ".join(f"coalesce(s{k}.top, 0)" for k in top) + ")"
    bad = " OR ".join([*(f"coalesce(s{k}.dup, 0) > {v}" for k, v in dup.items()), *(f"coalesce(s{k}.top, 0) > {v}" for k, v in top.items())])
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      w0 AS (SELECT r, regexp_extract_all(text, '{WORD}+') AS ws FROM d), w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, length(unnest(ws)) AS size FROM w0),
      n AS (SELECT r, count(*) AS n, sum(size) AS chars FROM w GROUP BY r),
      l0 AS (SELECT r, string_split(text, chr(10)) AS ls FROM d), l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
      l1 AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '{WORD}')),
      lines AS (SELECT r, count(*) AS n, sum(length(line)) AS chars FROM l1 WHERE k > 1 GROUP BY r),
      {', '.join(parts)},
      m AS (SELECT doc_id, coalesce(n.n, 0) AS n_words, coalesce(n.chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
        coalesce(s5.words, 0) AS n_repeat_words, coalesce(lines.chars, 0)::DOUBLE / greatest(1, length(text)) AS line_share, {dups} AS dup_share, {tops} AS top_share, ({bad}) AS odd
        FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN lines ON lines.r = d.r {joins}),
      b AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words_percent} * n_words AS failed FROM m)
      SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed, round(line_share, 6) AS dup_line_share, round(dup_share, 6) AS dup_gram_share, round(top_share, 6) AS top_gram_share,
        NOT (failed OR odd OR line_share > {limits.line} OR n_symbols > {limits.symbols} * n_words) AS kept FROM b"""


def usable_sql(scale: int, width: int = 64) -> str:
    """Embeddings as whole numbers, with a number for each row."""
    return f"""SELECT *, row_number() OVER () AS r, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""


def negatives_sql() -> str:
    return f"""WITH base AS MATERIALIZED (SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({usable_sql(256)}) WHERE vec_id IS NOT NULL AND label IS NOT NULL),
      s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM base a JOIN base c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
      p AS (SELECT r, id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
      SELECT s.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY r, k ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s USING (r) WHERE NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""


def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds one after the other."""
    parts = []
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM
          (SELECT x.r, m.c, sum((x.x - m.x) * (x.x - m.x)) AS distance FROM x JOIN c{n} m USING (d) GROUP BY 1, 2) GROUP BY 1)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, d, coalesce(n.x, m.x) AS x FROM c{n} m LEFT JOIN
              (SELECT c, d, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM x JOIN a{n} USING (r) GROUP BY 1, 2) n USING (c, d))""")
    return f"""WITH kept AS MATERIALIZED ({usable_sql(1024)}), x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
      f AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k}), c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM f),
      {", ".join(parts)}, names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS name FROM c{rounds} GROUP BY 1)
      SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, name AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN names USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": chat_sql(), "op10_quality_rules": rules_sql(), "op11_hard_negatives": negatives_sql(), "op13_centroid_clustering": clusters_sql()}
