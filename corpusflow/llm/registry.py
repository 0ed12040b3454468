"""The registered queries of this package, by operator number, and SQL for those that SQL can express."""

from __future__ import annotations

from corpusflow.llm import chat, hard_negatives, hnsw, language_id, licences, merkle, mixing, mpeg_audio, ngram_join, pii, sentencepiece_codec, substring_dedup, token_output

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(k: int) -> str:
    """Words with position, and the k words that start at each."""
    parts = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, k))])
    return f"x AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p, len(ws) AS n FROM t), h AS (SELECT *, {parts} AS k FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY p))"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || {c} END"


def _leaf(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: Unsigned crc32 of a column's decimal digits.
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"


def _escaped(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|ROLE)\])', '[\\\1', 'g')"


def queries() -> dict:
    return {
        "op1_token_output": token_output.op1_token_output,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_licences": licences.op3_licences,
        "op4_mpeg_audio": mpeg_audio.op4_mpeg_audio,
        "op5_pii": pii.op5_pii,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_language_id": language_id.op7_language_id,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_hnsw": hnsw.op10_hnsw,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_chat_format": chat.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_ngram_join": f"""WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS ws FROM documents), {_runs(5)},
s AS (SELECT DISTINCT doc_id, k FROM h WHERE k IS NOT NULL UNION SELECT doc_id, len(ws) || ':' || array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS own FROM s GROUP BY doc_id), cl AS (SELECT own, min(doc_id) AS class_id FROM c GROUP BY own),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(max(c.n), 0)::BIGINT AS n_shingles, coalesce(max(class_id), r.doc_id) AS class_id, min(other) AS component_id FROM r LEFT JOIN c ON c.doc_id = r.doc_id LEFT JOIN cl USING (own) GROUP BY r.doc_id""",
        "op9_substring_dedup": f"""WITH t AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws FROM documents), {_runs(13)},
m AS (SELECT k, min(doc_id) AS least FROM h WHERE k IS NOT NULL GROUP BY k), d AS (SELECT h.doc_id, p, word, coalesce(least < h.doc_id, false) AS dup FROM h LEFT JOIN m USING (k)),
g AS (SELECT doc_id, p, word, max(dup::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM d)
SELECT o.doc_id, count(p) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256 FROM documents o LEFT JOIN g USING (doc_id) GROUP BY o.doc_id""",
            "op11_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, *
  FROM (SELECT lang, doc_id, {_leaf()} AS leaf, CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars::HUGEINT + 1)")} ELSE {_leaf()} END AS used FROM documents)),
a AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM d UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY tree, level, i // 2, n),
s AS (SELECT tree, h FROM a WHERE n = 1),
b AS (SELECT 0 AS level, tree AS i, (SELECT count(*) FROM s) AS n, h FROM s UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 2, n),
p AS (SELECT d.tree, d.i, 0 AS level, d.tree AS at, d.i AS k, d.n, d.used AS h, '' AS proof FROM d
  UNION ALL SELECT p.tree, p.i, CASE WHEN p.n = 1 THEN 0 ELSE p.level + 1 END, CASE WHEN p.n = 1 THEN -1 ELSE p.at END, CASE WHEN p.n = 1 THEN p.tree ELSE p.k // 2 END, CASE WHEN p.n = 1 THEN (SELECT count(*) FROM s) ELSE (p.n + 1) // 2 END,
    CASE WHEN p.n = 1 THEN p.h WHEN x.h IS NULL THEN sha256(p.h) WHEN p.k % 2 = 1 THEN sha256(x.h || p.h) ELSE sha256(p.h || x.h) END, CASE WHEN p.n = 1 THEN p.proof ELSE p.proof || coalesce(x.h, '') END
  FROM p LEFT JOIN (SELECT tree, level, i, h FROM a UNION ALL SELECT -1, level, i, h FROM b) x ON x.tree = p.at AND x.level = p.level AND x.i = xor(p.k, 1) AND p.n > 1 WHERE NOT (p.n = 1 AND p.at = -1)),
r AS (SELECT h AS root FROM b WHERE n = 1)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.root, sha256(p.proof) AS proof_sha256, p.h AS folded_root, p.h = r.root AS verified FROM d JOIN s USING (tree) JOIN p ON p.tree = d.tree AND p.i = d.i AND p.at = -1 AND p.n = 1, r""",
        "op12_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM g JOIN p USING (anchor_id)
WHERE label <> own AND {hard_negatives.LOWEST} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGHEST} * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {hard_negatives.NEGATIVES}""",
        "op13_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length({_escaped("text")}) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 ELSE 20 + length({_escaped("role")}) END)::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    }
