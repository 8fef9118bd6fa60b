"""The registered queries of the operators, with the parameters they run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import crc_mod, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.token_files import read_token_files, write_token_files

    manifest, folder = write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)
    return read_token_files(manifest, folder)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.quality import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold=crc_mod("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.toxicity import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold=crc_mod("doc_id", 4) != 2)
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_sentences", "n_offending")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.grid_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.shingle_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op9_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.phrase_prints import with_edits

    return with_edits(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.pieces import digest

    return digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.weak_rules import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.middle_fill import fill_in_middle, restored

    d = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{n}_sha256") for n, c in (("output", F.col("output")), ("restored", restored()))]
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_language, op3_quality, op4_packing, op5_toxicity, op6_near_vectors, op7_warc, op8_shingle_join, op9_phrase_prints, op10_pieces, op11_lexical_search, op12_quality_rules, op13_fill_in_middle)}

def _weak_rules_sql() -> str:
    """Counts, votes, and expectation-maximisation over the patterns of votes as a recursive query with a column for each chance."""
    from strandloom.llm import weak_rules as w

    ks, s = range(len(w.RULES)), w.PRIOR_TEXTS
    log_odds = "ln(share / (1 - share))" + "".join(f" + CASE v{k} WHEN 1 THEN ln(g{k} / (1 - b{k})) WHEN -1 THEN ln((1 - g{k}) / b{k}) ELSE 0 END" for k in ks)
    total = lambda k, v, q: f"sum(CASE WHEN v{k} = {v} THEN n * {q} ELSE 0 END)"
    good = [f"({total(k, 1, 'q')} + {s * w.RIGHT_GOOD}) / ({total(k, 1, 'q')} + {total(k, -1, 'q')} + {s})" for k in ks]
    bad = [f"({total(k, -1, '(1 - q)')} + {s * w.RIGHT_BAD}) / ({total(k, 1, '(1 - q)')} + {total(k, -1, '(1 - q)')} + {s})" for k in ks]
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS ws,
                   list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        ),
        f AS (
            SELECT doc_id, ws, len(ws) AS n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct, length(regexp_replace(x, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
                   len(list_filter(ws, lambda y: regexp_matches(y, '\\p{{L}}'))) AS n_lettered, length(regexp_replace(x, '[^.!?]+', '', 'g')) AS n_ends, row_number() OVER () AS k
            FROM w
        ),
        p AS (SELECT k, ws, unnest(range(len(ws) - {w.WINDOW - 1})) AS i FROM f WHERE len(ws) > {w.WINDOW}),
        u AS (SELECT k, i, ws[i + 1:i + {w.WINDOW}] AS t FROM p),
        r AS (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS same FROM u),
        e AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + {w.WINDOW})) AS j FROM r WHERE same > 1) GROUP BY k),
        c AS MATERIALIZED (SELECT f.* EXCLUDE (ws, k), coalesce(n_repeat_words, 0) AS n_repeat_words FROM f LEFT JOIN e USING (k)),
        v AS MATERIALIZED (SELECT *, {', '.join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{k}" for k, (_, good, bad) in enumerate(w.RULES))} FROM c),
        pat AS MATERIALIZED (SELECT {', '.join(f'v{k}' for k in ks)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
        em AS (
            SELECT 0 AS it, {w.SHARE}::DOUBLE AS share, {', '.join(f'{w.RIGHT_GOOD}::DOUBLE AS g{k}, {w.RIGHT_BAD}::DOUBLE AS b{k}' for k in ks)}
            UNION ALL
            SELECT it + 1, share, {', '.join(f'g{k}, greatest(b{k}, 1 - g{k})' for k in ks)} FROM (
                SELECT any_value(it) AS it, (sum(n * q) + {s * w.SHARE}) / (sum(n) + {s}) AS share, {', '.join(f'{good[k]} AS g{k}, {bad[k]} AS b{k}' for k in ks)}
                FROM (SELECT it, n, {', '.join(f'v{k}' for k in ks)}, 1 / (1 + exp(-({log_odds}))) AS q FROM em, pat WHERE it < {w.ROUNDS}) HAVING count(*) > 0)
        ),
        j AS (SELECT v.*, 1 / (1 + exp(-({log_odds}))) AS q, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v, em WHERE it = {w.ROUNDS})
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               base_failed, NOT base_failed AND q >= 0.5 AS kept
        FROM j
    """


_WEAK_RULES = _weak_rules_sql()

ORACLES: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN g.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM g.first_id THEN g.first_id END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100
    """,
    "op6_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
        ),
        u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT a AS v, b AS w FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.w = l.a),
        comp AS (SELECT v, min(least(v, w)) AS c FROM reach GROUP BY v),
        deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, e.vec_id = coalesce(c.c, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN deg d ON d.a = e.vec_id LEFT JOIN comp c ON c.v = e.vec_id
    """,
    "op8_shingle_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
        ),
        t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
              FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        half AS (SELECT a, b FROM o WHERE 100 * k >= 90 * (na + nb - k)),
        links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        reach AS (SELECT a AS v, b AS w FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.w = l.a),
        comp AS (SELECT v, min(least(v, w)) AS c FROM reach GROUP BY v)
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
        FROM s LEFT JOIN comp c ON c.v = s.doc_id
    """,
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             t AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
             c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                          CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
             p AS (SELECT doc_id, x, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
        FROM p
    """,
    "op12_quality_rules": _WEAK_RULES,
    "op11_lexical_search": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
             h AS MATERIALIZED (SELECT doc_id, r, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
             a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM h),
             i AS (SELECT item_id, row_number() OVER () AS x, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
             q AS MATERIALIZED (SELECT x, item_id, t, count(*)::BIGINT AS c FROM (SELECT x, item_id, unnest(ts) AS t FROM i) GROUP BY ALL),
             p AS MATERIALIZED (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM h) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
             f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t), a),
             g AS (SELECT p.*, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS g FROM p JOIN f USING (t), a),
             s AS (SELECT x, item_id, r, doc_id, sum(c * g)::BIGINT AS score FROM q JOIN g USING (t) WHERE doc_id IS NOT NULL GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY x ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, doc_id) <= 10
    """,
}
