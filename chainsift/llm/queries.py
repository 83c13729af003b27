"""Registered queries of the operators: each applies one to its whole table; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsift.llm import chat, decontaminate, langid, ngramjoin, nndescent, personal, prefixbpe, quality, spelling, suffixdedup, turnrepair, urlfilter, wavelet
from chainsift.llm.common import table

TEMPLATE_CLASH = "</s>[INST] ok [/INST]"
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))[0]


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TEMPLATE_CLASH), (-7, 1, "assistant", TEMPLATE_CLASH)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_paths(chat.paths(turns.union(extra)))).drop("branch")


def vocabulary() -> str:
    """Place of the byte-level vocabulary; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), vocabulary()))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefixbpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


#: Words of a repeated passage that op7 also shows.
PASSAGE_WORDS = 51


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns judge 400-byte strings; n_passage_bytes counts bytes in repeated passages of over 50 words."""
    marked = suffixdedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), PASSAGE_WORDS)
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return marked.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        covered("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        covered("passages").alias("n_passage_bytes"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(langid.training(docs))
    texts = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(texts, filters).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: op11 takes a letter out of every run whose crc32 this divides.
MISSPELT = 199


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), MISSPELT))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kept, reports = turnrepair.repair(turnrepair.damage(turns))
    reports = reports.join(turnrepair.hashes(kept), "key", "left").withColumnRenamed("conv_id", "id").drop("key")
    ids = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    whole = ids.join(reports, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the pattern spans, ``spans`` lists all, n_added counts the tagger's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find(docs, personal.fit(docs))
    base = F.filter("personal", lambda s: s.base)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda kind: F.filter(base, lambda s: s.kind == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    added = F.size("personal") - F.size(base)
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("personal")).alias("spans"), added.cast("long").alias("n_added"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_wavelet_matrix": op4_wavelet_matrix,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_personal_data": op13_personal_data,
}

_ESCAPE = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"

#: The 256 steps of crc32, from its polynomial.
_CRC_STEPS = """SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i)"""


def _crc(text: str) -> str:
    """crc32 of the UTF-8 bytes of an SQL text, beside a column ``steps``."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(strlen({text})), lambda k: {byte})), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = {
    "op3_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '{TEMPLATE_CLASH}'), (-7, 1, 'assistant', '{TEMPLATE_CLASH}'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(20 + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')})) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_url_filter": """
        WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
        u AS (SELECT row_number() OVER () AS n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
        r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        hit AS (SELECT n, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC) AS k
                FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
        FROM u LEFT JOIN (SELECT * FROM hit WHERE k = 1) h ON h.n = u.n""",
    "op11_spelling": f"""
        WITH RECURSIVE t AS ({_CRC_STEPS}),
        r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents),
        g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS c FROM r GROUP BY ALL),
        h AS MATERIALIZED (SELECT run, c, {_crc('named')} AS h FROM g, t),
        d AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
        v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        o AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (
            SELECT DISTINCT a.word, b.word AS x, b.n AS x_n FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.rest = v.word
            UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.rest = v.word),
        best AS (SELECT word, count(*) AS n_near, max(x_n) AS m, min(x) FILTER (x_n = top) AS x
                 FROM (SELECT *, max(x_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN x END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
              FROM v LEFT JOIN best ON v.word = best.word),
        up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.next = f.word)
        SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN (SELECT word, root FROM up WHERE next IS NULL) e ON e.word = f.word""",
    "op12_conversation_repair": f"""
        WITH RECURSIVE steps_of AS ({_CRC_STEPS}),
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations),
        f AS MATERIALIZED (SELECT conv_id, turn, role, text, {_crc('named')} % 20 AS fault FROM c, steps_of),
        d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS k
              FROM f WHERE fault <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS occurrence, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM d),
        j AS MATERIALIZED (SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS r, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) AS r0,
                CASE WHEN body = '' THEN 1 WHEN occurrence > 1 THEN 2 WHEN substr(body, -1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
        s AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM j GROUP BY conv_id),
        m(a, b, letter) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
        inserted(a, b, more, audit, said) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:'), (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'),
            (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:')),
        p AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, b AS state, CAST(more AS BIGINT) AS cost, audit, said FROM (SELECT DISTINCT conv_id FROM j), inserted WHERE a = 0
            UNION ALL
            SELECT conv_id, i, state, least.cost, least.audit, least.said FROM (
                SELECT conv_id, i, e.b AS state, min({{'cost': cost + e.more, 'audit': q.audit || e.audit, 'said': q.said || e.said}}) AS least FROM (
                    SELECT p.conv_id, j.i, p.state, p.cost + 3 AS cost, p.audit || 'D' AS audit, said
                    FROM p JOIN j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = p.i + 1
                    UNION ALL
                    SELECT p.conv_id, j.i, m.b, p.cost + (fault = 3)::INT + CASE WHEN kept.k THEN 0 ELSE 2 END, p.audit || CASE WHEN kept.k THEN 'K' ELSE 'R' END,
                        said || CASE WHEN p.state = 0 THEN '' ELSE chr(10) END || CASE WHEN kept.k THEN role WHEN letter = 'u' THEN 'user' ELSE 'assistant' END || ':' || text
                    FROM p JOIN j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = p.i + 1 JOIN m ON m.a = p.state, (VALUES (true), (false)) kept(k)
                    WHERE fault NOT IN (1, 2) AND CASE WHEN kept.k THEN r = letter ELSE letter <> 's' END
                ) q JOIN inserted e ON e.a = q.state GROUP BY conv_id, i, e.b)),
        w AS (SELECT p.conv_id, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.n WHERE state IN (0, 3) GROUP BY p.conv_id)
        SELECT x.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN s ON x.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN w ON x.conv_id IS NOT DISTINCT FROM w.conv_id""",
}
