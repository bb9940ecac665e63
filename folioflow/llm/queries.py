"""Queries over the given tables, one per operator: they map tables to its interface and results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Tables, cut_lineage, scratch_folder
from . import bpe, descent, language, lines, minhash, mixture, multiindex, phrases, records, scoring, secrets, spelling, warc

#: names of the public tokenizers' vocabularies
VOCABULARY = "word_bpe_49k.json"


BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).embeddings
    return multiindex.nearest(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)


def op2_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return descent.near_duplicate_vectors(Tables(spark, folder).embeddings, "vec_id", "embedding", 0.9)


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    models = language.train_languages(docs, F.coalesce(remainder(3) != 1, F.lit(False)), "doc_id", "text", "lang")
    held = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return language.script_language(docs, models, "doc_id", "text").select("doc_id", held, "lang_pred", "score")


def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    return mixture.mix_prompts(docs, "doc_id", "source").select("doc_id", "source", "copy", "shuffle_key", "text")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = Tables(spark, folder).pages
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000)))
    archives = scratch_folder(spark, "archives")
    warc.write_archives(pages.select("page_id", "url", "html", at.alias("captured_at")), archives, "page_id", "url", "captured_at", "html")
    history = warc.capture_histories(cut_lineage(warc.read_runs(spark, archives), "runs"))
    return history.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    ratios = secrets.train_string_models(secrets.labelled_samples(docs, "doc_id", "text"))
    got = secrets.log_secrets(docs, ratios, "doc_id", "text")
    base = F.sha2(secrets.span_text(F.filter("found", lambda x: x["k"] < 3)), 256)
    return got.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeated_lines(Tables(spark, folder).documents, "doc_id", "text")


def op8_ppm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    held = F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out")
    got = scoring.score_scripts(docs, remainder(7) != 2, "doc_id", "text")
    return got.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    got = bpe.encode_prompts(Tables(spark, folder).documents, vocabulary(), "doc_id", "text")
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicate_scripts(Tables(spark, folder).documents, "doc_id", "text", words=2)


def op11_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents
    stored = scratch_folder(spark, "records")
    records.write_prompt_records(docs, vocabulary(BYTE_VOCABULARY), stored, "doc_id", "text", end=0)
    got = records.read_prompt_records(spark, stored, "doc_id", docs.schema["doc_id"].dataType)
    return got.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(Tables(spark, folder).documents, "doc_id", "text", slip=199)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(Tables(spark, folder).documents, "lang", "text")


QUERIES = {f.__name__: f for f in (op1_multi_index, op2_nn_descent, op3_language, op4_mixture, op5_warc, op6_secrets, op7_lines, op8_ppm_score, op9_bpe, op10_minhash, op11_records, op12_spelling, op13_phrases)}

#: each text is SQL of DuckDB over the same tables
SQL: dict[str, str] = {
    "op4_mixture": """
        WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        aims AS (SELECT source, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
        rates AS (SELECT source, rate, greatest(1, ceil(rate / 32))::INT AS parts, rate / greatest(1, ceil(rate / 32)) AS r FROM aims),
        logs AS (SELECT source, parts, k, r, ceil(r + 12 * sqrt(r) + 40) AS top,
                 CASE WHEN k = 0 THEN -r ELSE ln(r) - ln(k) END AS l FROM rates, (SELECT unnest(range(0, 400)) AS k) WHERE k <= ceil(r + 12 * sqrt(r) + 40)),
        pmf AS (SELECT source, parts, k, exp(sum(l) OVER (PARTITION BY source ORDER BY k)) AS p FROM logs),
        cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
        draws AS (SELECT doc_id, source, text, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u
                  FROM documents JOIN rates USING (source), unnest(range(0, parts)) AS t(part)),
        copies AS (SELECT doc_id, any_value(source) AS source, any_value(text) AS text, sum((SELECT count(*) FROM cdf WHERE cdf.source = draws.source AND c <= u)) AS n FROM draws GROUP BY doc_id)
        SELECT doc_id, source, copy::INT AS copy, md5('17:' || doc_id || ':copy:' || copy) AS shuffle_key, text
        FROM copies, unnest(range(1, n::BIGINT + 1)) AS t(copy)""",
    "op5_warc": """
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        firsts AS (SELECT body, max(page_id) AS top FROM hashed GROUP BY body)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1) for i in range(32)], '') AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM hashed JOIN firsts USING (body)""",
    "op12_spelling": """
        WITH RECURSIVE bits AS (SELECT x, list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(x)),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents),
        typed AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
        bytes AS (SELECT doc_id, w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
                  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END)) AS b FROM typed),
        steps AS (SELECT doc_id, w, n, b, 0 AS i, 4294967295::BIGINT AS c FROM bytes
          UNION ALL SELECT doc_id, w, n, b, i + 1, xor(s.c >> 8, bits.c) FROM steps s JOIN bits ON bits.x = xor(s.c, b[i + 1]) & 255 WHERE i < len(b)),
        hashed AS (SELECT w, n, xor(c, 4294967295) AS h FROM steps WHERE i = len(b)),
        said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM said GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
        cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
        near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
        forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN top END AS form_n,
                  CASE WHEN top >= 5 * n THEN (SELECT min(near COLLATE "C") FROM near WHERE near.word = words.word AND near_n = top) END AS form FROM words LEFT JOIN best USING (word)),
        ends AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, e.root FROM ends e JOIN forms f ON f.form = e.word)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
    "op13_phrases": """
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lists, range(1, 4) AS s(k))),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
        cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND n >= 10),
        cuts AS MATERIALIZED (SELECT lang, k, phrase, a, c, array_to_string(x[1:c], ' ') AS head, array_to_string(x[c + 1:], ' ') AS tail FROM cand, range(1, 3) AS s(c) WHERE c < k),
        scored AS (SELECT u.lang, u.phrase, u.a, u.c, f1.n AS l, f2.n AS r, ((1000000::HUGEINT * u.a * u.a) // (f1.n::HUGEINT * f2.n))::BIGINT AS score
          FROM cuts u JOIN f f1 ON f1.lang = u.lang AND f1.phrase = u.head JOIN f f2 ON f2.lang = u.lang AND f2.phrase = u.tail),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(x[1:2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(x[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
        left_over AS (SELECT w.* FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * w.a),
        totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, a, l, r, n, score
        FROM left_over JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
