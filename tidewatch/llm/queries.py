"""The registered query of each operator, on its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bestfit, bpe, exact_dedup, langid, lexical, packing, quality, secrets, simhash, substring, toxicity, warc, whitening
from tidewatch.llm.shared import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), starts AS (
  SELECT doc_id, i, w[i:i + 7] AS words FROM split, unnest(generate_series(1, len(w) - 7)) AS s(i) WHERE len(w) >= 8
), twice AS (
  SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(generate_series(0, 7)) AS s(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         word_chars / nullif(len(w), 0) AS mean_word_chars, n_symbols / nullif(len(w), 0) AS symbols_per_word,
         len(list_intersect(list_distinct(w), [{", ".join(f"'{x}'" for x in quality.STOP_WORDS)}])) / nullif(len(w), 0) AS stop_word_share,
         (len(l) - len(list_distinct(l))) / nullif(len(l), 0) AS dup_line_share,
         len(list_filter(l, lambda x: rtrim(x) LIKE '%...')) / nullif(len(l), 0) AS ellipsis_line_share,
         len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) / nullif(len(l), 0) AS bullet_line_share
  FROM split LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {quality.verdict_sql()} AS kept FROM judged
"""

def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = langid.profiles(docs.where(~langid.held_out()))
    return langid.identify(docs, learned).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def crc32_sql(table: str) -> str:
    """CTEs that give the CRC-32 of each doc_id of `table` as text: `crcs` (doc_id, crc)."""
    return f"""steps AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT i, v FROM steps WHERE k = 8),
crc AS (SELECT DISTINCT doc_id, 4294967295::BIGINT AS c, 1 AS pos FROM {table} WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, xor(v, c >> 8), pos + 1 FROM crc JOIN bytes ON i = xor(c & 255, ord(substr(doc_id::VARCHAR, pos, 1))) WHERE pos <= length(doc_id::VARCHAR)),
crcs AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM crc WHERE pos > length(doc_id::VARCHAR))"""


OP5_SQL = f"""
WITH RECURSIVE {crc32_sql("documents")}, docs AS (
  SELECT row_number() OVER () AS r, d.doc_id, lang, coalesce(crc % 3 = 1, false) AS held_out, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS words
  FROM documents d LEFT JOIN crcs USING (doc_id)
), framed AS (
  SELECT r, lang, held_out, ' ' || unnest(words) || ' ' AS w FROM docs
), cut AS (
  SELECT r, lang, held_out, w, n, unnest(range(1, length(w) - n + 2)) AS pos FROM framed, unnest([1, 2, 3]) AS orders(n)
), grams AS (
  SELECT r, lang, held_out, substr(w, pos, n) AS g, count(*) AS k FROM cut WHERE n > 1 OR (pos > 1 AND pos < length(w)) GROUP BY ALL
), profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY k DESC, length(g), g) - 1 AS place
  FROM (SELECT lang, g, sum(k) AS k FROM grams WHERE lang IS NOT NULL AND NOT held_out GROUP BY ALL) QUALIFY place < {langid.PROFILE}
), own AS (
  SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY k DESC, length(g), g) - 1 AS place FROM grams QUALIFY place < {langid.DOCUMENT}
), bounds AS (
  SELECT max(n) AS missing FROM (SELECT count(*) AS n FROM profile GROUP BY lang)
), sizes AS (
  SELECT r, count(*) AS n FROM own GROUP BY r
), met AS (
  SELECT r, p.lang, count(*) AS n, sum(abs(p.place - own.place)) AS apart FROM own JOIN profile p USING (g) GROUP BY ALL
), distances AS (
  SELECT s.r, l.lang, coalesce(apart, 0) + (s.n - coalesce(m.n, 0)) * missing AS d, s.n * missing AS most
  FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM profile) l CROSS JOIN bounds LEFT JOIN met m ON m.r = s.r AND m.lang = l.lang
), nearest AS (
  SELECT r, lang, d, coalesce(lead(d) OVER o, most) AS rest, row_number() OVER o AS i FROM distances WINDOW o AS (PARTITION BY r ORDER BY d, lang)
)
SELECT doc_id, held_out, coalesce(n.lang, 'und') AS lang_pred, coalesce(((rest - d) / nullif(rest, 0))::DOUBLE, 0) AS score
FROM docs LEFT JOIN nearest n ON n.r = docs.r AND n.i = 1
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) || '0' AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((((instr('0123456789abcdef', hex[5 * i // 4 + 1]) - 1) * 16 + instr('0123456789abcdef', hex[5 * i // 4 + 2]) - 1) >> (3 - (5 * i) % 4)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


BASE_KINDS = ("assign", "access", "hex")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(documents(spark, sf_dir))
    counts = [secrets.count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(BASE_KINDS), 256).alias("base_sha256"), secrets.span_text(secrets.KINDS).alias("spans"))


def ascii_sql(pattern: str) -> str:
    """A rule's pattern for an engine without ASCII-only case folding, possessive runs and looking back."""
    pattern = re.sub(r"\(\?<!\[(.*?)\]\)", "", pattern).replace("}+", "}")
    folded = re.search(r"\(\?ai:", pattern)
    if not folded:
        return pattern
    start, depth = folded.end(), 1
    for end in range(start, len(pattern)):
        depth += {"(": 1, ")": -1}.get(pattern[end], 0)
        if not depth:
            break
    names = re.sub(r"(?<![\[\\A-Za-z-])[a-z_]+(?![\]A-Za-z-])", lambda m: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[0]), pattern[start:end])
    return f"{pattern[: folded.start()]}(?:{names}){pattern[end + 1 :]}"


#: The base rules for another engine, from what is asked for and not from the operator: pattern, group of the value, least length.
BASE_SQL = {
    "assign": ("(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}


def op10_sql() -> str:
    """Matches are cut out together with the text before them, so that lengths give their places."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(secrets.RULES):
        pattern, group, least = BASE_SQL.get(kind, (pattern, group, least))
        guard = re.match(r"\(\?<!\[(.*?)\]\)", pattern)
        before = f"(.*?(?:^|[^{guard[1]}]))" if guard else "(.*?)"
        own = f"(?s){before}({ascii_sql(pattern)})".replace("'", "''")
        pieces = [f"unnest(regexp_extract_all(t, '{own}', {n})) AS {name}" for n, name in ((1, "pre"), (2, "hit"), (2 + group, "val"))]
        cut = f"SELECT doc_id, {', '.join(pieces)}, unnest(range(len(regexp_extract_all(t, '{own}', 2)))) AS i FROM docs"
        ends = "sum(length(pre) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)"
        parts.append(f"SELECT doc_id, '{kind}' AS kind, {order} AS ord, val, {ends} - length(hit) AS s, {ends} AS e FROM ({cut}) QUALIFY length(val) >= {least}")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    joined = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}),
lists AS (SELECT doc_id, {counts}, {joined} FILTER (WHERE kind IN ({base})) AS base, {joined} AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN lists USING (doc_id)
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "one"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("one").alias("whitened"), F.get("explained", "at").alias("explained"), "identity_error")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), asked AS (
  SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), corpus AS (
  SELECT count(*)::HUGEINT AS n, sum(len(terms))::HUGEINT AS l FROM split WHERE len(terms) > 0
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM split) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held CROSS JOIN corpus GROUP BY term, n
), lengths AS (
  SELECT doc_id, r, 75 + (25 * len(terms) * n) // l AS m FROM split CROSS JOIN corpus WHERE len(terms) > 0
), scores AS (
  SELECT item_id, i, doc_id, r, sum(w * q * ((1000000000::HUGEINT * tf) // (1000 * tf + 12 * m))) AS score
  FROM (SELECT item_id, i, term, count(*) AS q FROM asked GROUP BY ALL) JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (r)
  GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score::BIGINT AS score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_lexical": op12_lexical,
    "op13_bestfit": op13_bestfit,
}
SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op5_language_id": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op10_secrets": op10_sql(),
    "op12_lexical": OP12_SQL,
}
