"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, embjoin, exactdedup, langid, minhash, mixing, pieces, pii, tokenfiles, toxicity, warc, whitening
from .common import new_path, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), alternatives=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = new_path(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(tricky).alias("text"),
    )
    return chat.digests(chat.format_turns(turns.unionByName(more), parts=chat.text_parts("text")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfiles.read_tokens(spark, path)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_langid": op2_langid,
        "op3_toxicity": op3_toxicity,
        "op4_pieces": op4_pieces,
        "op5_mixing": op5_mixing,
        "op6_warc": op6_warc,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_chat": op8_chat,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_pii": op10_pii,
        "op11_token_files": op11_token_files,
        "op12_whitening": op12_whitening,
        "op13_collocations": op13_collocations,
    }


_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
         source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM per
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed
), water AS (
  SELECT *, coalesce(max(CASE WHEN lvl * w <= cap THEN lvl END) OVER (), 0) AS line FROM levels
), targets AS (
  SELECT source, source_size, least(line * w, cap) AS target,
         CASE WHEN source_size > 0 THEN least(least(line * w, cap) / source_size, 3.0::DOUBLE) ELSE 0 END AS rate
  FROM water
), cuts AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS whole, CAST(floor((rate - floor(rate)) * 4294967296) AS BIGINT) AS cut FROM targets
), tried AS (
  SELECT c.source, j, abs(sum(s.size * (whole + CASE WHEN (u + j * {step}) % 4294967296 < cut THEN 1 ELSE 0 END)) - any_value(target)) AS off
  FROM sizes s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source CROSS JOIN range({shifts}) r(j) GROUP BY c.source, j
), shifts AS (
  SELECT source, arg_min(j, (off, j)) AS shift FROM tried GROUP BY source
), taken AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, whole + CASE WHEN (u + shift * {step}) % 4294967296 < cut THEN 1 ELSE 0 END AS copies
  FROM sizes s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source JOIN shifts h ON s.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM taken
"""

_WARC = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS sha FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def _chat_sql() -> str:
    def esc(x: str) -> str:
        x = f"replace({x}, '{chat.MARK}', '{chat.MARK * 2}')"
        for s in chat.CONTROL:
            x = f"replace({x}, '{s}', '{s[0] + chat.MARK + s[1:]}')"
        return x

    piece = f"'{chat.TURN}' || replace({esc('role')}, chr(10), '{chat.MARK}n') || chr(10) || {esc('text')} || '{chat.END}' || chr(10)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (SELECT *, {piece} AS piece FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, piece), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), spans AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) s(k)
), phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(w[i:i + k - 1]) AS ws, count(*) AS f
  FROM spans GROUP BY lang, k, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k, phrase, f, ws, unnest(range(1, k)) AS c FROM phrases WHERE k > 1
), tried AS (
  SELECT t.lang, t.phrase, t.f AS a, a.f AS l, b.f AS r, c, (2000000 * t.f::HUGEINT) // (a.f + b.f) AS score FROM cuts t
  JOIN phrases a ON a.lang = t.lang AND a.phrase = array_to_string(t.ws[1:c], ' ')
  JOIN phrases b ON b.lang = t.lang AND b.phrase = array_to_string(t.ws[c + 1:], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM tried
), inner_ AS (
  SELECT lang, f, k, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM phrases, range(2, 4) s(m) WHERE m < k)
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE o = 1 AND NOT coalesce(100 * g.f >= 80 * a, FALSE)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": _MIX.replace("{shifts}", str(mixing.SHIFTS)).replace("{step}", str((1 << 32) // mixing.SHIFTS)), "op6_warc": _WARC,
        "op8_chat": _chat_sql(), "op9_exact_dedup": _EXACT, "op13_collocations": _PHRASES,
    }
