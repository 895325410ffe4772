"""The thin queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneweave.llm import chat, decontaminate, jaccard, langid, media, mixing, pii, quality, tokenio, warc
from cloneweave.llm.common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels of rows whose remainder is not 2; every text is scored once."""
    p = quality.QualityParams()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~held_out(F.col("doc_id"))), params=p)
    scored = quality.classify(docs, model, params=p)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as ARC files, converted to WARC files, read back."""
    folder = warc.to_warc(spark, warc.write_arc(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    got = warc.warc_records(warc.files(spark, folder))
    return got.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.digest(chat.format_conversations(rows.unionByName(more)))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
              + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             3 + sum(n + 19) AS chars
      FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP5_KEY = "spark.cloneweave.pii.key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms, and where they stand.

    The secret key is the session's ``spark.cloneweave.pii.key``; only where
    none is set, as in tests, a public one serves, whose pseudonyms anyone can undo.
    """
    key = spark.conf.get(OP5_KEY, None) or "public key for tests"
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.PiiParams(key=key.encode()))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, links from 0.85 on."""
    return jaccard.join_components(table(spark, sf_dir, "documents"), jaccard.JoinParams(k=4, num=85, den=100))


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS m FROM t),
y AS (SELECT doc_id, i, m, concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v) AS y FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, count(*) AS n, md5(string_agg(y, chr(10) ORDER BY y)) AS s FROM (SELECT DISTINCT doc_id, y FROM y WHERE i <= greatest(1, m - 3)) GROUP BY doc_id),
u AS (SELECT s, n, min(doc_id) AS node FROM d GROUP BY s, n),
g AS (SELECT DISTINCT node, n, y AS g FROM u JOIN y ON u.node = y.doc_id WHERE i <= greatest(1, m - 3)),
links AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.g = b.g AND a.node < b.node
          GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT node AS a, node AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS node, min(b) AS root FROM r GROUP BY a)
SELECT t.doc_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(root, t.doc_id) AS BIGINT) AS component_id
FROM t LEFT JOIN d ON t.doc_id = d.doc_id LEFT JOIN u ON d.s = u.s LEFT JOIN c ON u.node = c.node
"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.read_archives(spark, media.write_archives(table(spark, sf_dir, "documents"))))


def token_params() -> tokenio.TokenParams:
    import public_tokenizers

    return tokenio.TokenParams(tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_params()
    _, index = tokenio.write_records(table(spark, sf_dir, "documents"), p)
    return tokenio.read_records(index, p)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document and benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM i WHERE len(w) > 0),
qg AS (SELECT item_id, w, k, m, g, count(*) AS c FROM (SELECT item_id, w, k, m, unnest([array_to_string(w[j + 1:j + k], ' ') for j in range(0, m)]) AS g FROM q) GROUP BY ALL),
d AS (SELECT doc_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] AS w FROM documents WHERE text IS NOT NULL),
dk AS (SELECT DISTINCT doc_id, w, k, len(w) - k + 1 AS s FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
dg AS (SELECT doc_id, w AS dw, k, s, unnest(range(0, s)) AS p, unnest([array_to_string(w[j + 1:j + k], ' ') for j in range(0, s)]) AS g FROM dk),
h AS (SELECT doc_id, dw, s, p, item_id, qg.w AS iw, m, g, c FROM dg JOIN qg USING (k, g)),
a AS (SELECT DISTINCT doc_id, dw, s, item_id, iw, m, unnest(range(greatest(0, p - m + 1), least(p, greatest(0, s - m)) + 1)) AS first_word FROM h),
n AS (SELECT doc_id, dw, item_id, iw, a.m, a.s, first_word, g, least(count(*), any_value(c)) AS o
      FROM a JOIN h USING (doc_id, dw, item_id, iw) WHERE p BETWEEN first_word AND first_word + a.m - 1 GROUP BY doc_id, dw, item_id, iw, a.m, a.s, first_word, g),
o AS (SELECT doc_id, item_id, first_word, CAST(sum(o) AS DOUBLE) / CAST(least(m, s) + m - sum(o) AS DOUBLE) AS similarity FROM n GROUP BY doc_id, dw, item_id, iw, m, s, first_word)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(first_word, (similarity, -first_word)) AS INT) AS first_word
FROM o WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from text and language of rows whose remainder is not 2; every text is predicted once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_mix": op4_mix,
    "op5_pii": op5_pii,
    "op6_jaccard": op6_jaccard,
    "op7_media": op7_media,
    "op8_tokens": op8_tokens,
    "op9_decontaminate": op9_decontaminate,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op3_chat": OP3_SQL, "op6_jaccard": OP6_SQL, "op9_decontaminate": OP9_SQL}
