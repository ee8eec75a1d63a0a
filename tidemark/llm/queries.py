"""The command table of this subpackage: thin queries over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    def learn(i):
        return F.coalesce(F.crc32(i.cast("string")) % 5 != 0, F.lit(False))  # a null id is held out

    found = identify(_table(spark, sf_dir, "documents"), learn=learn)
    return found.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back, unescape, with_mark_conversation

    def digest(batches):
        for batch in batches:
            n, turns, loss, losses, sizes = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                read = read_back(text)
                n.append(len(read))
                turns.append(sha256("".join(f"{r}\n{t}\n" for r, t in read).encode()).hexdigest())
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                loss.append(len(masked))
                losses.append(sha256(masked.encode()).hexdigest())
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.int64()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = format_conversations(with_mark_conversation(_table(spark, sf_dir, "conversations")))
    return made.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import search_vectors

    return search_vectors(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), keep_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    def learn(i):
        return F.coalesce(F.crc32(i.cast("string")) % 4 != 2, F.lit(False))  # a null id is held out

    found = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=learn)
    return found.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op8_syncmer_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * hits >= 75 * (na.n + nb.n - hits)
), r AS (
  SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a
), c AS (SELECT a, min(root) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n USING (doc_id)
"""


_OP2 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>') AS t, replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>'), ':', '\:') AS h FROM r
), c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(h) + length(t) + 14)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

_OP3 = """
WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS bits FROM embeddings),
b AS (SELECT id, array_to_string(bits, '')::BIT AS code FROM c),
p AS (SELECT q.id AS query_id, x.id AS neighbor_id, bit_count(xor(q.code, x.code))::BIGINT AS distance FROM b q JOIN b x ON q.id % 20 = 0 AND q.id <> x.id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INTEGER AS rank, neighbor_id, distance FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""


_ODD = "0123456789#$%&*|!<>{}[]()=+/\\_~^@\"'"

_OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(30)), coalesce(text, chr(30)), coalesce(source, chr(30)), '17')), 1, 15))::BIGINT AS mark,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN greatest(length(translate(text, '{_ODD.replace("'", "''")}', ''))::DOUBLE / length(text), 0.05e0) ELSE 0.05e0 END AS quality
  FROM documents
), k AS (SELECT *, -ln(((mark >> 7) + 1) / 9007199254740992e0) / quality AS key FROM d
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), s1 AS (SELECT *, CASE i % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3e0 * source_size) OVER b, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS level
  FROM s1 WINDOW b AS (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, arg_min(level, (source_size / weight, i)) FILTER (level * weight <= 3e0 * source_size) OVER () AS first FROM s2
), s AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 0 END AS epochs
  FROM (SELECT source, source_size, least(coalesce(first * weight, 3e0 * source_size), 3e0 * source_size) AS target FROM s3)
), r AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, mark, size ROWS UNBOUNDED PRECEDING) AS run
  FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source
), p AS (SELECT *, rest - sum(CASE WHEN run <= rest THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r
), c AS (
  SELECT *, row_number() OVER (PARTITION BY source, run > rest AND size > 0 AND abs(size - gap) < gap ORDER BY abs(size - gap), key, doc_id, mark) = 1 AND run > rest AND size > 0 AND abs(size - gap) < gap AS closes FROM p
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (epochs + (run <= rest OR closes)::INTEGER) * size ELSE 0 END::BIGINT AS taken FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": _OP9, "op2_chat_format": _OP2, "op3_hamming_topk": _OP3, "op10_minhash_near_dedup": _OP10}
