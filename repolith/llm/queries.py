"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, jpeg_media, mixing, sharding, simhash, spelling, token_shards, topk, toxicity, url_filter, warc
from .common import cut, read_table, remove_folder, shared_folder

SHARDS = 24
END_OF_TEXT = 50256
#: Every vector whose identifier this divides is a query.
ASKED_EACH = 50
RULES = [
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public byte-level vocabulary; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dims = [docs["source"], docs["lang"], docs["size"]]
    placed = sharding.assign_shards(docs, dims, SHARDS, docs["doc_id"], docs["text_crc32"])
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit_on_labels(docs, labels)
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_folder(spark, "shards")
    read = cut(token_shards.read_back(token_shards.write_shards(docs, tokenizer_path("byte_bpe_50k.tiktoken"), END_OF_TEXT, folder)))
    remove_folder(spark, folder)
    return read


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mark_mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.read_media(jpeg_media.add_media(read_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(read_table(spark, sf_dir, "pages"))


def op9_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), RULES)


def op10_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.mark_near_duplicates(read_table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op12_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % ASKED_EACH == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


QUERIES = (
    op1_hilbert_shards, op2_subword_toxicity, op3_training_order, op4_speculative_bpe, op5_pareto_mix,
    op6_content_sort, op7_jpeg_media, op8_warc_revisits, op9_template_tree, op10_gray_simhash,
    op11_symmetric_delete, op12_segment_topk, op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(CASE WHEN size > 0 THEN round(sqrt(size) * 1000) ELSE 0 END)::BIGINT AS roots FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s
), a AS (
  -- a level is right if the capped sources under it and the open ones over it use up all words
  SELECT x.most / x.weight AS ratio,
         ((SELECT sum(source_size) FROM w) - coalesce(sum(y.most) FILTER (WHERE (y.most / y.weight, coalesce(y.source, chr(1114111))) < (x.most / x.weight, coalesce(x.source, chr(1114111)))), 0))
         / sum(y.weight) FILTER (WHERE (y.most / y.weight, coalesce(y.source, chr(1114111))) >= (x.most / x.weight, coalesce(x.source, chr(1114111)))) AS level
  FROM w x, w y GROUP BY x.source, x.most, x.weight
), l AS (SELECT arg_min(level, ratio) AS level FROM a WHERE level <= ratio * (1 + 1e-15)),
p AS (
  SELECT source, source_size, roots, least(most, coalesce(level, 3e300) * weight) AS target FROM w, l
), p2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9)::BIGINT ELSE 0 END AS whole FROM p
), p3 AS (
  SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM p2
), r AS (
  SELECT d.doc_id, d.size, p3.*, least(greatest((CASE WHEN roots > 0 THEN rest * 1000 / roots ELSE 0 END) / sqrt(greatest(size, 1)), 1e-12), 1 - 1e-9) AS chance, u / (1 - u) AS odds
  FROM d JOIN p3 ON d.source IS NOT DISTINCT FROM p3.source
), k AS (SELECT *, odds / (chance / (1 - chance)) AS rank FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k),
g AS (SELECT source, max(rest) - coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS gap FROM c GROUP BY source),
f AS (
  SELECT c.source, min(struct_pack(off := abs(size - gap), rank := rank, doc_id := doc_id)) AS fit, any_value(gap) AS gap
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE rest > 0 AND upto > rest AND size > 0 GROUP BY c.source
)
SELECT c.doc_id, c.size, source_size, target,
       ((whole + CASE WHEN rest > 0 AND (upto <= rest OR (f.fit.off < f.gap AND f.fit.doc_id = c.doc_id AND f.fit.rank = c.rank)) THEN 1 ELSE 0 END) * c.size)::BIGINT AS taken
FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source
"""


OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), bytes AS (
  SELECT run, doc_id, n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: unicode(x)) AS points FROM lowered
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p::BIGINT] ELSE [192::BIGINT + p // 64, 128::BIGINT + p % 64] END))),
         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), replaced AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM replaced a JOIN replaced b USING (i, head, tail) WHERE a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM replaced a JOIN words b ON b.word = a.head || a.tail
  UNION
  SELECT b.word, a.word, a.n FROM replaced a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM words
  UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root
FROM formed f JOIN chain c ON c.word = f.word JOIN formed last ON last.word = c.at AND last.form IS NULL
"""

OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_pareto_mix": OP5_SQL, "op6_content_sort": OP6_SQL, "op8_warc_revisits": OP8_SQL, "op11_symmetric_delete": OP11_SQL, "op12_segment_topk": OP12_SQL}
