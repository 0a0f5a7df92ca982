"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.common import table
from lociweave.llm.license import AGREE, RARE, SHARE, templates


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed are strings of 400 bytes; shared passages of over 50 words, mostly shorter than that, are told in further columns."""
    from lociweave.llm.passages import shared_spans
    from lociweave.llm.suffixdedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), length=400, more=lambda texts: shared_spans(texts, words=51))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lociweave.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio; each vector of embeddings is sung as a melody and fingerprinted."""
    from lociweave.llm.chroma import aligned, sung

    return aligned(sung(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lociweave.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=5, per_cent=75)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.license import labelled

    return labelled(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.fillmiddle import digests

    return digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.prefixtrie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_chroma": op3_chroma,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_license": op11_license,
    "op12_fill_middle": op12_fill_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, s, z.n, array_to_string(w[s + 1 : s + z.n], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS s FROM d), (SELECT DISTINCT n FROM windows) AS z
  WHERE s + z.n <= len(w)
), hits AS (
  SELECT spots.doc_id, spots.s, spots.n, windows.item_id FROM spots JOIN windows ON spots.n = windows.n AND spots.phrase = windows.phrase
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""



def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TEMPLATE_ROWS = ",\n  ".join(f"({k}, '{t['label']}', {t['base']}, {_quoted(t['words'])}, {t['key'][0]}, {t['key'][1]})" for k, t in enumerate(templates()))
LICENSE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), known(t, label, base, words, key_at, key_n) AS (VALUES
  {TEMPLATE_ROWS}
), spelled AS (
  SELECT t, base, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM known
), held AS (
  SELECT word, count(*) AS n FROM (SELECT r, unnest(list_distinct(w)) AS word FROM d) GROUP BY word
), weights AS (
  SELECT t, base, word, place, coalesce(n, 0) AS n, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + coalesce(n, 0))) + 1.0 AS idf FROM spelled LEFT JOIN held USING (word)
), rare AS (
  SELECT t, base, word, place, (SELECT len(list_distinct(words)) FROM known WHERE known.t = ranked.t) AS k FROM (
    SELECT t, base, word, min(place) AS place, row_number() OVER (PARTITION BY t ORDER BY n, min(place)) AS k FROM weights WHERE n > 0 GROUP BY t, base, word, n)
  AS ranked WHERE base OR k <= {RARE}
), spots AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d
), candidates AS (
  SELECT r, t, p - place AS s FROM spots JOIN rare USING (word) GROUP BY r, t, p - place, base, k HAVING count(*) >= CASE WHEN base THEN k ELSE {AGREE} END
), standing AS (
  SELECT c.r, c.t, s, label, base FROM candidates AS c JOIN known USING (t) JOIN d USING (r) WHERE s + key_at >= 0 AND w[s + key_at + 1 : s + key_at + key_n] = words[key_at + 1 : key_at + key_n]
), shares AS (
  SELECT r, t, s, label, x.base, sum(CASE WHEN s + place >= 0 AND w[s + place + 1] = word THEN idf ELSE 0 END) / sum(idf) AS share FROM standing AS x JOIN weights USING (t) JOIN d USING (r) GROUP BY r, t, s, label, x.base
), found AS (
  SELECT r, label, base, s, CASE WHEN base THEN 1.0 ELSE share END AS share FROM shares WHERE base OR share >= {SHARE}
), named AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, max(share) AS score,
    array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (base), []))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(round(score, 6), 0) AS DOUBLE) AS score
FROM d LEFT JOIN named USING (r)
"""

FILL_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', doc_id)) AS seed, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents
), h AS (
  SELECT *, len(w) AS n, CAST(concat('0x', seed[1:8]) AS BIGINT) AS h1, CAST(concat('0x', seed[9:16]) AS BIGINT) AS h2, CAST(concat('0x', seed[17:24]) AS BIGINT) AS h3, CAST(concat('0x', seed[25:32]) AS BIGINT) AS h4 FROM d
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), parts AS (
  SELECT *, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 :], '') AS suffix FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

PREFIX_TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, m, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS p FROM (
    SELECT conv_id, turn, md5(concat(length(role), ':', role, text)) AS m, len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda v: v <> '')) AS w FROM t)
), ids AS (
  SELECT DISTINCT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda s, v: CASE WHEN v >= 0 THEN xor(s, v) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 4 AS h FROM o
), opened AS (
  SELECT ids.conv_id, o.p, o.m, o.w FROM ids JOIN o ON o.conv_id = ids.base AND o.p < ids.h
  UNION ALL SELECT ids.conv_id, o.p + 4, o.m, o.w FROM ids JOIN o ON o.conv_id = ids.conv_id AND o.p >= ids.h
), paths AS (
  SELECT conv_id, w, CAST(row_number() OVER x AS BIGINT) AS depth, list(m) OVER x AS path FROM opened WINDOW x AS (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM ids
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM paths GROUP BY path, depth
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
), kids AS (
  SELECT path[: depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT a.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved_tokens
  FROM nodes AS a JOIN nodes AS b ON b.depth >= a.depth AND b.path[: a.depth] = a.path LEFT JOIN kids AS k ON k.path = b.path GROUP BY a.path
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes AS n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes AS up ON n.depth > 0 AND up.path = n.path[: n.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {"op5_decontaminate": DECONTAMINATE_SQL, "op11_license": LICENSE_SQL, "op12_fill_middle": FILL_MIDDLE_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
