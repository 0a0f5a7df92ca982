"""Registry of the engine's own queries and their SQL.

The tables hold no genomes, so the queries read documents as sequence families (three neighbouring doc_ids each, the
letters folded onto four bases) and lineitem as anchors (an order is a family). All rows and whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import bytetables
from lociweave.functions import sequences as S
from lociweave.operators import anchors as A
from lociweave.operators import chain as C
from lociweave.operators import coordinates as X
from lociweave.operators import repeats as R
from lociweave.operators.numbering import row_numbers
from lociweave.operators.storage import kept_folder, settled
from lociweave.plans import discover as P
from lociweave.sources import fasta, pages, writers

K = 7
LETTERS, FOLDED = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Sequence families, genes and anchors in SQL; queries pick what they need.
WITH = {
    "fam": f"""fam AS (SELECT doc_id // 3 AS family_id, CAST(doc_id % 3 AS INTEGER) AS seq_idx, doc_id, coalesce(text, '') AS text,
      regexp_replace(translate(lower(coalesce(text, '')), '{LETTERS}', '{FOLDED}'), '[^ACGT]', 'N', 'g') AS bases FROM documents)""",
    "genes": """genes AS (SELECT family_id, seq_idx, doc_id, length(bases) AS len, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 1000 * doc_id AS region_start,
      1000 * doc_id + length(bases) // 3 AS gene_start, 1000 * doc_id + length(bases) // 2 AS gene_end FROM fam)""",
    "frames": """frames AS (SELECT *, CASE WHEN strand = '-' THEN len - (gene_start - region_start) - 1 ELSE gene_start - region_start END AS g0,
      CASE WHEN strand = '-' THEN len - (gene_end - region_start) - 1 ELSE gene_end - region_start END AS g1 FROM genes)""",
    "items": """items AS (SELECT l_orderkey AS family_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_id,
      CAST(l_quantity AS BIGINT) AS len, l_partkey AS x, l_suppkey * 10 AS y, CAST(l_linenumber AS BIGINT) * 60 AS z FROM lineitem)""",
    "edges": """edges AS (SELECT a.family_id, a.row_id AS src, b.row_id AS dst, b.len AS weight FROM items AS a JOIN items AS b ON a.family_id = b.family_id AND a.x + a.len < b.x AND a.y + a.len < b.y AND a.z + a.len < b.z)""",
    "legacy": """legacy AS (SELECT a.family_id, a.row_id AS src, b.row_id AS dst, b.len AS weight FROM items AS a JOIN items AS b ON a.family_id = b.family_id AND a.x < b.x AND a.y < b.y AND a.z < b.z)""",
    "turned": """turned AS (SELECT fam.family_id, fam.seq_idx, CASE WHEN doc_id % 2 = 0 THEN bases ELSE reverse(translate(bases, 'ACGT', 'TGCA')) END AS bases FROM fam)""",
    "runs": f"""runs AS (SELECT family_id, seq_idx, run, k, n_runs, coalesce(CAST(sum(length(run) + 1) OVER (PARTITION BY family_id, seq_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
      FROM (SELECT family_id, seq_idx, unnest(string_split(bases, 'N')) AS run, generate_subscripts(string_split(bases, 'N'), 1) AS k, len(string_split(bases, 'N')) AS n_runs FROM turned))""",
    "starts": f"""starts AS (SELECT family_id, seq_idx, before + p AS pos, substring(run, p, {K}) AS kmer, CASE WHEN before + p = 1 THEN concat('^', seq_idx) WHEN p = 1 THEN 'N' ELSE substring(run, p - 1, 1) END AS prev,
      concat(substring(run, p), CASE WHEN k < n_runs THEN 'N' ELSE '' END) AS suffix FROM (SELECT *, unnest(range(1, length(run) - {K} + 2)) AS p FROM runs WHERE length(run) >= {K}))""",
    "near": """near AS (SELECT *, CASE WHEN before IS NULL THEN NULL ELSE coalesce(list_position(list_transform(range(1, least(length(suffix), length(before)) + 1), lambda i: suffix[i] <> before[i]), true) - 1, least(length(suffix), length(before))) END AS lcp
      FROM (SELECT *, lag(suffix) OVER (PARTITION BY family_id, kmer ORDER BY translate(suffix, '$ACGNT#', '0123456'), seq_idx, pos) AS before FROM starts))""",
    "words": f"""words AS (SELECT DISTINCT family_id, kmer, substring(suffix, 1, lcp) AS word, lcp AS len FROM near WHERE lcp >= {K} AND NOT contains(substring(suffix, 1, lcp), 'N'))""",
    "occ": """occ AS (SELECT w.family_id, word, len, seq_idx, pos, prev, CASE WHEN substring(suffix, len + 1, 1) = '' THEN concat('#', seq_idx) ELSE substring(suffix, len + 1, 1) END AS next
      FROM words AS w JOIN starts AS s ON w.family_id = s.family_id AND w.kmer = s.kmer AND substring(suffix, 1, len) = word)""",
    "diverse": """diverse AS (SELECT family_id, word, list_sort(list(DISTINCT prev)) AS prevs FROM occ GROUP BY ALL HAVING count(DISTINCT prev) >= 2)""",
    "subsumed": """subsumed AS (SELECT DISTINCT d.family_id, d.word FROM (SELECT family_id, word, next, list_sort(list(DISTINCT prev)) AS prevs FROM occ GROUP BY family_id, word, next HAVING count(DISTINCT prev) >= 2) AS n
      JOIN diverse AS d ON d.family_id = n.family_id AND d.word = n.word AND d.prevs = n.prevs)""",
    "repeats": """repeats AS (SELECT o.family_id, o.word, o.len, o.seq_idx, o.pos FROM occ AS o SEMI JOIN diverse AS d ON o.family_id = d.family_id AND o.word = d.word ANTI JOIN subsumed AS s ON o.family_id = s.family_id AND o.word = s.word)""",
    "sizes": """sizes AS (SELECT family_id, CAST(count(*) AS INTEGER) AS n FROM fam GROUP BY family_id)""",
    "shared": """shared AS (SELECT family_id, word, len FROM repeats JOIN sizes USING (family_id) GROUP BY family_id, word, len, n HAVING count(DISTINCT seq_idx) = n)""",
    "product": """product AS (SELECT family_id, word, len, pos0, pos1, pos2 FROM shared JOIN sizes USING (family_id)
      JOIN (SELECT family_id, word, pos AS pos0 FROM repeats WHERE seq_idx = 0) USING (family_id, word)
      LEFT JOIN (SELECT family_id, word, pos AS pos1 FROM repeats WHERE seq_idx = 1) USING (family_id, word)
      LEFT JOIN (SELECT family_id, word, pos AS pos2 FROM repeats WHERE seq_idx = 2) USING (family_id, word)
      WHERE n = 1 OR n = 2 AND pos1 IS NOT NULL OR n = 3 AND pos1 IS NOT NULL AND pos2 IS NOT NULL)""",
}
FAMILY = ("fam", "turned", "runs", "starts", "near", "words", "occ", "diverse", "subsumed", "repeats")


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(WITH.get(u, u) for u in uses) + "\n" if uses else ""
            ORACLE_SQL[name] = head + sql
        return f

    return add


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bases = bytetables.mapped(F.lower("text"), LETTERS + "ACGT", FOLDED + "ACGT", "N")
    return docs.select(F.floor(F.col("doc_id") / 3).alias("family_id"), (F.col("doc_id") % 3).cast("int").alias("seq_idx"), "doc_id", "text", bases.alias("bases"))


def length_of() -> Column:
    """Letters of a family's text, known without folding them: each character gives one base."""
    return F.length(F.lower("text")).cast("long")


def genes_of(fam: DataFrame) -> DataFrame:
    length = length_of()
    start = F.col("doc_id") * 1000
    return fam.select(
        "family_id", "seq_idx", F.concat(F.lit("gene"), F.col("doc_id").cast("string")).alias("gene"), F.concat(F.lit("chr"), F.col("seq_idx").cast("string")).alias("chr"),
        F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("region_start"), (start + F.expr("length(lower(text)) div 3")).alias("gene_start"), (start + F.expr("length(lower(text)) div 2")).alias("gene_end"), length.alias("n"),
    )


def texts_of(fam: DataFrame) -> DataFrame:
    back = ~F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    turned = bytetables.mapped_or_reversed(F.lower("text"), back, LETTERS + "ACGT", FOLDED + "ACGT", "N", "ACGT", "TGCA")
    return fam.select("family_id", "seq_idx", turned.alias("bases"), length_of().alias("len"))


def frames_of(fam: DataFrame) -> DataFrame:
    """The genes and their sequences' lengths are columns of the same rows here: no join."""
    return X.framed(genes_of(fam).withColumnRenamed("n", "len"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    pos = F.array(F.col("l_partkey"), F.col("l_suppkey") * 10, F.col("l_linenumber").cast("long") * 60)
    return rows.select(F.col("l_orderkey").alias("family_id"), F.row_number().over(order).cast("long").alias("row_id"), F.col("l_quantity").cast("long").alias("len"), pos.alias("pos"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = texts_of(families(spark, sf_dir))
    return texts, R.marked_words(texts, K)


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.maximal_repeats(texts_of(families(spark, sf_dir)), K)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families(spark, sf_dir).groupBy("family_id").agg(F.count("*").cast("int").alias("n"))


def _wide(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, *(F.try_element_at("pos", F.lit(k + 1)).alias(f"pos{k}") for k in range(3)))


# Sources -----------------------------------------------------------------------------------------------------------


def _as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as lines of sequence files, a file a family: a metadata line, a header and text lines for each."""
    fam = families(spark, sf_dir)
    meta = F.concat(F.lit("> gene"), F.col("doc_id"), F.lit("\tchr"), F.col("seq_idx"), F.when(F.col("doc_id") % 2 == 0, " + ").otherwise(" -  "), F.col("doc_id") * 1000, F.lit(" x "), F.col("doc_id") * 1000 + 9)
    lines = F.concat(F.array(meta, F.concat(F.lit(">seq"), F.col("doc_id"))), F.split(F.replace("text", F.lit(">"), F.lit("")), "\n"))
    each = fam.select("family_id", "seq_idx", F.posexplode(lines).alias("p", "line"))
    return each.select("family_id", (F.col("seq_idx").cast("long") * (1 << 32) + F.col("p")).alias("line_no"), "line")


@query("fasta_header_count", "SELECT doc_id // 3 AS family_id, count(*) AS n_headers FROM documents GROUP BY 1")
def fasta_header_count(spark, sf_dir):
    return fasta.header_count(_as_lines(spark, sf_dir), "family_id")


@query("fasta_assemble", "SELECT family_id, seq_idx, concat('seq', doc_id) AS name, md5(replace(replace(text, '>', ''), chr(10), '')) AS bases_md5, length(replace(replace(text, '>', ''), chr(10), '')) AS len FROM fam", ("fam",))
def fasta_assemble(spark, sf_dir):
    rows = fasta.assemble(_as_lines(spark, sf_dir), "family_id")
    return rows.select("family_id", "seq_idx", "name", F.md5(F.col("bases").cast("binary")).alias("bases_md5"), "len")


@query("metadata_parse", "SELECT family_id, seq_idx, concat('gene', doc_id) AS gene, concat('chr', seq_idx) AS chr, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 1000 * doc_id AS region_start, 0 AS gene_start, 1000 * doc_id + 9 AS gene_end, 0 AS region_end FROM fam", ("fam",))
def metadata_parse(spark, sf_dir):
    return fasta.parse_metadata(_as_lines(spark, sf_dir), "family_id")


@query("metadata_join", "SELECT family_id, seq_idx, concat('gene', doc_id) AS gene, concat('seq', doc_id) AS name, length(replace(replace(text, '>', ''), chr(10), '')) AS len FROM fam", ("fam",))
def metadata_join(spark, sf_dir):
    lines = _as_lines(spark, sf_dir)
    genes = fasta.parse_metadata(lines, "family_id").select("family_id", "seq_idx", "gene")
    return fasta.assemble(lines, "family_id").join(genes, ["family_id", "seq_idx"]).select("family_id", "seq_idx", "gene", "name", "len")


# Scalar functions --------------------------------------------------------------------------------------------------


@query("normalize_alphabet", "SELECT doc_id, md5(regexp_replace(text, '[^ACGT]', 'N', 'g')) AS bases_md5 FROM documents")
def normalize_alphabet(spark, sf_dir):
    return families(spark, sf_dir).select("doc_id", F.md5(S.normalize(F.col("text")).cast("binary")).alias("bases_md5"))


@query("normalize_alphabet_ci", "SELECT doc_id, md5(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g')) AS bases_md5 FROM documents")
def normalize_alphabet_ci(spark, sf_dir):
    return families(spark, sf_dir).select("doc_id", F.md5(S.normalize(F.translate("text", "acgt", "ACGT")).cast("binary")).alias("bases_md5"))


@query("reverse_complement", "SELECT family_id, seq_idx, md5(reverse(translate(bases, 'ACGT', 'TGCA'))) AS bases_md5 FROM fam", ("fam",))
def reverse_complement(spark, sf_dir):
    return families(spark, sf_dir).select("family_id", "seq_idx", F.md5(S.reverse_complement(F.col("bases")).cast("binary")).alias("bases_md5"))


@query("gene_offsets", "SELECT family_id, seq_idx, g0, g1 FROM frames", ("fam", "genes", "frames"))
def gene_offsets(spark, sf_dir):
    return frames_of(families(spark, sf_dir)).select("family_id", "seq_idx", "g0", "g1")


@query("boundary_chars", "SELECT family_id, seq_idx, CASE WHEN seq_idx = 0 THEN '$' ELSE '#' END AS before_first, '#' AS behind_last, substring(bases, 1, 1) AS first_base, right(bases, 1) AS last_base FROM turned", ("fam", "turned"))
def boundary_chars(spark, sf_dir):
    rows = texts_of(families(spark, sf_dir))
    return rows.select("family_id", "seq_idx", F.when(F.col("seq_idx") == 0, "$").otherwise("#").alias("before_first"), F.lit("#").alias("behind_last"), F.substring("bases", 1, 1).alias("first_base"), F.right("bases", F.lit(1)).alias("last_base"))


@query("length_stats", "SELECT family_id, count(*) AS n, max(length(bases)) AS max_len, CAST(sum(length(bases)) AS BIGINT) AS total_len FROM fam GROUP BY family_id", ("fam",))
def length_stats(spark, sf_dir):
    length = F.length("bases").cast("long")
    return families(spark, sf_dir).groupBy("family_id").agg(F.count("*").alias("n"), F.max(length).alias("max_len"), F.sum(length).alias("total_len"))


@query("position_map", "SELECT family_id, seq_idx, CAST(coalesce(sum(length(bases)) OVER (PARTITION BY family_id ORDER BY seq_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(bases) AS len FROM fam", ("fam",))
def position_map(spark, sf_dir):
    return X.global_starts(texts_of(families(spark, sf_dir)).select("family_id", "seq_idx", "len")).select("family_id", "seq_idx", "start", "len")


@query("record_offsets", "SELECT family_id, seq_idx, concat('seq', doc_id) AS name, CAST(coalesce(sum(length(bases) + 1) OVER (PARTITION BY family_id ORDER BY seq_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(bases) + 1 AS room FROM fam", ("fam",))
def record_offsets(spark, sf_dir):
    fam = families(spark, sf_dir)
    return fasta.record_offsets(fam.select("family_id", "seq_idx", F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("name"), F.length("bases").alias("len")))


@query(
    "global_to_local",
    """SELECT p.family_id, p.at, s.seq_idx, p.at - s.start AS pos FROM (SELECT family_id, CAST(unnest([start + 1, start + (len + 1) // 2, start + len]) AS BIGINT) AS at FROM starts WHERE len > 0) AS p
      JOIN starts AS s ON p.family_id = s.family_id AND p.at > s.start AND p.at <= s.start + s.len""",
    ("fam", "starts AS (SELECT family_id, seq_idx, length(bases) AS len, CAST(coalesce(sum(length(bases)) OVER (PARTITION BY family_id ORDER BY seq_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM fam)"),
)
def global_to_local(spark, sf_dir):
    """The first, middle and last position of each sequence, as positions of its family's whole text, and back."""
    at = X.global_starts(texts_of(families(spark, sf_dir)).select("family_id", "seq_idx", "len")).withColumn("room", F.col("len"))
    asked = at.where("len > 0").select("family_id", F.explode(F.array(F.col("start") + 1, F.expr("start + (len + 1) div 2"), F.col("start") + F.col("len"))).alias("at"))
    return X.local_positions(asked, at).select("family_id", "at", "seq_idx", (F.col("at") - F.col("start")).alias("pos"))


@query("cns_header", "SELECT family_id, list(concat('gene', doc_id)[1:2] ORDER BY seq_idx) AS labels FROM fam GROUP BY family_id", ("fam",))
def cns_header(spark, sf_dir):
    return writers.labels(genes_of(families(spark, sf_dir)), 2)


# Repeats -----------------------------------------------------------------------------------------------------------


@query("kmer_explode", "SELECT family_id, seq_idx, kmer, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM starts GROUP BY ALL", ("fam", "turned", "runs", "starts"))
def kmer_explode(spark, sf_dir):
    starts = R.kmers(texts_of(families(spark, sf_dir)), K)
    return starts.groupBy("family_id", "seq_idx", "kmer").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@query("kmer_seed_join", "SELECT a.family_id, a.seq_idx AS seq_a, b.seq_idx AS seq_b, count(*) AS n_seeds FROM starts AS a JOIN starts AS b ON a.family_id = b.family_id AND a.kmer = b.kmer AND a.seq_idx < b.seq_idx GROUP BY ALL", ("fam", "turned", "runs", "starts"))
def kmer_seed_join(spark, sf_dir):
    return R.seed_counts(R.kmers(texts_of(families(spark, sf_dir)), K))


@query(
    "lce_islands",
    f"""SELECT family_id, seq_a, seq_b, CAST(min(pos_a) AS BIGINT) AS pos_a, CAST(min(pos_b) AS BIGINT) AS pos_b, count(*) + {K} - 1 AS len FROM (
      SELECT *, pos_a - row_number() OVER (PARTITION BY family_id, seq_a, seq_b, pos_b - pos_a ORDER BY pos_a) AS island, pos_b - pos_a AS diagonal FROM (
        SELECT a.family_id, a.seq_idx AS seq_a, b.seq_idx AS seq_b, a.pos AS pos_a, b.pos AS pos_b FROM starts AS a JOIN starts AS b ON a.family_id = b.family_id AND a.kmer = b.kmer AND a.seq_idx < b.seq_idx))
    GROUP BY family_id, seq_a, seq_b, diagonal, island""",
    ("fam", "turned", "runs", "starts"),
)
def lce_islands(spark, sf_dir):
    return R.islands(texts_of(families(spark, sf_dir)), K)


@query("right_maximal", "SELECT family_id, word, CAST(len AS BIGINT) AS len FROM words", FAMILY[:6])
def right_maximal(spark, sf_dir):
    return R.right_maximal(texts_of(families(spark, sf_dir)), K).select("family_id", "word", F.col("len").cast("long").alias("len"))


@query("left_diverse", "SELECT family_id, word, prevs FROM diverse", FAMILY[:8])
def left_diverse(spark, sf_dir):
    texts, found = _found(spark, sf_dir)
    return R.spelled(R.left_diverse(found), texts)


@query("subsumed_repeat", "SELECT family_id, word FROM subsumed", FAMILY[:9])
def subsumed_repeat(spark, sf_dir):
    texts, found = _found(spark, sf_dir)
    return R.spelled(R.subsumed(found, R.left_diverse(found)), texts)


@query("maximal_repeats", "SELECT family_id, word, count(*) AS n_occurrences FROM repeats GROUP BY ALL", FAMILY)
def maximal_repeats(spark, sf_dir):
    return _repeats(spark, sf_dir).groupBy("family_id", "word").agg(F.count("*").alias("n_occurrences"))


@query(
    "ambiguity_filter",
    f"""SELECT r.family_id, r.seq_idx, n_words, n_words - coalesce(n_clear, 0) AS n_ambiguous FROM (SELECT family_id, seq_idx, length(bases) - {K} + 1 AS n_words FROM turned WHERE length(bases) >= {K}) AS r
      LEFT JOIN (SELECT family_id, seq_idx, count(*) AS n_clear FROM starts GROUP BY ALL) USING (family_id, seq_idx)""",
    ("fam", "turned", "runs", "starts"),
)
def ambiguity_filter(spark, sf_dir):
    starts = R.kmers(texts_of(families(spark, sf_dir)), K, keep_ambiguous=True)
    return starts.groupBy("family_id", "seq_idx").agg(F.count("*").alias("n_words"), F.count_if(S.ambiguous(F.col("kmer"))).alias("n_ambiguous"))


@query("homopolymer_filter", "SELECT family_id, kmer, count(*) AS n FROM starts WHERE length(replace(kmer, kmer[1], '')) = 0 GROUP BY ALL", ("fam", "turned", "runs", "starts"))
def homopolymer_filter(spark, sf_dir):
    starts = R.kmers(texts_of(families(spark, sf_dir)), K)
    return starts.where(S.homopolymer(F.col("kmer"))).groupBy("family_id", "kmer").agg(F.count("*").alias("n"))


@query(
    "boundary_split",
    f"""SELECT word, part, CAST(side AS BIGINT) AS side, CAST(shift AS BIGINT) AS shift FROM (
      SELECT word, parts[s] AS part, s - 1 AS side, CASE WHEN s = 1 THEN 0 ELSE length(array_to_string(parts[1 : s - 1], '#')) + 1 END AS shift FROM (
        SELECT word, parts, unnest(range(1, len(parts) + 1)) AS s FROM (SELECT word, string_split(word, '#') AS parts FROM (SELECT DISTINCT concat(bases, '#', reverse(bases)) AS word FROM fam))))
    WHERE length(part) >= {K}""",
    ("fam",),
)
def boundary_split(spark, sf_dir):
    words = families(spark, sf_dir).select(F.lit(0).alias("family_id"), F.concat("bases", F.lit("#"), F.reverse("bases")).alias("word")).distinct()
    return R.boundary_split(words, K).select("word", "part", F.col("side").cast("long").alias("side"), F.col("shift").cast("long").alias("shift"))


@query("rank_key_sort", "SELECT family_id, word, row_number() OVER (PARTITION BY family_id ORDER BY concat(translate(word, '$ACGNT#', '0123456'), '7')) AS rank FROM words", FAMILY[:6])
def rank_key_sort(spark, sf_dir):
    words = R.right_maximal(texts_of(families(spark, sf_dir)), K).withColumn("_key", S.rank_key(F.col("word")))
    return row_numbers(words, ["family_id"], ["_key"], "rank").select("family_id", "word", "rank")


@query("repeat_occurrences", "SELECT family_id, word, CAST(seq_idx AS BIGINT) AS seq_idx, CAST(pos AS BIGINT) AS pos FROM repeats", FAMILY)
def repeat_occurrences(spark, sf_dir):
    return _repeats(spark, sf_dir).select("family_id", "word", F.col("seq_idx").cast("long").alias("seq_idx"), F.col("pos").cast("long").alias("pos"))


@query("occurrences_by_sequence", "SELECT family_id, word, seq_idx, list(CAST(pos AS BIGINT) ORDER BY pos) AS positions FROM repeats GROUP BY family_id, word, seq_idx", FAMILY)
def occurrences_by_sequence(spark, sf_dir):
    rows = A.by_sequence(_repeats(spark, sf_dir))
    return rows.select("family_id", "word", "seq_idx", F.col("positions").cast("array<bigint>").alias("positions"))


@query("anchor_count", "SELECT family_id, word, CAST(product(n) AS BIGINT) AS n_anchors FROM (SELECT family_id, word, seq_idx, count(*) AS n FROM repeats GROUP BY ALL) GROUP BY ALL", FAMILY)
def anchor_count(spark, sf_dir):
    return A.anchor_counts(_repeats(spark, sf_dir))


def _product(spark, sf_dir):
    return A.anchors(_repeats(spark, sf_dir), _sizes(spark, sf_dir))


PRODUCT = (*FAMILY, "sizes", "shared", "product")


@query("anchor_product", "SELECT family_id, word, CAST(pos0 AS BIGINT) AS pos0, CAST(pos1 AS BIGINT) AS pos1, CAST(pos2 AS BIGINT) AS pos2 FROM product", PRODUCT)
def anchor_product(spark, sf_dir):
    return _wide(_product(spark, sf_dir).withColumn("pos", F.col("pos").cast("array<bigint>")), "family_id", "word")


@query("present_in_all", "SELECT family_id, word FROM shared", PRODUCT[:-1])
def present_in_all(spark, sf_dir):
    each = _repeats(spark, sf_dir).groupBy("family_id", "word").agg(F.count_distinct("seq_idx").alias("k"))
    return each.join(_sizes(spark, sf_dir), "family_id").where("k = n").select("family_id", "word")


BOUNDS = """bounds AS (SELECT family_id, list(least(g0, g1) + 1 ORDER BY seq_idx) AS low, list(greatest(g0, g1) + 1 ORDER BY seq_idx) AS high FROM frames GROUP BY family_id)"""
TESTED = """tested AS (SELECT *, before IN (0, n) AND behind IN (0, n) AS same_side, inside = 0 AS outside FROM (
  SELECT p.*, len(pos) AS n, len(list_filter(range(1, len(pos) + 1), lambda i: pos[i] < low[i])) AS before, len(list_filter(range(1, len(pos) + 1), lambda i: pos[i] > high[i])) AS behind,
    len(list_filter(range(1, len(pos) + 1), lambda i: pos[i] BETWEEN low[i] AND high[i])) AS inside
  FROM (SELECT family_id, word, len, list_filter([pos0, pos1, pos2], lambda x: x IS NOT NULL) AS pos FROM product) AS p JOIN bounds USING (family_id)))"""
FILTERED = (*PRODUCT, "genes", "frames", BOUNDS, TESTED)


@query("same_side_of_gene", "SELECT family_id, word, CAST(pos AS BIGINT[]) AS pos FROM tested WHERE same_side", FILTERED)
def same_side_of_gene(spark, sf_dir):
    rows = _product(spark, sf_dir).join(A.gene_arrays(frames_of(families(spark, sf_dir))), "family_id")
    return rows.where(S.same_side(F.col("pos"), F.col("low"), F.col("high"))).select("family_id", "word", F.col("pos").cast("array<bigint>").alias("pos"))


@query("outside_gene", "SELECT family_id, word, CAST(pos AS BIGINT[]) AS pos FROM tested WHERE outside", FILTERED)
def outside_gene(spark, sf_dir):
    rows = _product(spark, sf_dir).join(A.gene_arrays(frames_of(families(spark, sf_dir))), "family_id")
    return rows.where(S.outside_gene(F.col("pos"), F.col("low"), F.col("high"))).select("family_id", "word", F.col("pos").cast("array<bigint>").alias("pos"))


@query("filter_funnel", "SELECT family_id, count(*) AS n_anchors, count(*) AS n_present, count(CASE WHEN same_side THEN 1 END) AS n_same_side, count(CASE WHEN same_side AND outside THEN 1 END) AS n_outside FROM tested GROUP BY family_id", FILTERED)
def filter_funnel(spark, sf_dir):
    return A.funnel(_product(spark, sf_dir), A.gene_arrays(frames_of(families(spark, sf_dir))))


NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY concat(translate(word, '$ACGNT#', '0123456'), '7'), list_reverse(pos)) AS row_id FROM tested WHERE same_side AND outside)"""


def _strict(spark, sf_dir):
    fam = families(spark, sf_dir)
    return P.strict_anchors(texts_of(fam), frames_of(fam), K)


@query("filtered_anchors", "SELECT family_id, row_id, word, CAST(pos AS BIGINT[]) AS pos FROM numbered", (*FILTERED, NUMBERED))
def filtered_anchors(spark, sf_dir):
    return _strict(spark, sf_dir).select("family_id", "row_id", "word", F.col("pos").cast("array<bigint>").alias("pos"))


SPREAD = "coalesce(list_sum(list_transform(range(1, len({0}) + 1), lambda i: coalesce(list_sum(list_transform(range(1, i), lambda j: abs({0}[i] - {0}[j]))), 0))), 0)"
BLOCKS = f"""grown AS (
  SELECT family_id, row_id, [row_id] AS path, len AS weight, pos, [{{'cost': {SPREAD.format("pos")}, 'row_id': row_id}}] AS keys FROM numbered
  UNION ALL
  SELECT family_id, row_id, path, weight, pos, list_append(keys, {{'cost': {SPREAD.format("gaps")}, 'row_id': row_id}}) FROM (
    SELECT p.family_id, i.row_id, list_append(p.path, i.row_id) AS path, p.weight + i.len AS weight, i.pos, p.keys, list_transform(range(1, len(i.pos) + 1), lambda k: p.pos[k] - i.pos[k]) AS gaps
    FROM grown AS p JOIN numbered AS i ON p.family_id = i.family_id AND len(list_filter(range(1, len(i.pos) + 1), lambda k: i.pos[k] + i.len >= p.pos[k])) = 0)),
best AS (SELECT family_id, CAST(weight AS BIGINT) AS score, path, unnest(range(1, len(path) + 1)) AS step FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY weight DESC, keys) AS first FROM grown) WHERE first = 1),
regions AS (SELECT family_id, list({{'start': region_start, 'n': len, 'strand': strand, 'chr': concat('chr', seq_idx)}} ORDER BY seq_idx) AS g FROM frames GROUP BY family_id),
blocks AS (SELECT family_id, CAST(step AS BIGINT) AS step, CAST(len AS BIGINT) AS len, word, score, list_transform(g, lambda r: r.chr) AS chr,
  list_transform(range(1, len(g) + 1), lambda k: CAST(CASE WHEN g[k].strand = '+' THEN g[k].start + pos[k] - 1 ELSE g[k].start + g[k].n - pos[k] - len + 1 END AS BIGINT)) AS abs_pos
  FROM best JOIN numbered AS a USING (family_id) JOIN regions USING (family_id) WHERE a.row_id = path[step])"""
CHAINED = (*FILTERED, NUMBERED, BLOCKS)


def _blocks(spark, sf_dir):
    fam = families(spark, sf_dir)
    rows = settled(_strict(spark, sf_dir))
    chain = C.best_chains(rows).join(rows.select("family_id", "row_id", "word"), ["family_id", "row_id"])
    return X.absolute(chain, frames_of(fam))


@query("conserved_blocks", "SELECT family_id, step, len, abs_pos, chr, word, score FROM blocks", CHAINED, recursive=True)
def conserved_blocks(spark, sf_dir):
    """The flagship: the heaviest chain of each family with its words and genome coordinates."""
    whole = lambda c: F.col(c).cast("long").alias(c)
    return _blocks(spark, sf_dir).select("family_id", whole("step"), whole("len"), F.col("abs_pos").cast("array<bigint>").alias("abs_pos"), "chr", "word", whole("score"))


# Anchors and chains ------------------------------------------------------------------------------------------------


@query("dedup_longest", "SELECT family_id, row_id, len, x, y FROM (SELECT *, row_number() OVER (PARTITION BY family_id, x, y ORDER BY len DESC, row_id DESC) AS k FROM items) WHERE k = 1", ("items",))
def dedup_longest(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("pos", F.slice("pos", 1, 2))
    return A.dedup_longest(rows).select("family_id", "row_id", "len", F.col("pos")[0].alias("x"), F.col("pos")[1].alias("y"))


@query("mem_serial", "SELECT family_id, row_id, row_number() OVER (PARTITION BY family_id ORDER BY row_id) AS serial FROM items WHERE len >= 10", ("items",))
def mem_serial(spark, sf_dir):
    return A.serials(items(spark, sf_dir).where("len >= 10")).select("family_id", "row_id", F.col("serial").cast("long").alias("serial"))


@query("mem_table_sentinels", """SELECT family_id, 0 AS part, 0 AS "MEM", 0 AS "Length", 0 AS "S_1", 0 AS "S_2", 0 AS "S_3" FROM items GROUP BY family_id
  UNION ALL SELECT family_id, 1, row_id, len, x, y, z FROM items UNION ALL SELECT family_id, 2, 0, max(len), max(len), max(len), max(len) FROM items GROUP BY family_id""", ("items",))
def mem_table_sentinels(spark, sf_dir):
    rows = items(spark, sf_dir)
    return writers.with_ends(rows, rows.select("family_id", "len"), 3, serial=True)


@query("anchor_spread", "SELECT family_id, row_id, abs(x - y) + abs(x - z) + abs(y - z) AS spread FROM items", ("items",))
def anchor_spread(spark, sf_dir):
    return items(spark, sf_dir).select("family_id", "row_id", S.spread(F.col("pos")).alias("spread"))


@query("gap_consistency", "SELECT a.family_id, a.row_id AS src, b.row_id AS dst, abs((b.x - a.x) - (b.y - a.y)) + abs((b.x - a.x) - (b.z - a.z)) + abs((b.y - a.y) - (b.z - a.z)) AS gap FROM items AS a JOIN items AS b ON a.family_id = b.family_id AND a.x + a.len < b.x AND a.y + a.len < b.y AND a.z + a.len < b.z", ("items",))
def gap_consistency(spark, sf_dir):
    return C.edges(items(spark, sf_dir), gaps=True).drop("weight")


@query("precedence_edges", "SELECT * FROM edges", ("items", "edges"))
def precedence_edges(spark, sf_dir):
    return C.edges(items(spark, sf_dir))


@query("precedence_edges_legacy", "SELECT * FROM legacy", ("items", "legacy"))
def precedence_edges_legacy(spark, sf_dir):
    return C.edges(items(spark, sf_dir), use_length=False)


@query("dag_degrees", "SELECT family_id, row_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM items LEFT JOIN (SELECT family_id, dst AS row_id, count(*) AS i FROM legacy GROUP BY ALL) USING (family_id, row_id) LEFT JOIN (SELECT family_id, src AS row_id, count(*) AS o FROM legacy GROUP BY ALL) USING (family_id, row_id)", ("items", "legacy"))
def dag_degrees(spark, sf_dir):
    rows = items(spark, sf_dir)
    return C.degrees(rows, C.edges(rows, use_length=False))


PATHS = """paths AS (
  SELECT family_id, row_id AS last, [row_id] AS path, len AS weight, x, y, z, [{'cost': abs(x - y) + abs(x - z) + abs(y - z), 'row_id': row_id}] AS keys FROM items
  UNION ALL
  SELECT p.family_id, i.row_id, list_append(p.path, i.row_id), p.weight + i.len, i.x, i.y, i.z, list_append(p.keys, {'cost': abs((p.x - i.x) - (p.y - i.y)) + abs((p.x - i.x) - (p.z - i.z)) + abs((p.y - i.y) - (p.z - i.z)), 'row_id': i.row_id})
  FROM paths AS p JOIN items AS i ON p.family_id = i.family_id AND i.x + i.len < p.x AND i.y + i.len < p.y AND i.z + i.len < p.z)"""


@query("heaviest_chain_score", "SELECT family_id, max(weight) AS score FROM paths GROUP BY family_id", ("items", PATHS), recursive=True)
def heaviest_chain_score(spark, sf_dir):
    return C.scores(items(spark, sf_dir))


@query(
    "heaviest_chain",
    "SELECT family_id, CAST(step AS BIGINT) AS step, path[step] AS row_id, weight AS score FROM (SELECT family_id, path, weight, unnest(range(1, len(path) + 1)) AS step FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY weight DESC, keys) AS k FROM paths) WHERE k = 1)",
    ("items", PATHS),
    recursive=True,
)
def heaviest_chain(spark, sf_dir):
    return C.heaviest_chain(items(spark, sf_dir)).select("family_id", F.col("step").cast("long").alias("step"), "row_id", "score")


@query("heaviest_chain_vectorised", "SELECT family_id, max(weight) AS score FROM paths GROUP BY family_id", ("items", PATHS), recursive=True)
def heaviest_chain_vectorised(spark, sf_dir):
    return C.chain_large(items(spark, sf_dir)).where("step = 1").select("family_id", "score")


MAXIMAL = """direct AS (SELECT l.family_id, src, dst FROM legacy AS l ANTI JOIN (SELECT a.family_id, a.src, b.dst FROM legacy AS a JOIN legacy AS b ON a.family_id = b.family_id AND a.dst = b.src) AS t ON l.family_id = t.family_id AND l.src = t.src AND l.dst = t.dst),
grown AS (
  SELECT family_id, [row_id] AS path, row_id AS last, len AS weight FROM items ANTI JOIN legacy ON items.family_id = legacy.family_id AND items.row_id = legacy.dst
  UNION ALL
  SELECT g.family_id, list_append(g.path, d.dst), d.dst, g.weight + i.len FROM grown AS g JOIN direct AS d ON g.family_id = d.family_id AND g.last = d.src JOIN items AS i ON i.family_id = d.family_id AND i.row_id = d.dst),
chains AS (SELECT g.family_id, path, CAST(len(path) AS INTEGER) AS size, weight FROM grown AS g ANTI JOIN legacy AS l ON g.family_id = l.family_id AND g.last = l.src)"""


@query("all_chains", "SELECT * FROM chains", ("items", "legacy", MAXIMAL), recursive=True)
def all_chains(spark, sf_dir):
    return C.all_chains(items(spark, sf_dir))


@query("longest_chains", "SELECT family_id, path, size, weight FROM (SELECT *, max(size) OVER (PARTITION BY family_id) AS most FROM chains) WHERE size = most", ("items", "legacy", MAXIMAL), recursive=True)
def longest_chains(spark, sf_dir):
    return C.all_chains(items(spark, sf_dir), only_longest=True)


@query("chain_counts", "SELECT family_id, CAST(count(*) AS BIGINT) AS n_chains, max(size) AS longest FROM chains GROUP BY family_id", ("items", "legacy", MAXIMAL), recursive=True)
def chain_counts(spark, sf_dir):
    """How many chains each family has, without listing any."""
    return C.chain_counts(items(spark, sf_dir)).select("family_id", F.col("n_chains").cast("long").alias("n_chains"), "longest")


@query("path_lines", "SELECT family_id, array_to_string(path, '-') AS line FROM chains", ("items", "legacy", MAXIMAL), recursive=True)
def path_lines(spark, sf_dir):
    return C.all_chains(items(spark, sf_dir)).select("family_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("line"))


@query("abs_coordinates", "SELECT family_id, seq_idx, CASE WHEN strand = '+' THEN region_start + g0 ELSE region_start + len - (g0 + 1) - 8 + 1 END AS strict_start, CASE WHEN strand = '+' THEN region_start + g0 + 1 ELSE region_start + len - (g0 + 1) - 8 END AS literal_start FROM frames", ("fam", "genes", "frames"))
def abs_coordinates(spark, sf_dir):
    rows = frames_of(families(spark, sf_dir))
    at = lambda literal: S.absolute_start(F.col("g0") + 1, F.lit(8), F.col("len"), F.col("region_start"), F.col("strand"), literal)
    return rows.select("family_id", "seq_idx", at(False).alias("strict_start"), at(True).alias("literal_start"))


@query("brush_filter", "SELECT family_id, row_id FROM items WHERE x BETWEEN 100 AND 1500 AND z BETWEEN 60 AND 240", ("items",))
def brush_filter(spark, sf_dir):
    return writers.brushed(items(spark, sf_dir), {0: (100, 1500), 2: (60, 240)}).select("family_id", "row_id")


@query("multi_k", "SELECT k, family_id, CAST(sum(length(run) - k + 1) AS BIGINT) AS n_kmers FROM (SELECT family_id, run FROM runs), (VALUES (8), (12), (16)) AS ks(k) WHERE length(run) >= k GROUP BY ALL", ("fam", "turned", "runs"))
def multi_k(spark, sf_dir):
    return R.kmer_counts(texts_of(families(spark, sf_dir)), [8, 12, 16])


PAGE_SQL = "replace(replace(replace('" + writers.PAGE.replace("{{", "{").replace("}}", "}").replace("'", "''") + "', '{axes}', axes), '{rows}', rows), '{title}', concat('Family ', family_id))"


@query(
    "plot_pages",
    f"""SELECT family_id, {PAGE_SQL} AS value FROM (SELECT family_id, CAST(to_json(list(CAST(pos AS BIGINT[]) ORDER BY pos)) AS VARCHAR) AS rows FROM numbered GROUP BY family_id)
      JOIN (SELECT family_id, CAST(to_json(list(concat('gene', doc_id) ORDER BY seq_idx)) AS VARCHAR) AS axes FROM fam GROUP BY family_id) USING (family_id)""",
    (*FILTERED, NUMBERED),
)
def plot_pages(spark, sf_dir):
    rows = _strict(spark, sf_dir)
    return writers.plot_pages(rows, genes_of(families(spark, sf_dir)))


@query(
    "gene_tracks",
    """SELECT family_id, 'track' AS kind, CAST(k - 1 AS BIGINT) AS seq_idx, abs_pos[k] AS start, abs_pos[k] + len - 1 AS stop FROM (SELECT *, unnest(range(1, len(abs_pos) + 1)) AS k FROM blocks)
      UNION ALL SELECT family_id, 'gene', CAST(seq_idx AS BIGINT), gene_start, gene_end FROM genes""",
    CHAINED,
    recursive=True,
)
def gene_tracks(spark, sf_dir):
    whole = lambda c: F.col(c).cast("long").alias(c)
    return writers.tracks(_blocks(spark, sf_dir), genes_of(families(spark, sf_dir))).select("family_id", "kind", whole("seq_idx"), whole("start"), whole("stop"))


# Tables as text, and what pages draw -------------------------------------------------------------------------------


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("family_id", F.col("place.part").alias("part"), F.col("place.serial").alias("serial"), "line")


def _three_lengths(rows: DataFrame) -> DataFrame:
    """A length for each of the three sequences of an order."""
    return rows.groupBy("family_id").agg(F.max("len").alias("len")).select("family_id", F.explode(F.array_repeat("len", 3)).alias("len"))


TABLE_ENDS = """SELECT DISTINCT family_id, 0 AS part, CAST(0 AS BIGINT) AS serial, 'Length,S_1,S_2,S_3' AS line FROM items UNION ALL SELECT DISTINCT family_id, 0, 1, '0,0,0,0' FROM items
  UNION ALL SELECT family_id, 2, 2, concat_ws(',', max(len), max(len), max(len), max(len)) FROM items GROUP BY family_id UNION ALL """


@query("anchor_table_lines", TABLE_ENDS + "SELECT family_id, 1, row_id, concat_ws(',', len, x, y, z) FROM items", ("items",))
def anchor_table_lines(spark, sf_dir):
    rows = items(spark, sf_dir)
    return _lines(writers.anchor_lines(rows, _three_lengths(rows), serial=False))


@query(
    "chain_table_lines",
    TABLE_ENDS + """SELECT family_id, 1, CAST(step AS BIGINT), concat_ws(',', len, x, y, z) FROM (SELECT family_id, path[step] AS row_id, step FROM (SELECT family_id, path, unnest(range(1, len(path) + 1)) AS step
      FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY weight DESC, keys) AS k FROM paths) WHERE k = 1)) JOIN items USING (family_id, row_id)""",
    ("items", PATHS),
    recursive=True,
)
def chain_table_lines(spark, sf_dir):
    rows = items(spark, sf_dir)
    return _lines(writers.anchor_lines(C.heaviest_chain(rows), _three_lengths(rows), serial=False, order_by="step"))


@query(
    "cns_table_lines",
    """SELECT family_id, 1 AS part, step AS serial, concat_ws(',', len, array_to_string(abs_pos, ','), array_to_string(chr, ','), word) AS line FROM blocks
      UNION ALL SELECT family_id, 0, CAST(generate_subscripts(l, 1) - 1 AS BIGINT), unnest(l) FROM (SELECT family_id, list_append(g, concat('LEN,', array_to_string(s, ','), ',', array_to_string(list_transform(s, lambda x: concat('Chr_', x)), ','), ',CNS')) AS l
        FROM (SELECT family_id, list(concat('gene', doc_id) ORDER BY seq_idx) AS g, list(concat('gene', doc_id)[1:2] ORDER BY seq_idx) AS s FROM fam GROUP BY family_id))""",
    CHAINED,
    recursive=True,
)
def cns_table_lines(spark, sf_dir):
    return _lines(writers.cns_lines(_blocks(spark, sf_dir), genes_of(families(spark, sf_dir))))


@query("anchor_table_scan", "SELECT row_id, len, [x, y, z] AS pos FROM items", ("items",))
def anchor_table_scan(spark, sf_dir):
    """All anchors as a tab-separated table, written and read back."""
    path = kept_folder(spark, "anchors")
    items(spark, sf_dir).select(F.col("row_id").alias("id"), "len", *(F.col("pos")[k].alias("xyz"[k]) for k in range(3))).write.csv(path, sep="\t", header=True)
    return fasta.read_anchor_table(spark, path).select("row_id", F.col("len").cast("long").alias("len"), F.col("pos").cast("array<bigint>").alias("pos"))


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that miss the first sequence where its position is a multiple of 5."""
    rows = items(spark, sf_dir)
    return rows.withColumn("pos", F.transform("pos", lambda v, k: F.when((k == 0) & (v % 5 == 0), 0).otherwise(v)))


POINTS = "points AS (SELECT * FROM (SELECT family_id, row_id, unnest([0, 1, 2]) AS axis, unnest([CASE WHEN x % 5 = 0 THEN 0 ELSE x END, y, z]) AS here FROM items) WHERE here <> 0)"
SCALES = "scales AS (SELECT family_id, axis, min(here) AS low, max(here) AS high, count(*) AS n FROM points GROUP BY ALL)"
PARTS = "parts AS (SELECT family_id, axis AS a, here AS at_a, lead(axis) OVER w AS b, lead(here) OVER w AS at_b FROM points WINDOW w AS (PARTITION BY family_id, row_id ORDER BY axis))"


@query("plot_scales", "SELECT * FROM scales", ("items", POINTS, SCALES))
def plot_scales(spark, sf_dir):
    return pages.scales(_gapped(spark, sf_dir))


@query(
    "plot_ribbons",
    f"""SELECT p.family_id, a, b, CAST((at_a - s.low) * {pages.STRETCHES} // (s.high - s.low + 1) AS INTEGER) AS leaves, CAST((at_b - t.low) * {pages.STRETCHES} // (t.high - t.low + 1) AS INTEGER) AS enters, count(*) AS n
      FROM parts AS p JOIN scales AS s ON s.family_id = p.family_id AND s.axis = a JOIN scales AS t ON t.family_id = p.family_id AND t.axis = b GROUP BY ALL""",
    ("items", POINTS, SCALES, PARTS),
)
def plot_ribbons(spark, sf_dir):
    return pages.ribbons(_gapped(spark, sf_dir))
