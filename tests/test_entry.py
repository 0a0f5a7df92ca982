"""The driver contract, and the cheap queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lociweave import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = [
    "fasta_header_count", "fasta_assemble", "metadata_parse", "metadata_join", "normalize_alphabet", "reverse_complement", "gene_offsets", "boundary_chars", "length_stats", "position_map", "cns_header", "boundary_split",
    "dedup_longest", "mem_serial", "mem_table_sentinels", "anchor_spread", "gap_consistency", "precedence_edges", "precedence_edges_legacy", "dag_degrees", "heaviest_chain_score", "heaviest_chain", "all_chains", "longest_chains", "abs_coordinates", "brush_filter",
    "kmer_seed_join", "left_diverse", "subsumed_repeat", "conserved_blocks", "gene_tracks", "plot_pages", "chain_counts", "record_offsets", "global_to_local", "rank_key_sort",
    "anchor_table_lines", "chain_table_lines", "cns_table_lines", "anchor_table_scan", "plot_scales", "plot_ribbons",
]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(core.ORACLE_SQL[name])
    got = core.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else v
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([plain(r[k]) for k in at]) for r in want.fetchall()) == sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
