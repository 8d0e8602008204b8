"""One query or more of every family against its SQL at the smallest scale; `harness.py` runs them all at any scale."""

import pytest

from harness import compare
import __spark_entry__ as entry

PICK = """a1_read_vcf_genotypes a2_read_sam a3_aligned_bases a4_read_fastq a5_read_mex a7_wide_to_long a12_read_haps b1_write_assignments
e1_counts_from_alignments e2_bulk_from_alignments e25_rate_from_alignments sql_functions
b6_write_mex b7_split_by_identity c6_unrepeated_positions c17_split_libraries d1_reads_at_sites d4_correct_barcodes
d5_match_tags d8_merge_labels d10_interval_lookup d13_compatible_patterns e4_pair_counts e14_contingency e16_cutoff_curves
e7_species_counts_by_umi f3_knee f10_top_sites_per_pattern f13_top_kmers f14_mann_whitney f17_greedy_matching
g5_site_groups i2_prune_singlets i4_doublet_vs_doublet i5_eliminate i5c_max_min i6_error_rates i7_tag_split i10_tag_sets
i13_species_calls i16_cell_rates i18_ambient_profile i22_expression_profile i23_remove_ambient i24_pool_composition
i29_doublet_rate i33_regenotype i36_sampled_sites j1_stream_tag_counts j2_stream_partial_counts""".split()


@pytest.mark.parametrize("name", PICK)
def test_query(spark, con, name):
    entry.queries()
    ok, note = compare(spark, con, name, "sf0.001")
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["barcode", "id", "type", "llr"]
