"""Explicit schemas of the reference files. Sample ids are strings; names are lower-case with underscores."""

_IDS = "species_name string, sample_1 string, sample_2 string"
_longs = lambda names: ", ".join(f"{n} long" for n in names.split())

CORE = "core_diff core_len core_len_4d core_len_1d core_diff_4d core_diff_1d"
CLOSE = f"{_IDS}, " + _longs(f"{CORE} recomb_len_4d recomb_len_1d recomb_diff_4d recomb_diff_1d clonal_len_4d clonal_len_1d clonal_diff_4d clonal_diff_1d clonal_n clonal_m clonal_nn recomb_n recomb_m recomb_nn clonal_mut_n clonal_mut_m clonal_mut_nn recomb_mut_n recomb_mut_m recomb_mut_nn")
CLONAL = f"{_IDS}, " + _longs(f"{CORE} clonal_n clonal_m clonal_nn clonal_mut_n clonal_mut_m clonal_mut_nn")
TYPICAL = f"{_IDS}, " + _longs(f"{CORE} core_n core_m core_nn core_mut_n core_mut_m core_mut_nn")
CLADES = "sample_id string, clade string"
TRANSFERS = "species_name string, sample_1 string, sample_2 string, between_clade string, core_start long, core_end long, ref_contig string, ref_start long, ref_end long, clonal_fraction double, clonal_divergence double"
GENES = "gene_id string, contig string, start long, end long, strand string, type string, info string"
