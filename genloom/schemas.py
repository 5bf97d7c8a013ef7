"""Explicit schemas of the data model. Readers never infer a schema."""

from __future__ import annotations



def _s(ddl: str) -> str:
    """Schemas are kept as DDL, which every reader takes and which needs no session."""
    return ddl


#: Bit-packed haplotypes: allele i is bit i & 63 of word i >> 6, least significant first.
HAPLOTYPES = _s("chr int, hap_id bigint, n int, words array<bigint>")
SAMPLES = _s("fid string, iid string, sample_idx bigint")
VARIANTS = _s("chr int, snp_idx bigint, snp_id string, bp bigint, cm double, a1 string, a2 string")
COVARIATES = _s("iid string, z array<double>")
WINDOWS = _s("chr int, w int, start bigint, end bigint")
IBD = _s("chr int, seg_id bigint, indices array<bigint>, j_min bigint, j_max bigint, bp_min bigint, bp_max bigint")
EDGES = _s("src bigint, dst bigint, weight double")
LOCAL_REFERENCES = _s("chr int, hap_id bigint, window int, refs array<bigint>")
GLOBAL_REFERENCES = _s("chr int, hap_id bigint, refs array<bigint>")
PARTITION = _s("chr int, snp_id string, res int, group_id bigint")
KEY = _s("CHR int, SNP string, BP bigint, Group bigint, Knockoff boolean")
STATISTICS = _s("res int, CHR int, Group bigint, W double")
ANNOTATION = _s("chrom string, start bigint, end bigint, name string")
GENETIC_MAP = _s("bp bigint, rate double, cm double")
BIM = _s("chr string, snp_id string, cm double, bp bigint, a1 string, a2 string")
FAM = _s("fid string, iid string, father string, mother string, sex int, phenotype string")
LEGEND = _s("snp_id string, bp bigint, a1 string, a2 string")
#: Orders in which probability records may come, and kinds of their values.
PROBABILITY_ORDERS = ["unknown", "unordered", "ordered", "per_unordered_genotype", "per_ordered_haplotype", "per_phased_haplotype_per_allele", "per_unordered_haplotype", "per_allele", "per_sample"]
VALUE_KINDS = ["unknown", "probability", "allele_index", "dosage"]
MISSING = "NA"
