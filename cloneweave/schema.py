"""Table schemas.  The output's names and types are fixed values of the format."""

from __future__ import annotations

from pyspark.sql import types as T

READS = "sequence_id string, sequence_input string, quality string"
GERMLINE = "db string, receptor string, segment string, allele string, species string, seq string, gapped string"
HITS = "query string, target string, evalue double, qstart int, qend int, qseq string, nident int"
ASSIGNMENT = "sequence_id string, sequence_input string, quality string, rev_comp boolean, v_call string, v_support double, d_call string, d_support double, j_call string, j_support double, c_call string, c_support double"

# The output's columns in order; all are strings but those listed below.
OUTPUT_COLUMNS = """
sequence_id v_gene d_gene j_gene c_gene cdr3_length junction_aa v_identity v_identity_aa d_identity d_identity_aa
j_identity j_identity_aa productive complete_vdj sequence germline sequence_vdjc germline_vdjc sequence_lvdjc
germline_lvdjc sequence_aa germline_aa sequence_vdjc_aa germline_vdjc_aa sequence_lvdjc_aa germline_lvdjc_aa
sequence_gapped germline_gapped sequence_vdjc_gapped germline_vdjc_gapped sequence_lvdjc_gapped germline_lvdjc_gapped
sequence_alignment germline_alignment sequence_alignment_aa germline_alignment_aa umi quality locus frame species
germline_database sequence_input sequence_oriented rev_comp productivity_issues stop_codon v_call v_score v_support
v_cigar v_sequence v_germline v_sequence_gapped v_germline_gapped v_sequence_aa v_germline_aa v_mutations
v_mutations_aa v_mutation_count v_mutation_count_aa v_insertions v_deletions v_frameshift v_frame d_call d_score
d_support d_cigar d_sequence d_germline d_frame j_call j_score j_support j_cigar j_sequence j_germline c_call c_score
c_support c_identity c_identity_aa c_cigar c_sequence c_germline c_sequence_gapped c_germline_gapped c_sequence_aa
c_germline_aa c_sequence_gapped_aa c_germline_gapped_aa c_mutations c_mutations_aa c_mutation_count
c_mutation_count_aa c_insertions c_deletions c_sequence_start c_sequence_end c_germline_start c_germline_end c_frame
np1 np2 np1_length np2_length fwr1 fwr1_aa cdr1 cdr1_aa fwr2 fwr2_aa cdr2 cdr2_aa fwr3 fwr3_aa cdr3 cdr3_aa fwr4
fwr4_aa junction cdr3_v cdr3_v_aa cdr3_n1 cdr3_n1_aa cdr3_d cdr3_d_aa cdr3_n2 cdr3_n2_aa cdr3_j cdr3_j_aa
v_sequence_start v_sequence_end v_germline_start v_germline_end j_sequence_start j_sequence_end j_germline_start
j_germline_end cdr_mask cdr_mask_aa gene_segment_mask gene_segment_mask_aa nongermline_mask nongermline_mask_aa
""".split()
LONGS = """
cdr3_length frame v_mutation_count v_mutation_count_aa v_frame d_frame c_mutation_count c_mutation_count_aa
c_sequence_start c_sequence_end c_germline_start c_germline_end c_frame np1_length np2_length v_sequence_start
v_sequence_end v_germline_start v_germline_end j_sequence_start j_sequence_end j_germline_start j_germline_end
""".split()
DOUBLES = """
v_identity v_identity_aa d_identity d_identity_aa j_identity j_identity_aa v_score v_support d_score d_support
j_score j_support c_score c_support c_identity c_identity_aa
""".split()
BOOLEANS = "productive complete_vdj rev_comp stop_codon v_frameshift".split()

_TYPES = {c: T.LongType() for c in LONGS} | {c: T.DoubleType() for c in DOUBLES} | {c: T.BooleanType() for c in BOOLEANS}
OUTPUT = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in OUTPUT_COLUMNS])
FAILED = T.StructType([*OUTPUT.fields, T.StructField("error", T.StringType())])
