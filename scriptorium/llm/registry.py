"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import codes, forest, imatch, jaccard, langid, lattice, mixing, packing, pii, png, resampling, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_langid": langid.op2_langid,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_media": png.op4_media,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_sentencepiece": lattice.op6_sentencepiece,
    "op7_fingerprints": imatch.op7_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_warc": warc.op10_warc,
    "op11_resampling": resampling.op11_resampling,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_neighbours": forest.op13_neighbours,
}
ORACLE = {**mixing.ORACLE, **warc.ORACLE, **resampling.ORACLE, **codes.ORACLE}
