"""The subpackage's queries by name, and their SQL where SQL can express them."""

from nestframe.llm import ann, jaccard, langid, licenses, mixing, pii, quality, spm, sql, topk, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": langid.op2_language_id,
    "op4_warc": warc.op4_warc,
    "op3_exact_topk": topk.op3_exact_topk,
    "op5_ann": ann.op5_ann,
    "op6_pii": pii.op6_pii,
    "op7_sentencepiece": spm.op7_sentencepiece,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op3_exact_topk": sql.OP3,
    "op4_warc": sql.OP4,
    "op8_jaccard_join": sql.OP8,
    "op9_license_scan": sql.op9(),
    "op10_mixing": mixing.OP10_SQL,
}
