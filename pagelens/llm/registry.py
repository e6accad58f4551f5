"""Queries of this subpackage, with SQL where SQL can express them."""

from pagelens.llm import op1_langid, op2_lines, op3_bpe, op4_jaccard, op5_minhash, op6_mixing, op7_licenses, op8_substring, op9_fertility, op10_mix

QUERIES = {
    "op1_langid": op1_langid.op1_langid,
    "op2_lines": op2_lines.op2_lines,
    "op3_bpe": op3_bpe.op3_bpe,
    "op4_jaccard": op4_jaccard.op4_jaccard,
    "op5_minhash": op5_minhash.op5_minhash,
    "op6_mixing": op6_mixing.op6_mixing,
    "op7_licenses": op7_licenses.op7_licenses,
    "op8_substring": op8_substring.op8_substring,
    "op9_fertility": op9_fertility.op9_fertility,
    "op10_mix": op10_mix.op10_mix,
}
ORACLES = {"op2_lines": op2_lines.ORACLE, "op7_licenses": op7_licenses.ORACLE}
