"""The queries of this subpackage and their SQL."""

from kinetext.llm import chat, decontaminate, langid, licenses, multi_index, packing, rans, simhash, substrings, suffixes
from kinetext.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_licenses": licenses.op2_licenses,
    "op3_rans": rans.op3_rans,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_multi_index": multi_index.op6_multi_index,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_language_id": langid.op9_language_id,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}
