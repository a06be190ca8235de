"""The queries of this subpackage and, where SQL can express them, their SQL."""

from keyloom.llm import chat, decontaminate, imatch, jaccard, language, lm, mixing, repeats, tokens, toxicity

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op10_chat": chat.op10_chat,
    "op5_repeats": repeats.op5_repeats,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_lm": lm.op9_lm,
    "op2_imatch": imatch.op2_imatch,
    "op3_tokens": tokens.op3_tokens,
    "op4_language": language.op4_language,
}
ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op10_chat": chat.OP10_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
}
