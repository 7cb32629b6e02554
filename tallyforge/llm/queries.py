"""The operators' queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from tallyforge.llm.bpe import op6_bpe
from tallyforge.llm.chat import OP10_SQL, op10_chat
from tallyforge.llm.licenses import op8_licenses
from tallyforge.llm.mixing import OP9_SQL, op9_mixing
from tallyforge.llm.neardup import OP3_SQL, op3_jaccard
from tallyforge.llm.quality import OP4_SQL, op4_quality
from tallyforge.llm.repeats import op5_repeats
from tallyforge.llm.secrets import op1_secrets
from tallyforge.llm.tokenfile import op2_tokenfile
from tallyforge.llm.topk import OP7_SQL, op7_topk

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_tokenfile": op2_tokenfile,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_repeats": op5_repeats,
    "op6_bpe": op6_bpe,
    "op7_topk": op7_topk,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_chat": op10_chat,
}
SQL = {"op3_jaccard": OP3_SQL, "op4_quality": OP4_SQL, "op7_topk": OP7_SQL, "op9_mixing": OP9_SQL, "op10_chat": OP10_SQL}
