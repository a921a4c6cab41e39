"""The subpackage's registered queries, and SQL where it can express one."""

from __future__ import annotations

from tessera.llm.bpe import op1_byte_bpe
from tessera.llm.chat import OP8_SQL, op8_chat
from tessera.llm.codes import OP12_SQL, op12_vector_codes
from tessera.llm.egojoin import OP2_SQL, op2_ego_join
from tessera.llm.hilbert import OP4_SQL, op4_hilbert_ann
from tessera.llm.langid import op5_langid
from tessera.llm.mixing import op6_mix
from tessera.llm.quality import op3_quality
from tessera.llm.runs import op13_periodic_runs
from tessera.llm.secrets import op7_secrets
from tessera.llm.simhash import op10_simhash
from tessera.llm.suffixes import OP11_SQL, op11_suffix_dedup
from tessera.llm.toxicity import op9_toxicity

QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_ego_join": op2_ego_join, "op3_quality": op3_quality, "op4_hilbert_ann": op4_hilbert_ann, "op5_langid": op5_langid, "op6_mix": op6_mix, "op7_secrets": op7_secrets, "op8_chat": op8_chat, "op9_toxicity": op9_toxicity, "op10_simhash": op10_simhash, "op11_suffix_dedup": op11_suffix_dedup, "op12_vector_codes": op12_vector_codes, "op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {"op2_ego_join": OP2_SQL, "op4_hilbert_ann": OP4_SQL, "op8_chat": OP8_SQL, "op11_suffix_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL}
