"""The corpus queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from estatelens.llm.ann import op3_nearest
from estatelens.llm.byte_bpe import op13_byte_bpe
from estatelens.llm.chat_format import OP8_SQL, op8_chat_format
from estatelens.llm.fingerprint import op5_fingerprint
from estatelens.llm.language_id import op9_language_id
from estatelens.llm.mixing import OP10_SQL, op10_mixing
from estatelens.llm.ngram_join import OP2_SQL, op2_ngram_join
from estatelens.llm.packing import op1_packing
from estatelens.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from estatelens.llm.secret_scan import OP7_SQL, op7_secret_scan
from estatelens.llm.sharding import op6_sharding
from estatelens.llm.spelling import OP12_SQL, op12_spelling
from estatelens.llm.url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_nearest": op3_nearest,
    "op4_url_filter": op4_url_filter,
    "op5_fingerprint": op5_fingerprint,
    "op6_sharding": op6_sharding,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES = {
    "op2_ngram_join": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op7_secret_scan": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_spelling": OP12_SQL,
}
