"""The queries of this package, for ``__spark_entry__``."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .chat import OP9_SQL, op9_chat_format
from .infilling import OP12_SQL, op12_infilling
from .jaccard import OP4_SQL, op4_ngram_jaccard
from .media import op10_media_columns
from .packing import op6_best_fit_packing
from .pii import op11_pii
from .prefixtrie import OP13_SQL, op13_prefix_trie
from .secrets import op5_secret_scans
from .tokenfiles import op8_token_files
from .topk import OP3_SQL, op3_top_k
from .toxicity import op2_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_top_k, op4_ngram_jaccard, op5_secret_scans, op6_best_fit_packing, op7_warc, op8_token_files, op9_chat_format, op10_media_columns, op11_pii, op12_infilling, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op3_top_k": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op7_warc": OP7_SQL, "op9_chat_format": OP9_SQL, "op12_infilling": OP12_SQL, "op13_prefix_trie": OP13_SQL}
