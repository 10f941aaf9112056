"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import op7_decontaminate
from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .html_extract import op1_html_extract
from .language_id import op2_language_id
from .licenses import OP3_SQL, op3_license_scan
from .mixing import OP9_SQL, op9_mixing
from .ngram_join import OP10_SQL, op10_ngram_jaccard
from .sharding import OP6_SQL, op6_sharding
from .url_filter import OP8_SQL, op8_url_filter

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
SQL = {
    "op3_license_scan": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_sharding": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op10_ngram_jaccard": OP10_SQL,
}
