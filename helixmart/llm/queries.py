"""The registered queries of the training-data operators and the SQL that checks them."""

from helixmart.llm.conversations import op12_conversations
from helixmart.llm.decontaminate import op5_decontaminate
from helixmart.llm.jaccard import op3_jaccard
from helixmart.llm.language_model import op11_language_model
from helixmart.llm.nearest import nearest_sql, op7_nearest
from helixmart.llm.packing import op2_packing
from helixmart.llm.secrets import op9_secrets
from helixmart.llm.sharding import op6_sharding, sharding_sql
from helixmart.llm.substrings import op8_substrings
from helixmart.llm.token_files import op10_token_files
from helixmart.llm.toxicity import op4_toxicity
from helixmart.llm.url_filter import op1_url_filter, url_filter_sql
from helixmart.llm.whitening import op13_whitening

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_jaccard": op3_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_substrings": op8_substrings,
    "op9_secrets": op9_secrets,
    "op10_token_files": op10_token_files,
    "op11_language_model": op11_language_model,
    "op12_conversations": op12_conversations,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {
    "op1_url_filter": url_filter_sql(),
    "op6_sharding": sharding_sql(),
    "op7_nearest": nearest_sql(),
}
