"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from tidelog.llm.chaining import op6_chaining
from tidelog.llm.jaccard import op3_jaccard_join
from tidelog.llm.lines import op2_line_dedup
from tidelog.llm.media import op8_media
from tidelog.llm.mixing import op7_mixing
from tidelog.llm.pieces import op1_sentencepiece
from tidelog.llm.quality import op10_quality
from tidelog.llm.suffixes import op9_suffix_dedup
from tidelog.llm.toxicity import op5_toxicity
from tidelog.llm.urls import SQL_URLS, op4_url_filter

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_jaccard_join, op4_url_filter, op5_toxicity, op6_chaining, op7_mixing, op8_media, op9_suffix_dedup, op10_quality)}
SQL = {"op4_url_filter": SQL_URLS}
