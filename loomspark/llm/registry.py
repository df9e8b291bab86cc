"""The queries and SQL of this subpackage's operators."""

from . import conversation_trie, decontaminate, html_wrapper, jaccard_trie, media_gif, packing, pii, quality, substring_fm, target_draw, tokens, url_filter, warc

_MODULES = (packing, html_wrapper, tokens, url_filter, jaccard_trie, pii, substring_fm, quality, media_gif, decontaminate, warc, target_draw, conversation_trie)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
