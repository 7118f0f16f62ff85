"""The queries of this subpackage and the SQL of those that SQL can express."""

from weftline.llm import langid, licenses, linededup, mixing, packing, quality, secrets, simhash, urls, vectors

_MODULES = (vectors, quality, simhash, packing, secrets, linededup, licenses, langid, mixing, urls)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
