"""The queries of this subpackage and the SQL for those that SQL can express."""

from tessera.llm import decontamination, html, licenses, packing, quality, sharding, simhash, suffixes, tokens, warc

MODULES = (simhash, licenses, packing, sharding, warc, tokens, html, quality, decontamination, suffixes)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
