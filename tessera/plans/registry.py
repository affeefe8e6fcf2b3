"""All registered queries by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

import re

from tessera.plans import maps, tables

QUERIES = {**maps.QUERIES, **tables.QUERIES}
#: A rounded negative zero is made a positive one, as the other side has it.
ORACLE_SQL = {name: re.sub(r"\bround\(", "0.0::DOUBLE + round(", sql) for name, sql in {**maps.ORACLE_SQL, **tables.ORACLE_SQL}.items()}
