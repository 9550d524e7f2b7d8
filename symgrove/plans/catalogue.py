"""All queries outside the optional subpackage, by name, and their SQL."""

from symgrove.plans import golden, quality, reference

MODULES = [quality, reference, golden]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
