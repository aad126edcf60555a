"""All queries of the library; importing the plans registers them."""

from lodestrand.plans import control, proofs, pythonic, relational, rules, scans, sequences, texts, writes
from lodestrand.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "control", "proofs", "pythonic", "relational", "rules", "scans", "sequences", "texts", "writes"]
