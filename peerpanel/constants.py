"""Fixed values.

Texts that the reference's result tables use, kept equal here so the tables read
the same.  Listed together, in the order they appear in those tables.
"""

# Quartile bin labels, lowest first.
QUARTILE_LABELS = ["Q1 (Low)", "Q2", "Q3", "Q4 (High)"]
# Fill for a missing category; the target's value when the target is absent.
UNKNOWN = "Unknown"
ABSENT = "N/A"
# The match flag.
MATCH_YES = "Yes"
MATCH_NO = "No"
