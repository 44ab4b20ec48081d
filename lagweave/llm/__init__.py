"""Training-data operations: language ID, archives, mixing, secrets, scoring, dedup, tokens, decontamination.

Nothing else in the library imports this subpackage.
"""
