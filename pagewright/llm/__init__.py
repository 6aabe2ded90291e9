"""Training-data operators: encoding, extraction, deduplication, scoring, rules, search, mixing.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface and the thin ``opN_<name>`` query that fixes production parameters.
"""
