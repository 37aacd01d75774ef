"""Training-data operators: dedup, licences, languages, quality, HTML, leaks, mixing, secrets, tokens.

Nothing outside this subpackage imports it.  Each module holds one operator with its general
interface; ``queries`` registers the thin ``opN_<name>`` queries and their SQL.
"""
