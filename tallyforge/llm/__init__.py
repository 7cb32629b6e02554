"""Training-data operators: secret scans, token files, joins, mixing, chat formatting.

Nothing outside this folder imports it.
"""
